"""Connected components of a graph of any size: alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.plans.storage import cut, discard


def _to_minimum(edges: DataFrame, by: str, other: str) -> DataFrame:
    """Edges with, for each end ``by``, the least node among its neighbours ``other``; sums are made before the shuffle."""
    least = edges.groupBy(by).agg(F.min(other).alias("m"))
    return edges.join(least, by)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of one orderable type), the component named by its
    least node. Self loops, repeated edges and both directions are allowed; null ends are ignored; no edges give no
    rows.

    Every node hangs itself and its larger neighbours below the least node it knows (large star), then its smaller
    neighbours likewise (small star), until all edges are stars: O(log n) rounds, each two aggregations and joins whose
    hot keys Spark may split.
    """
    ends = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    ends = cut(ends)
    known = None
    while True:
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _to_minimum(large, "u", "v")
        before, ends = ends, cut(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())
        discard(before)
        state = ends.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known:
            break
        known = state
    roots = ends.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return ends.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
