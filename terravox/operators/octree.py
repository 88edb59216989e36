"""Octree keys, adaptive leaves and multi-resolution samples.

A cell at level L is named by the L octant digits on the way to it (x bit + 2 y bit + 4 z bit), so that prefixes are
ancestors, and sorting by key is a Z-order that range partitions and Parquet statistics can use.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravox.operators import blocks
from terravox.plans.storage import cut

Cube = tuple[float, float, float, float]  #: least corner and edge


def root_cube(cloud: DataFrame) -> Cube:
    """The smallest cube around the centre of the bounds, nudged so that the greatest point is inside a half-open
    cube. An empty cloud has the unit cube at 0."""
    b = cloud.agg(*[f(F.col(c).cast("double")) for c in "xyz" for f in (F.min, F.max)]).first()
    if b[0] is None:
        return 0.0, 0.0, 0.0, 1.0
    edge = max(float(np.nextafter(np.float32(b[2 * i + 1]), np.float32(np.inf))) - b[2 * i] for i in range(3)) or 1.0
    mid = [(b[2 * i] + b[2 * i + 1]) / 2 for i in range(3)]
    return (*[m - edge / 2 for m in mid], edge * (1 + 2**-20))


def octree_key(cube: Cube, level: int) -> Column:
    """The digits of a point's cell at a level; points outside the cube go to its border cells."""
    x0, y0, z0, edge = cube
    top = (1 << level) - 1
    cells = [F.least(F.greatest(F.floor((F.col(c).cast("double") - o) / edge * float(1 << level)), F.lit(0)), F.lit(top)) for c, o in zip("xyz", (x0, y0, z0), strict=True)]
    digits = []
    for k in reversed(range(level)):
        x, y, z = (F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long")) for c in cells)
        digits.append((x + 2 * y + 4 * z).cast("string"))
    return F.concat(*digits) if digits else F.lit("")


def level_counts(keyed: DataFrame, level: int) -> DataFrame:
    """(node_key, level, n) of all occupied cells from the root to a level: cells of the deepest level are counted first,
    then their counts are added up for all ancestors."""
    deep = keyed.groupBy("key").agg(F.count("*").alias("n"))
    each = deep.select(F.explode(F.sequence(F.lit(0), F.lit(level))).alias("level"), "key", "n")
    return each.groupBy(F.expr("substring(key, 1, level)").alias("node_key"), "level").agg(F.sum("n").alias("n"))


def node_table(keyed: DataFrame, level: int, most: int) -> DataFrame:
    """The nodes of the tree that splits every cell with more than ``most`` points, down to a level: node_key,
    level, n, is_leaf. T9: the level also bounds the depth for coincident points."""
    counts = level_counts(keyed, level)
    parents = counts.select(F.col("node_key").alias("p"), F.col("n").alias("np"))
    nodes = counts.join(parents, (F.expr("substring(node_key, 1, level - 1)") == F.col("p")) & (F.col("level") > 0), "left")
    nodes = nodes.where((F.col("level") == 0) | (F.col("np") > most))
    return nodes.select("node_key", "level", "n", ((F.col("n") <= most) | (F.col("level") == level)).alias("is_leaf"))


def assign_leaves(keyed: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """Points with their leaf: the only leaf that is a prefix of their key."""
    leaves = nodes.where("is_leaf").select("node_key", F.col("level").alias("leaf_level"))
    deep = keyed.select("key").distinct()
    each = deep.select("key", F.explode(F.sequence(F.lit(0), F.lit(level))).alias("leaf_level")).withColumn("node_key", F.expr("substring(key, 1, leaf_level)"))
    return keyed.join(each.join(leaves, ["node_key", "leaf_level"]).select("key", "node_key"), "key")


def _bit(bit: int):
    return lambda d: F.shiftright(d, bit).bitwiseAND(F.lit(1))


def node_boxes(nodes: DataFrame, cube: Cube) -> DataFrame:
    """Nodes with the least corner and edge of their cells."""
    x0, y0, z0, edge = cube
    digits = F.when(F.length("node_key") > 0, F.transform(F.split("node_key", ""), lambda d: d.cast("int"))).otherwise(F.array().cast("array<int>"))
    out = nodes.withColumn("edge", F.lit(edge) / F.pow(F.lit(2.0), F.length("node_key"))).withColumn("__d", digits)
    for bit, (c, o) in enumerate(zip("xyz", (x0, y0, z0), strict=True)):
        bits = F.transform("__d", _bit(bit))
        cell = F.aggregate(bits, F.lit(0).cast("long"), lambda a, d: a * 2 + d)
        out = out.withColumn(f"min_{c}", F.lit(o) + cell * F.col("edge"))
    return out.drop("__d")


def count_bounds(nodes: DataFrame, cube: Cube, low: tuple, high: tuple) -> DataFrame:
    """(lower, upper) bounds of the points in a box, from node counts alone: leaves inside it, and leaves that
    touch it."""
    b = node_boxes(nodes.where("is_leaf"), cube)
    inside = reduce(lambda a, c: a & c, [(F.col(f"min_{c}") >= lo) & (F.col(f"min_{c}") + F.col("edge") <= hi) for c, lo, hi in zip("xyz", low, high, strict=True)])
    touch = reduce(lambda a, c: a & c, [(F.col(f"min_{c}") <= hi) & (F.col(f"min_{c}") + F.col("edge") >= lo) for c, lo, hi in zip("xyz", low, high, strict=True)])
    return b.agg(F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("lower"), F.coalesce(F.sum(F.when(touch, F.col("n"))), F.lit(0)).alias("upper"))


def prefix_order(nodes: DataFrame) -> DataFrame:
    """Parents before children, siblings by octant."""
    return nodes.orderBy("node_key")


def box_prefixes(cube: Cube, low: tuple, high: tuple, level: int) -> Column:
    """Predicate on ``key`` for the cells of a level that a box touches: partition pruning that a box alone can't give."""
    size = cube[3] / (1 << level)
    spans = [range(max(0, int((a - o) // size)), min((1 << level) - 1, int((b - o) // size)) + 1) for a, b, o in zip(low, high, cube, strict=False)]
    keys = ["".join(str((x >> k & 1) + 2 * (y >> k & 1) + 4 * (z >> k & 1)) for k in reversed(range(level))) for x in spans[0] for y in spans[1] for z in spans[2]]
    return F.substring("key", 1, level).isin(keys)


#: Points of the blocks among which neighbours are searched.
_BLOCK = 32


class _Places:
    """Points in the blocks of a k-d tree, to find those near to others; the work grows little faster than the points."""

    def __init__(self, points: np.ndarray):
        self.points = points
        layout = blocks.tree(points, -(-len(points) // _BLOCK))
        self.block, size = layout.block(points), layout.blocks
        self.members = np.argsort(self.block, kind="stable")
        self.starts = np.searchsorted(self.block[self.members], np.arange(size + 1))
        low, high = np.full((2 * size, 3), np.inf), np.full((2 * size, 3), -np.inf)
        np.minimum.at(low, size + self.block, points)
        np.maximum.at(high, size + self.block, points)
        for node in range(size - 1, 0, -1):
            low[node], high[node] = np.minimum(low[2 * node], low[2 * node + 1]), np.maximum(high[2 * node], high[2 * node + 1])
        self.boxes = blocks.Boxes(low, high, np.diff(self.starts))
        #: Points to look at together, so that their pairs stay few: all of a crowd at one place are in one block.
        self.step = int(min(4096, max(64, (1 << 17) // max(1, int(np.diff(self.starts).max())))))

    def pairs(self, some: np.ndarray, row: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``some`` and the points of the blocks they are to meet, with their squared distances."""
        size = self.starts[block + 1] - self.starts[block]
        row = np.repeat(row, size)
        other = self.members[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[block], size)]
        d = self.points[some[row]] - self.points[other]
        return row, other, (d * d).sum(axis=1)

    def near(self, some: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All points within the radius of each of ``some``, themselves included."""
        row, other, d2 = self.pairs(some, *self.boxes.reached(self.points[some], radius * radius))
        good = d2 <= radius[row] * radius[row]
        return row[good], other[good], d2[good]


def nearest_distances(places: _Places) -> np.ndarray:
    """Distance of each point to the nearest other: in its own block, and then in those that may have a nearer one."""
    out = np.full(len(places.points), np.inf)
    for first in range(0, len(out), places.step):
        some = places.members[first : first + places.step]
        best = np.full(len(some), np.inf)
        for look in (lambda: (np.arange(len(some)), places.block[some]), lambda: places.boxes.reached(places.points[some], best)):
            row, other, d2 = places.pairs(some, *look())
            apart = other != some[row]
            np.minimum.at(best, row[apart], d2[apart])
        out[some] = np.sqrt(best)
    return out


def thin(points: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, float]:
    """Indices of at most ``most`` points that are spread out, and the greatest radius that was cleared.

    Points are taken in the order of their distance to the nearest other (ties by id); each surviving one clears all
    others within 1.9 times that distance, until few enough are left; where they aren't, distances are taken anew. Memory
    is in proportion to the points."""
    left, detail = np.arange(len(points)), 0.0
    while len(left) > most:
        places = _Places(points[left])
        near = nearest_distances(places)
        alive, count = np.ones(len(left), bool), len(left)
        order = np.lexsort((ids[left], near))
        for first in range(0, len(order), places.step):
            some = order[first : first + places.step]
            some = some[alive[some]]
            row, other, _ = places.near(some, 1.9 * near[some])
            by = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[by], np.arange(len(some) + 1)).tolist()
            other = other[by]
            for k, i in enumerate(some.tolist()):
                if not alive[i]:
                    continue
                detail = max(detail, float(1.9 * near[i]))
                gone = other[ends[k] : ends[k + 1]]
                count -= int(alive[gone].sum()) - 1
                alive[gone] = False
                alive[i] = True
                if count <= most:
                    break
            if count <= most:
                break
        left = left[alive]
    return left, detail


def lod_samples(leaf_points: DataFrame, nodes: DataFrame, most: int, id_column: str = "id") -> DataFrame:
    """Samples of all interior nodes, bottom up: (node_key, level, id, x, y, z, detail_size) and all other
    columns of the points, which samples carry along. A parent's sample is thinned from its (at most eight) children's, so
    a group never has more than eight times ``most`` rows. Leaves give their own points and detail size 0; a leaf at the
    depth bound with more than ``most`` points is thinned first, coincident points (the least id of each place stays) even
    before its points come together."""
    nodes = cut(nodes)  # read once for every level
    deepest = nodes.agg(F.max("level")).first()[0] or 0
    fixed = ["node_key", "level", "id", "x", "y", "z", "detail_size"]
    extra = [c for c in leaf_points.columns if c not in (*fixed, id_column, "key")]
    keyed = leaf_points.select("node_key", F.length("node_key").alias("level"), F.col(id_column).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"], F.lit(0.0).alias("detail_size"), *extra)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)

    def sample(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kept, detail = thin(pdf[["x", "y", "z"]].to_numpy(float), pdf["id"].to_numpy(), most)
        return pdf.iloc[kept].assign(node_key=key[0], level=len(key[0]), detail_size=max(detail, float(pdf["detail_size"].max())))[[*fixed, *extra]]

    crowded = nodes.where(f"is_leaf and n > {int(most)}").select("node_key")
    keyed = cut(keyed)
    places = keyed.join(crowded, "node_key").groupBy("node_key", "x", "y", "z").agg(F.min("id").alias("id"), *([F.min_by(F.struct(*extra), "id").alias("more")] if extra else []))
    places = places.select("node_key", F.length("node_key").alias("level"), "id", "x", "y", "z", F.lit(0.0).alias("detail_size"), *[F.col(f"more.`{c}`").alias(c) for c in extra])
    thinned = places.groupBy("node_key").applyInPandas(lambda key, pdf: sample(key, pdf).assign(detail_size=0.0), schema)
    keyed = cut(keyed.join(crowded, "node_key", "left_anti").select(*fixed, *extra).unionByName(thinned))
    interior = nodes.where("not is_leaf").select("node_key")
    out, below = [], None
    for level in range(deepest - 1, -1, -1):
        own = keyed.where(F.col("level") == level + 1)
        children = own if below is None else own.unionByName(below)
        parents = children.withColumn("node_key", F.expr(f"substring(node_key, 1, {level})")).join(interior, "node_key").select(*fixed, *extra)
        below = cut(parents.groupBy("node_key").applyInPandas(sample, schema))
        out.append(below)
    return reduce(DataFrame.unionByName, out) if out else keyed.limit(0)


def root_statistics(cube: Cube) -> dict[str, float]:
    """Centre of the root and its size, half the mean edge."""
    return {f"center_{c}": o + cube[3] / 2 for c, o in zip("xyz", cube[:3], strict=True)} | {"size": cube[3] / 2}


def with_view(nodes: DataFrame, details: DataFrame, cube: Cube, eye: tuple, view: tuple, planes: list[tuple[tuple, float]] = (), scale: float = 1.0, focus: tuple | None = None) -> DataFrame:
    """nodes with ``visible`` (for every plane (normal, offset) some corner has normal * corner > offset) and
    ``projected``, their detail size (of ``details``; 0 for leaves) times ``scale`` over the distance along the unit
    vector ``view`` of their point nearest to the focus (the eye without one); infinite behind the eye. ``focus`` (centre,
    radius, weight) makes nodes smaller whose distance from it, less half their diagonal, exceeds the radius."""
    b = node_boxes(nodes, cube)
    low, high = [F.col(f"min_{c}") for c in "xyz"], [F.col(f"min_{c}") + F.col("edge") for c in "xyz"]
    visible = F.lit(True)
    for normal, offset in planes:
        visible = visible & (sum((float(n) * (h if n > 0 else lo) for n, lo, h in zip(normal, low, high, strict=True)), F.lit(0.0)) > float(offset))
    centre, radius, weight = focus or (eye, 0.0, 0.0)
    at = [F.least(F.greatest(F.lit(float(c)), lo), h) for c, lo, h in zip(centre, low, high, strict=True)]
    depth = sum(((a - float(e)) * float(v) for a, e, v in zip(at, eye, view, strict=True)), F.lit(0.0))
    detail = F.coalesce("detail_size", F.lit(0.0))
    size = detail * float(scale) / depth
    if weight > 0:
        away = F.sqrt(sum(((a - float(c)) * (a - float(c)) for a, c in zip(at, centre, strict=True)), F.lit(0.0))) - F.col("edge") * (3**0.5 / 2)
        size = F.when(away > radius, size * F.pow(F.lit(float(radius)) / away, F.lit(float(weight)))).otherwise(size)
    d = details.groupBy("node_key").agg(F.max("detail_size").alias("detail_size"))
    joined = b.join(d, "node_key", "left")
    return joined.select(*nodes.columns, visible.alias("visible"), F.when(depth > 0, size).otherwise(float("inf")).alias("projected"))


def lod_cut(nodes: DataFrame, details: DataFrame, cube: Cube, eye: tuple, view: tuple, threshold: float, planes: list[tuple[tuple, float]] = (), scale: float = 1.0, focus: tuple | None = None) -> DataFrame:
    """The cut of the tree for a view: from the root on, a visible node whose projected size is at least the threshold
    is replaced by its children, unless it is a leaf. Returns node_key, level, is_leaf and projected of the visible nodes
    that are shown; every point of the cloud lies in one shown node or outside the view.

    A node is shown if it isn't refined itself and all its ancestors are, which one join on key prefixes tells."""
    seen = with_view(nodes, details, cube, eye, view, planes, scale, focus)
    refined = F.col("visible") & (F.col("projected") >= float(threshold)) & ~F.col("is_leaf")
    ends = seen.where(F.col("visible") & ~refined)
    inner = seen.where(refined).select(F.col("node_key").alias("ancestor"))
    each = ends.where("level > 0").select("node_key", "level", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("k")).withColumn("ancestor", F.expr("substring(node_key, 1, k)"))
    open_ends = each.join(inner, "ancestor").groupBy("node_key", "level").agg(F.count("*").alias("n")).where("n = level").select("node_key")
    shown = ends.join(open_ends, "node_key", "left_semi").unionByName(ends.where("level = 0"))
    return shown.select("node_key", "level", "is_leaf", "projected")


def shown_points(shown: DataFrame, samples: DataFrame, leaf_points: DataFrame) -> DataFrame:
    """The points of a cut: the samples of its interior nodes and the points of its leaves (columns of ``leaf_points``)."""
    columns = [c for c in leaf_points.columns if c in samples.columns]
    inner = samples.select(*columns).join(shown.where("not is_leaf").select("node_key"), "node_key", "left_semi")
    return inner.unionByName(leaf_points.select(*columns).join(shown.where("is_leaf").select("node_key"), "node_key", "left_semi"))


def coarsening_order(nodes: DataFrame) -> DataFrame:
    """Nodes in the order in which they are coarsened: those not seen for the longest time (``render_pass``) first, of
    those the ones of least ``projected`` size."""
    return nodes.orderBy("render_pass", "projected", "node_key")
