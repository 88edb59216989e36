"""Running extents and counts of clouds that arrive as files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravox.plans.storage import shared_root


def extent_stream(arriving: DataFrame) -> DataFrame:
    """Count and bounds of a stream of x, y, z so far; its state is one row."""
    return arriving.groupBy().agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in "xyz" for k, f in (("min", F.min), ("max", F.max))])


def density_stream(arriving: DataFrame, time_column: str, window: str, late: str) -> DataFrame:
    """Points per time window; windows close when the watermark, ``late`` behind, has passed them."""
    return arriving.withWatermark(time_column, late).groupBy(F.window(time_column, window).alias("window")).agg(F.count("*").alias("n"))


def running_extents(spark: SparkSession, path: str, x: Column, y: Column, z: Column) -> DataFrame:
    """Everything that is at a path now, streamed to the end; each micro-batch replaces the one row of the result."""
    schema = spark.read.parquet(path).schema
    arriving = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path).select(x.alias("x"), y.alias("y"), z.alias("z"))
    root = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    out = f"{root}/extents"
    q = extent_stream(arriving).writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{root}/state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def running_counts(spark: SparkSession, path: str, time_column: str, window: str, late: str) -> DataFrame:
    """(start, n): everything that is at a path now, counted by time window as a stream to the end."""
    schema = spark.read.parquet(path).schema
    arriving = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    root = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    out = f"{root}/counts"
    q = density_stream(arriving.withColumn(time_column, F.col(time_column).cast("timestamp")), time_column, window, late).select(F.col("window.start").alias("start"), "n").writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{root}/state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.parquet(out)
