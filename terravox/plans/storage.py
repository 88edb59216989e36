"""Lineage cuts that survive lost executors.

An intermediate result is written as Parquet below the folder named by ``spark.checkpoint.dir``, which every executor
can reach, and read back. Nothing is kept on an executor's own disk.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The session's folder for intermediate tables: below ``spark.checkpoint.dir``, or, only where that is unset
    (a local session, as in tests), below a temporary folder of the driver."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        base = base or "file://" + tempfile.mkdtemp(prefix="terravox-")
        _ROOTS[app] = f"{base.rstrip('/')}/terravox-{app}"
        atexit.register(_drop, spark, _ROOTS[app])
    return _ROOTS[app]


def _drop(spark: SparkSession, folder: str) -> None:
    """Remove the session's intermediate tables if the session still runs when the driver ends."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM has gone already
        pass


#: Session setting under which Spark removes an execution's shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table; executors that are lost later cost nothing. The
    shuffles that made it are removed at once: nothing will read them again."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    written = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[written] = path
    return written


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` returned and that no result to come reads."""
    for table in tables:
        if path := _WRITTEN.pop(table, None):
            hadoop = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def bound_batches(spark: SparkSession, rows: int = 1024, size: int = 8 << 20) -> None:
    """Hand at most so many rows, and about so many bytes, at a time to Python workers from now on in this session (never
    more than it is set to). Rows with whole texts are wide; the default batch of 10,000 of them, or 64 MB, takes hundreds
    of megabytes in a worker. Plans read these settings when they run, so they can't be put back before."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = _number(spark.conf.get(name, None) or spark.conf.get(name))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def _number(setting: str) -> int:
    """A number or size as Spark writes it: 1024, 64m, 67108864b."""
    value = setting.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40, "p": 50}.get(value[-1:], 0)
    return int(value[:-1] if unit else value) << unit if unit else int(value)
