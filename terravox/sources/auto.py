"""A reader by file name, in any letter case; .gz is stripped for text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terravox.sources import binary, text


def read_points(spark: SparkSession, path: str, columns: tuple[int, ...] = (0, 1, 2), header: int = 0, classes: int | None = None) -> DataFrame:
    """Points (x, y, z, r, g, b) of a file of any known format."""
    name = path.lower().removesuffix(".gz")
    kind = name.rsplit("/", 1)[-1].rsplit(".", 1)[-1]
    own = ("x", "y", "z", "r", "g", "b")
    if kind in ("bin", "binrgb", "las"):
        return binary.read_records(spark, path, kind, classes if kind == "las" else None).select(*own)
    if kind in ("xyzi", "xyzrgb"):
        return text.read_plain(spark, path, colour=kind == "xyzrgb").select(*own)
    if kind in ("asc", "txt", "csv", "ascii"):
        return text.read_columns(spark, path, columns, header, strict_csv=kind == "csv").select(*own)
    if kind == "ply":
        return binary.read_ply(spark, path)
    if kind == "idl":
        return binary.read_galaxies(spark, path).select(*own)
    if kind in ("oct", "obin"):
        return binary.read_octree(spark, path.rsplit(".", 1)[0], old=True)
    if kind in ("lidar", "octree") or "." not in name.rsplit("/", 1)[-1]:
        return binary.read_octree(spark, path)
    raise ValueError(f"unknown point file format of {path!r}")
