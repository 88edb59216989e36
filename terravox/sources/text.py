"""Text readers; gzipped files are opened by Spark's text reader."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, block, row, value): lines in file order; ``row`` counts from the start of a block of the file."""
    t = spark.read.text(paths if isinstance(paths, str) else list(paths))
    t = t.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    return t


def _fields(columns: Sequence[str], at: Sequence[int], separator: str) -> list[Column]:
    parts = F.split(F.trim("value"), separator)
    return [F.try_element_at(parts, F.lit(i + 1)).try_cast("double").alias(c) for c, i in zip(columns, at, strict=True)]


def read_plain(spark: SparkSession, paths: str | Sequence[str], colour: bool = False) -> DataFrame:
    """Lines "x y z i" or "x y z r g b"; comments (#), blank and malformed lines are skipped. An intensity
    becomes r, g and b."""
    names = ["x", "y", "z", "r", "g", "b"] if colour else ["x", "y", "z", "r"]
    t = spark.read.text(paths if isinstance(paths, str) else list(paths)).where(~F.col("value").rlike(r"^\s*(#|$)"))
    found = t.select(*_fields(names, range(len(names)), r"\s+")).dropna()
    return found if colour else found.withColumns({"g": F.col("r"), "b": F.col("r")})


def read_columns(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[int], header: int = 0, strict_csv: bool = False) -> DataFrame:
    """X, y, z and, with six column indices, r, g, b (else 255) of text tables. ``strict_csv`` separates by commas
    alone, else white space and commas both do. The first line that doesn't parse ends its file: rows before it stay."""
    names = ["x", "y", "z", "r", "g", "b"][: len(columns)]
    if len(columns) not in (3, 6):
        raise ValueError("three or six column indices are needed")
    t = _lines(spark, paths)
    if header:
        first = t.where("block = 0").groupBy("path").agg(F.min("row").alias("first"))
        t = t.join(first, "path", "left").where((F.col("block") > 0) | (F.col("row") - F.col("first") >= header)).drop("first")
    parsed = t.select("path", "block", "row", *_fields(names, columns, r"\s*,\s*" if strict_csv else r"[\s,]+"))
    bad = parsed.where(" or ".join(f"{n} is null" for n in names)).groupBy("path").agg(F.min(F.struct("block", "row")).alias("bad"))
    kept = parsed.join(bad, "path", "left").where(F.col("bad").isNull() | (F.struct("block", "row") < F.col("bad")))
    out = kept.select(*names)
    return out if len(names) == 6 else out.withColumns({c: F.lit(255.0) for c in "rgb"})


def read_blocked(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[int] = (0, 1, 2), header: int = 0) -> DataFrame:
    """Repeated blocks of a count line and that many rows; a file is read in order, by one task."""
    names = ["x", "y", "z", "r", "g", "b"][: len(columns)]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                lines = iter(text.splitlines()[header:])
                out = []
                try:
                    for count in lines:
                        if count.strip():
                            for _ in range(int(count.split()[0])):
                                parts = next(lines).replace(",", " ").split()
                                out.append([float(parts[i]) for i in columns])
                except (ValueError, IndexError, StopIteration):
                    pass  # the first error ends the file
                yield pd.DataFrame(out, columns=names, dtype=float)

    t = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    out = t.mapInPandas(rows, ", ".join(f"{n} double" for n in names))
    return out if len(names) == 6 else out.withColumns({c: F.lit(255.0) for c in "rgb"})


def read_positions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The first three numbers of each line, commas as white space; other lines are skipped."""
    t = spark.read.text(paths if isinstance(paths, str) else list(paths))
    return t.select(*_fields("xyz", range(3), r"[\s,]+")).dropna()


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, damage) of a quoted CSV table with the columns POINT_X, POINT_Y and DamageID1."""
    t = spark.read.csv(path, header=True)
    return t.select(F.col("POINT_X").try_cast("double").alias("x"), F.col("POINT_Y").try_cast("double").alias("y"), F.col("DamageID1").try_cast("double").alias("damage"))
