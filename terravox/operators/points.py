"""Point tables: import arithmetic, filters and selections.

A cloud is a DataFrame with double columns x, y, z and, where it has them, an id and colour channels.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravox.functions.colors import masked
from terravox.functions.vectors import cone_contains, sqr_dist, vec

Triple = tuple[float, float, float]


def translate(cloud: DataFrame, offset: Triple) -> DataFrame:
    """F1: add an offset in double precision."""
    return cloud.withColumns({c: F.col(c).cast("double") + float(o) for c, o in zip("xyz", offset, strict=True)})


def transform(cloud: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """an affine map given by three rows of four numbers."""
    return cloud.withColumns({c: F.col("x") * float(r[0]) + F.col("y") * float(r[1]) + F.col("z") * float(r[2]) + float(r[3]) for c, r in zip("xyz", matrix, strict=True)})


def import_points(cloud: DataFrame, offset: Triple = (0, 0, 0), matrix: Sequence[Sequence[float]] | None = None, mask: Triple = (1, 1, 1), single: bool = True) -> DataFrame:
    """F1 to F4 in their order: offset, map, colour mask with clamping, single precision."""
    out = translate(cloud, offset)
    out = transform(out, matrix) if matrix else out
    if {"r", "g", "b"} <= set(cloud.columns):
        out = out.withColumns(dict(zip("rgb", masked(vec("r", "g", "b"), mask), strict=True)) | {"a": F.lit(255).cast("short")})
    return out.withColumns({c: F.col(c).cast("float") for c in "xyz"}) if single else out


def in_box(low: Sequence[float], high: Sequence[float], half_open: bool = False) -> Column:
    """range predicate on x, y (and z, if three numbers are given); plain comparisons, so scans prune by it."""
    parts = [(F.col(c) >= float(a)) & ((F.col(c) < float(b)) if half_open else (F.col(c) <= float(b))) for c, a, b in zip("xyz", low, high, strict=False)]
    return reduce(lambda a, b: a & b, parts)


def in_source_box(low: Triple, high: Triple, offset: Triple) -> Column:
    """a box in source coordinates on a cloud that is stored with the offset subtracted."""
    return in_box([a - o for a, o in zip(low, offset, strict=True)], [b - o for b, o in zip(high, offset, strict=True)])


def in_sphere(centre: Triple, radius: float, strict: bool = False) -> Column:
    """closed by default; brushes are open."""
    d2 = sqr_dist(vec(), vec(*centre))
    return d2 < radius * radius if strict else d2 <= radius * radius


def in_classes(mask: int, column: str = "class") -> Column:
    """F8: class ids as a bit mask."""
    return F.expr(f"shiftleft(1, cast(`{column}` as int) & 31) & {int(mask)}") != 0


def in_capsule(p, centre, radius: float, tolerance: float) -> Column:
    """below a candidate: a vertical cylinder of the radius that ends in a hemisphere ``tolerance`` below it."""
    r2 = (p[0] - centre[0]) * (p[0] - centre[0]) + (p[1] - centre[1]) * (p[1] - centre[1])
    top = centre[2] - tolerance - radius
    return (r2 <= radius * radius) & ((p[2] <= top) | (r2 + (p[2] - top) * (p[2] - top) <= radius * radius))


def in_cone(apex: Triple, axis: Triple, cos_angle: float) -> Column:
    """F13."""
    return cone_contains(vec(), vec(*apex), vec(*axis), cos_angle)


def brush_select(cloud: DataFrame, strokes: Sequence[tuple[str, Triple, float]], initial: Column | None = None) -> DataFrame:
    """A boolean column ``selected`` after strokes ("add" | "subtract" | "clear", centre, radius) in order."""
    selected = F.lit(False) if initial is None else initial
    for kind, centre, radius in strokes:
        near = in_sphere(centre, radius, strict=True)
        selected = F.lit(False) if kind == "clear" else (selected | near) if kind == "add" else (selected & ~near)
    return cloud.withColumn("selected", selected)


def plane_sides(low: Sequence[tuple[Triple, float]]) -> Column:
    """inside all half spaces normal * p <= offset, as a view volume."""
    x, y, z = vec()
    return reduce(lambda a, b: a & b, [x * float(n[0]) + y * float(n[1]) + z * float(n[2]) <= float(d) for n, d in low])


def union_clouds(*clouds: DataFrame) -> DataFrame:
    """All rows of all clouds, duplicates kept, with ``dataset_id`` by position; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c.withColumn("dataset_id", F.lit(i)) for i, c in enumerate(clouds)])


def extents(cloud: DataFrame, *by: str, rollup: bool = False) -> DataFrame:
    """A1, A3, A5: count and bounds, per group; with ``rollup`` the totals too (nulls in the group columns)."""
    groups = cloud.rollup(*by) if rollup else cloud.groupBy(*by)
    return groups.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in "xyz" for k, f in (("min", F.min), ("max", F.max))])


def recommended_offset(cloud: DataFrame) -> DataFrame:
    """Minus the centre of the bounds."""
    return cloud.agg(*[(-(F.min(c) + F.max(c)) / 2).alias(f"offset_{c}") for c in "xyz"])
