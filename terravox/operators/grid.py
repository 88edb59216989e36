"""Elevation grids and profiles: windowed-sinc interpolation as one join for all vertices."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravox.functions.vectors import lanczos
from terravox.operators.spatial import cell_join
from terravox.plans.storage import cut


def grid_shape(low: tuple[float, float], high: tuple[float, float], cell: tuple[float, float]) -> tuple[tuple[int, int], tuple[float, float]]:
    """Vertex counts, and the origin with the overshoot split evenly between both ends."""
    n = tuple(math.ceil((b - a) / c) + 1 for a, b, c in zip(low, high, cell, strict=True))
    return n, tuple(a - ((k - 1) * c - (b - a)) / 2 for a, b, c, k in zip(low, high, cell, n, strict=True))


def grid_vertices(spark: SparkSession, low: tuple[float, float], high: tuple[float, float], cell: tuple[float, float]) -> DataFrame:
    """(gx, gy, x, y) of all vertices, made where they are used."""
    (nx, ny), (x0, y0) = grid_shape(low, high, cell)
    ids = spark.range(nx * ny)
    gx, gy = (F.col("id") % nx).cast("int"), F.floor(F.col("id") / nx).cast("int")
    return ids.select(gx.alias("gx"), gy.alias("gy"), (F.lit(x0) + gx * float(cell[0])).alias("x"), (F.lit(y0) + gy * float(cell[1])).alias("y"))


def _sites(vertices: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """Vertices with the points whose x and y are within ``reach``."""
    p = points.select(*[F.col(c).cast("double").alias(c) for c in "xyz"])
    near = (F.abs(F.col("px") - F.col("x")) <= reach) & (F.abs(F.col("py") - F.col("y")) <= reach)
    return cell_join(vertices, p, reach, axes="xy", condition=near)


def lanczos_grid(vertices: DataFrame, points: DataFrame, cell: tuple[float, float], lobes: int = 3) -> DataFrame:
    """Per vertex the weight sum, absolute weight sum, elevation and its partial derivatives' finite
    sums; elevation is null without weight. Vertices without any point within reach are missing."""
    w = lanczos((F.col("px") - F.col("x")) / cell[0], lobes) * lanczos((F.col("py") - F.col("y")) / cell[1], lobes)
    found = _sites(vertices, points, lobes * max(cell)).withColumn("w", w)
    sums = found.groupBy("gx", "gy").agg(F.sum("w").alias("weight"), F.sum(F.abs("w")).alias("confidence"), F.sum(F.col("w") * F.col("pz")).alias("wz"))
    return sums.select("gx", "gy", "weight", "confidence", F.when(F.abs("weight") > 1e-9, F.col("wz") / F.col("weight")).alias("z"))


def adaptive_grid(vertices: DataFrame, points: DataFrame, cell: tuple[float, float], lobes: int = 3, most: int = 8) -> DataFrame:
    """(gx, gy, z, dilations): while a vertex' weight is below 1, the kernel doubles; each level is blended in by
    (weight - 0.25) / 0.75 where that is positive. Vertices unresolved after ``most`` levels keep their blend, null if
    nothing was in reach. Each level joins only the unresolved vertices."""
    state = vertices.withColumns({"z": F.lit(None).cast("double"), "share": F.lit(0.0), "dilations": F.lit(0)})
    done = []
    for level in range(most + 1):
        size = tuple(c * 2.0**level for c in cell)
        got = lanczos_grid(state.select("gx", "gy", "x", "y"), points, size, lobes).toDF("gx", "gy", "w", "c", "e")
        a = F.least(F.greatest((F.coalesce("w", F.lit(0.0)) - 0.25) / 0.75, F.lit(0.0)), F.lit(1.0))
        joined = state.join(got, ["gx", "gy"], "left").withColumn("a", F.when(F.col("e").isNotNull(), a).otherwise(0.0))
        rest = 1 - F.col("share")
        new = F.when(F.col("a") > 0, F.coalesce("z", F.lit(0.0)) + rest * F.col("a") * F.col("e")).otherwise(F.col("z"))
        joined = joined.withColumn("z", new).withColumn("share", F.col("share") + rest * F.col("a")).withColumn("full", F.coalesce(F.col("w") >= 1, F.lit(False)))
        joined = cut(joined.select("gx", "gy", "x", "y", "z", "share", F.lit(level).alias("dilations"), "full"))
        done.append(joined.where("full" if level < most else "true").select("gx", "gy", "z", "share", "dilations"))
        state = joined.where("not full").drop("full")
        if state.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).withColumn("z", F.when(F.col("share") > 0, F.col("z") / F.col("share"))).drop("share")


def radial_elevations(sites: DataFrame, points: DataFrame, radius: float, lobes: int = 3, id_column: str = "site") -> DataFrame:
    """Elevations at arbitrary (x, y) sites by a radial kernel; points at distance below radius * lobes count."""
    r = F.sqrt((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2)
    found = _sites(sites.select(F.col(id_column).alias("site"), "x", "y"), points, radius * lobes).withColumn("r", r).where(F.col("r") < radius * lobes)
    sums = found.withColumn("w", lanczos(F.col("r") / radius, lobes)).groupBy("site").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("pz")).alias("wz"))
    return sums.select("site", "weight", F.when(F.abs("weight") > 1e-9, F.col("wz") / F.col("weight")).alias("z"))


def grid_gradient(grid: DataFrame, cell: tuple[float, float]) -> DataFrame:
    """Unit normals from central differences along rows and columns, one-sided at the borders and next to gaps."""

    def slope(by: str, along: str, size: float) -> Column:
        w = Window.partitionBy(by).orderBy(along)
        near = lambda f: F.when(F.abs(f(along).over(w) - F.col(along)) == 1, f("z").over(w))
        before, after = near(F.lag), near(F.lead)
        span = F.when(before.isNotNull(), 1).otherwise(0) + F.when(after.isNotNull(), 1).otherwise(0)
        return F.when(span > 0, (F.coalesce(after, F.col("z")) - F.coalesce(before, F.col("z"))) / (span * size)).otherwise(0.0)

    g = grid.select("gx", "gy", "z", slope("gy", "gx", cell[0]).alias("dx"), slope("gx", "gy", cell[1]).alias("dy"))
    n = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + 1)
    return g.select("gx", "gy", "z", (-F.col("dx") / n).alias("nx"), (-F.col("dy") / n).alias("ny"), (1 / n).alias("nz"))


def bilinear_residuals(grid: DataFrame, points: DataFrame, origin: tuple[float, float], cell: tuple[float, float]) -> DataFrame:
    """(gx, gy, n, rms) per grid cell of the points' heights against the bilinear surface through its vertices;
    points outside all complete cells are left out."""
    u, v = ((F.col(c).cast("double") - o) / s for c, o, s in zip("xy", origin, cell, strict=True))
    p = points.select(F.floor(u).alias("gx"), F.floor(v).alias("gy"), (u - F.floor(u)).alias("u"), (v - F.floor(v)).alias("v"), F.col("z").cast("double").alias("z"))
    g = grid.where("z is not null").select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), "z")
    corner = lambda dx, dy: g.select((F.col("gx") - dx).alias("gx"), (F.col("gy") - dy).alias("gy"), F.col("z").alias(f"z{dx}{dy}"))
    corners = reduce(lambda a, b: a.join(b, ["gx", "gy"]), [corner(dx, dy) for dy in (0, 1) for dx in (0, 1)])
    surface = (F.col("z00") * (1 - F.col("u")) + F.col("z10") * F.col("u")) * (1 - F.col("v")) + (F.col("z01") * (1 - F.col("u")) + F.col("z11") * F.col("u")) * F.col("v")
    d = F.col("z") - surface
    return p.join(corners, ["gx", "gy"]).groupBy("gx", "gy").agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rms"))


def profile_samples(spark: SparkSession, polyline: list[tuple[float, float]], segment: float = 1.0, oversampling: int = 2) -> DataFrame:
    """(seq, x, y, ux, uy): samples along a polyline; every leg is cut into round(length / segment) equal steps, each
    with ``oversampling`` samples; (ux, uy) is the leg's direction over its step."""
    legs, first = [], 0
    for (x0, y0), (x1, y1) in zip(polyline, polyline[1:], strict=False):
        length = math.hypot(x1 - x0, y1 - y0)
        steps = max(1, int(length / segment + 0.5))
        legs.append((first, steps * oversampling, x0, y0, (x1 - x0) / (steps * oversampling), (y1 - y0) / (steps * oversampling), (x1 - x0) / length * steps / length, (y1 - y0) / length * steps / length))
        first += steps * oversampling
    df = spark.createDataFrame(legs, "first long, n int, x0 double, y0 double, sx double, sy double, ux double, uy double")
    each = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    end = spark.createDataFrame([(first, *map(float, polyline[-1]), *legs[-1][6:])], "seq long, x double, y double, ux double, uy double")
    return each.select((F.col("first") + F.col("k")).alias("seq"), (F.col("x0") + F.col("k") * F.col("sx")).alias("x"), (F.col("y0") + F.col("k") * F.col("sy")).alias("y"), "ux", "uy").unionByName(end)


def profile(samples: DataFrame, points: DataFrame, width: float = 1.0, lobes: int = 3, segment: float = 1.0) -> DataFrame:
    """Elevation at each sample by a Lanczos kernel along and across the profile; the argument of either kernel
    counts in units of pi, so that the support is lobes / pi steps."""
    dx, dy = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    length2 = F.col("ux") ** 2 + F.col("uy") ** 2
    along, across = dx * F.col("ux") + dy * F.col("uy"), (dy * F.col("ux") - dx * F.col("uy")) / F.sqrt(length2) / width

    def kernel(t: Column) -> Column:
        a = t * math.pi
        return F.when(F.abs(a) >= lobes, 0.0).when(a == 0, 1.0).otherwise(F.sin(a) / a * F.sin(a / lobes) / (a / lobes))

    reach = 1.5 * lobes / math.pi * max(width, 1.5 * segment)
    found = _sites(samples, points, reach).withColumn("w", kernel(along) * kernel(across)).where("w <> 0")
    sums = found.groupBy("seq").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("pz")).alias("wz"))
    return samples.select("seq", "x", "y").join(sums, "seq", "left").select("seq", "x", "y", F.when(F.abs("weight") > 1e-9, F.col("wz") / F.col("weight")).alias("z"))
