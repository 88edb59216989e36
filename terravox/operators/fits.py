"""Least-squares primitives.

Planes and lines are fitted by distributed sums: covariances, then extents and residuals in the fitted frame. Spheres
and cylinders iterate over sums of the residuals' products, of at most 7 by 7 numbers. A selection of up to
``MAX_SELECTION`` points, as a person marks it, is brought together for that; of a larger one every iteration sums up
batches of points in many tasks, and only the sums meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravox.functions.vectors import cross, dot, norm, sub, vec
from terravox.operators.neighborhood import covariance, with_frame

#: Points of one selection that are brought together.
MAX_SELECTION = 5_000_000


def _in_frame(cloud: DataFrame, by: str) -> DataFrame:
    """Points with their coordinates along the long axis (u), the middle axis (v) and the normal (h) of their group."""
    frame = with_frame(covariance(cloud, by)).select(by, F.col("n").alias("n_points"), "cx", "cy", "cz", "frame")
    d = sub(vec(), vec("cx", "cy", "cz"))
    n, a = ((F.col(f"frame.{k}x"), F.col(f"frame.{k}y"), F.col(f"frame.{k}z")) for k in "na")
    return cloud.join(frame, by).withColumns({"u": dot(d, a), "v": dot(d, cross(n, a)), "h": dot(d, n)})


def fit_planes(cloud: DataFrame, by: str) -> DataFrame:
    """Per group of at least three points the plane's normal (upward), offset, rms and the rectangle around the
    points in its frame, 10 % of the longer side wider on each side."""
    f = _in_frame(cloud, by)
    s = f.groupBy(by).agg(F.first("n_points").alias("n_points"), *[F.first(f"c{c}").alias(f"c{c}") for c in "xyz"], F.first("frame").alias("frame"), F.sqrt(F.avg(F.col("h") * F.col("h"))).alias("rms"), *[g(c).alias(f"{k}_{c}") for c in "uv" for k, g in (("min", F.min), ("max", F.max))]).where("n_points >= 3")
    edge = F.greatest(F.col("max_u") - F.col("min_u"), F.col("max_v") - F.col("min_v")) * 0.1
    n = tuple(F.col(f"frame.n{c}") for c in "xyz")
    return s.select(by, "n_points", "rms", *[c.alias(f"n{k}") for c, k in zip(n, "xyz", strict=True)], dot(n, vec("cx", "cy", "cz")).alias("offset"), *[(F.col(f"min_{c}") - edge).alias(f"min_{c}") for c in "uv"], *[(F.col(f"max_{c}") + edge).alias(f"max_{c}") for c in "uv"])


def fit_lines(cloud: DataFrame, by: str) -> DataFrame:
    """Per group of at least two points the line's centre, axis, rms distance and length (10 % longer at each end)."""
    f = _in_frame(cloud, by)
    s = f.groupBy(by).agg(F.first("n_points").alias("n_points"), *[F.first(f"c{c}").alias(f"c{c}") for c in "xyz"], F.first("frame").alias("frame"), F.sqrt(F.avg(F.col("h") ** 2 + F.col("v") ** 2)).alias("rms"), F.min("u").alias("lo"), F.max("u").alias("hi")).where("n_points >= 2")
    mid = (F.col("lo") + F.col("hi")) / 2
    return s.select(by, "n_points", "rms", *[(F.col(f"c{c}") + mid * F.col(f"frame.a{c}")).alias(f"center_{c}") for c in "xyz"], *[F.col(f"frame.a{c}").alias(f"axis_{c}") for c in "xyz"], ((F.col("hi") - F.col("lo")) * 1.2).alias("length"))


class Sums(NamedTuple):
    """Of residuals r with the Jacobian J: half the sum of squares, J'r, J'J; and points in range of the last parameter
    (least and greatest place along the axis) where a fit needs them."""

    f: float
    g: np.ndarray
    a: np.ndarray
    low: float = 0.0
    high: float = 0.0


def _sums(r: np.ndarray, j: np.ndarray, along: np.ndarray | None = None) -> Sums:
    ends = (float(along.min()), float(along.max())) if along is not None and len(along) else (np.inf, -np.inf) if along is not None else (0.0, 0.0)
    return Sums(0.5 * float(r @ r), j.T @ r, j.T @ j, *ends)


def minimise(sums: Callable[[np.ndarray], Sums], start: np.ndarray, tau: float = 1e-3, eps: float = 1e-12, most: int = 1000) -> tuple[np.ndarray, Sums]:
    """Levenberg-Marquardt with the gain-ratio damping of Nielsen. ``sums`` gives the sums at some parameters.
    Returns parameters and their sums."""
    x = np.array(start, float)
    s = sums(x)
    mu, nu = tau * float(np.diag(s.a).max(initial=0.0)) or tau, 2.0
    for _ in range(most):
        if np.abs(s.g).max() <= eps:
            break
        try:
            step = np.linalg.solve(s.a + mu * np.eye(len(x)), -s.g)
        except np.linalg.LinAlgError:
            mu, nu = mu * nu, nu * 2
            continue
        if np.linalg.norm(step) <= eps * (np.linalg.norm(x) + eps):
            break
        there = sums(x + step)
        gain = (s.f - there.f) / (0.5 * float(step @ (mu * step - s.g)))
        if gain > 0:
            x, s = x + step, there
            mu, nu = mu * max(1 / 3, 1 - (2 * gain - 1) ** 3), 2.0
        else:
            mu, nu = mu * nu, nu * 2
    return x, s


def _sphere_sums(points: np.ndarray, x: np.ndarray) -> Sums:
    d = points - x[:3]
    r = np.maximum(np.sqrt((d * d).sum(axis=1)), 1e-300)
    return _sums(r - x[3], np.hstack([-d / r[:, None], -np.ones((len(points), 1))]))


def _cylinder_sums(points: np.ndarray, x: np.ndarray) -> Sums:
    size = np.linalg.norm(x[3:6])
    a = x[3:6] / size
    d = points - x[:3]
    t = d @ a
    e = d - t[:, None] * a
    r = np.maximum(np.sqrt((e * e).sum(axis=1)), 1e-300)
    n = e / r[:, None]
    to_axis = -(t[:, None] * n) / size
    return _sums(r - x[6], np.hstack([-n, to_axis - (to_axis @ a)[:, None] * a, -np.ones((len(points), 1))]), t)


class Moments(NamedTuple):
    n: int
    centre: np.ndarray
    covariance: np.ndarray


def sphere(sums: Callable[[np.ndarray], Sums], m: Moments) -> dict:
    """Centre, radius and rms of at least four points, whose sums are about their centre."""
    x, s = minimise(sums, np.array([0, 0, 0, 1.0]))
    return dict(zip(("center_x", "center_y", "center_z"), x[:3] + m.centre, strict=True)) | {"radius": abs(x[3]), "rms": float(np.sqrt(2 * s.f / m.n))}


def cylinder(sums: Callable[[np.ndarray], Sums], m: Moments) -> dict:
    """Centre, axis, radius, length and rms of at least six points; the best of three starting axes, those of the
    covariance."""
    x, s = min((minimise(sums, np.concatenate([[0, 0, 0], axis, [1.0]])) for axis in np.linalg.eigh(m.covariance)[1].T), key=lambda found: found[1].f)
    a = x[3:6] / np.linalg.norm(x[3:6])
    mid = x[:3] + a * (s.low + s.high) / 2 + m.centre
    a = a if tuple(a[::-1]) > (0, 0, 0) else -a
    return dict(zip(("center_x", "center_y", "center_z", "axis_x", "axis_y", "axis_z"), (*mid, *a), strict=True)) | {"radius": abs(x[6]), "length": (s.high - s.low) * 1.1, "rms": float(np.sqrt(2 * s.f / m.n))}


def _distributed(cloud: DataFrame, centre: np.ndarray, sums_of) -> Callable[[np.ndarray], Sums]:
    """Sums over all points of a cloud, by batches in the tasks that hold them."""

    def sums(x: np.ndarray) -> Sums:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = sums_of(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1) - centre, x)
                yield pa.RecordBatch.from_pydict({"v": [[s.f, s.low, s.high, *s.g, *s.a.ravel()]]})

        k = len(x)
        width = 3 + k + k * k
        columns = [(F.min if i == 1 else F.max if i == 2 else F.sum)(F.col("v")[i]).alias(f"v{i}") for i in range(width)]
        got = np.array(cloud.select("x", "y", "z").mapInArrow(part, "v array<double>").agg(*columns).first(), float)
        return Sums(got[0], got[3 : 3 + k], got[3 + k :].reshape(k, k), got[1], got[2])

    return sums


def _fit_groups(cloud: DataFrame, by: str, fit, sums_of, least: int, names: tuple[str, ...]) -> DataFrame:
    kind = cloud.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, n_points long, " + ", ".join(f"{n} double" for n in names)
    rows = cloud.select(by, *[F.col(c).cast("double").alias(c) for c in "xyz"])
    large = covariance(rows, by).where(F.col("n") > MAX_SELECTION).collect()  # there are at most as many as points over MAX_SELECTION

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < least:
            return pd.DataFrame(columns=[by, "n_points", *names])
        p = pdf[["x", "y", "z"]].to_numpy(float)
        m = Moments(len(p), p.mean(axis=0), np.cov(p.T, bias=True))
        return pd.DataFrame([{by: key[0], "n_points": m.n} | fit(lambda x: sums_of(p - m.centre, x), m)])[[by, "n_points", *names]]

    small = rows
    for r in large:
        small = small.where(~F.col(by).eqNullSafe(F.lit(r[by])))
    out = small.groupBy(by).applyInPandas(run, schema)
    for r in large:
        own = rows.where(F.col(by).eqNullSafe(F.lit(r[by])))
        c = [[r[min(i, j) + max(i, j)] for j in "xyz"] for i in "xyz"]
        m = Moments(r["n"], np.array([r.cx, r.cy, r.cz]), np.array(c))
        made = {by: r[by], "n_points": m.n} | fit(_distributed(own, m.centre, sums_of), m)
        out = out.unionByName(cloud.sparkSession.createDataFrame([[made[f] if f in (by, "n_points") else float(made[f]) for f in (by, "n_points", *names)]], schema))
    return out


def fit_spheres(cloud: DataFrame, by: str) -> DataFrame:
    return _fit_groups(cloud, by, sphere, _sphere_sums, 4, ("center_x", "center_y", "center_z", "radius", "rms"))


def fit_cylinders(cloud: DataFrame, by: str) -> DataFrame:
    return _fit_groups(cloud, by, cylinder, _cylinder_sums, 6, ("center_x", "center_y", "center_z", "axis_x", "axis_y", "axis_z", "radius", "length", "rms"))


def plane_pairs(planes: DataFrame, id_column: str = "id", parallel: float = 1e-9) -> DataFrame:
    """(a, b, dx, dy, dz, px, py, pz): direction and nearest point to the origin of the line in which each pair of
    planes (nx, ny, nz, offset) meets; parallel pairs are missing. Fitted planes are few."""
    left, right = (planes.select(F.col(id_column).alias(i), *[F.col(f"n{c}").alias(f"{i}{c}") for c in "xyz"], F.col("offset").alias(f"{i}o")) for i in "ab")
    pairs = left.join(right, F.col("a") < F.col("b"))
    n1, n2 = (vec(f"{i}x", f"{i}y", f"{i}z") for i in "ab")
    d = cross(n1, n2)
    dd = dot(d, d)
    m = tuple(F.col("ao") * y - F.col("bo") * x for x, y in zip(n1, n2, strict=True))
    p = cross(m, d)
    return pairs.where(dd > parallel).select("a", "b", *[(c / norm(d)).alias(f"d{k}") for c, k in zip(d, "xyz", strict=True)], *[(c / dd).alias(f"p{k}") for c, k in zip(p, "xyz", strict=True)])


def plane_triples(planes: DataFrame, id_column: str = "id", parallel: float = 1e-9) -> DataFrame:
    """The points in which triples of planes meet, by Cramer's rule; triples without one point are missing."""
    sides = [planes.select(F.col(id_column).alias(i), *[F.col(f"n{c}").alias(f"{i}{c}") for c in "xyz"], F.col("offset").alias(f"{i}o")) for i in "abc"]
    t = sides[0].join(sides[1], F.col("a") < F.col("b")).join(sides[2], F.col("b") < F.col("c"))
    n = [vec(f"{i}x", f"{i}y", f"{i}z") for i in "abc"]
    det = dot(n[0], cross(n[1], n[2]))
    parts = [(F.col("ao"), cross(n[1], n[2])), (F.col("bo"), cross(n[2], n[0])), (F.col("co"), cross(n[0], n[1]))]
    at = [sum((o * c[k] for o, c in parts[1:]), parts[0][0] * parts[0][1][k]) / det for k in range(3)]
    return t.where(F.abs(det) > parallel).select("a", "b", "c", *[x.alias(k) for x, k in zip(at, "xyz", strict=True)])


def plane_line(planes: DataFrame, lines: DataFrame, parallel: float = 1e-9) -> DataFrame:
    """Points where lines (line, cx, cy, cz, ax, ay, az) meet planes (id, nx, ny, nz, offset)."""
    pairs = planes.select(F.col("id").alias("plane"), "nx", "ny", "nz", "offset").join(lines, F.lit(True))
    n, c, a = vec("nx", "ny", "nz"), vec("cx", "cy", "cz"), vec("ax", "ay", "az")
    t = (F.col("offset") - dot(n, c)) / dot(n, a)
    return pairs.where(F.abs(dot(n, a)) > parallel).select("plane", "line", *[(p + t * d).alias(k) for p, d, k in zip(c, a, "xyz", strict=True)])


def primitive_distance(at: tuple) -> Column:
    """Distance from a point to a primitive row, by prim_type: 0 plane, 1 sphere, 2 cylinder (its side), 3 line, 4 point.

    A plane ends at the rectangle of its corners, a line and a cylinder at half their length from the centre; what lies
    beyond adds to the distance. Beyond a rectangle's edge the reference multiplies the distance by the edge's length,
    and so does this. Without corners or length there is no end. Axes and normals have unit length."""
    p, c, a, n = vec(*at), vec("center_x", "center_y", "center_z"), vec("axis_x", "axis_y", "axis_z"), vec("nx", "ny", "nz")
    d = sub(p, c)
    corner = [vec(*[f"corner{i}_{k}" for k in "xyz"]) for i in range(4)]
    flat = dot(p, n) - F.col("offset")
    plane = flat * flat
    for i, j in ((0, 1), (1, 3), (3, 2), (2, 0)):
        beyond = F.greatest(dot(sub(p, corner[i]), cross(sub(corner[j], corner[i]), n)), F.lit(0.0))
        plane = plane + F.coalesce(beyond * beyond, F.lit(0.0))
    ends = F.coalesce(F.greatest(F.abs(dot(d, a)) - F.col("length") / 2, F.lit(0.0)), F.lit(0.0))
    aside = norm(cross(a, d))
    side = aside - F.col("radius")
    kind = F.col("prim_type")
    return F.when(kind == 0, F.sqrt(plane)).when(kind == 1, F.abs(norm(d) - F.col("radius"))).when(kind == 2, F.sqrt(ends * ends + side * side)).when(kind == 3, F.sqrt(ends * ends + aside * aside)).when(kind == 4, norm(d))


def pick_primitive(primitives: DataFrame, at: tuple, within: float) -> DataFrame:
    """The nearest primitive nearer to a point than a distance; ties by id."""
    return primitives.withColumn("distance", primitive_distance(at)).where(F.col("distance") < within).orderBy("distance", "id").limit(1).select("id", "prim_type", "distance")
