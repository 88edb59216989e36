"""Vector and box expressions on columns. A vector is a triple of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vec(x="x", y="y", z="z") -> Vector:
    """A vector of column names, columns or numbers."""
    return tuple(F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y, z))


def sub(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def sqr_dist(a: Vector, b: Vector) -> Column:
    """Squared distance."""
    d = sub(a, b)
    return dot(d, d)


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def box_sqr_dist(p: Vector, low: Vector, high: Vector) -> Column:
    """Squared distance from a point to a box; 0 inside."""
    out = None
    for c, a, b in zip(p, low, high, strict=True):
        d = F.greatest(a - c, F.lit(0.0), c - b)
        out = d * d if out is None else out + d * d
    return out


def plane_distance(p: Vector, normal: Vector, offset: Column) -> Column:
    """Signed distance of a point to the plane normal * p = offset, whose normal has unit length."""
    return dot(p, normal) - offset


def distance_attribute(distance: Column, scale: float, offset: float = 0.0) -> Column:
    """Texture coordinate of a plane distance (F20): half at the plane, one unit per ``scale``."""
    return (distance - offset) / scale + 0.5


def exaggerate(p: Vector, normal: Vector, offset: Column, factor: float) -> Vector:
    """Points moved along a plane's normal to ``factor`` times their distance."""
    d = plane_distance(p, normal, offset) * (factor - 1.0)
    return tuple(c + d * n for c, n in zip(p, normal, strict=True))


def sun_vector(azimuth: Column, elevation: Column) -> Vector:
    """Direction to the sun from azimuth (clockwise from north) and elevation in degrees."""
    a, e = F.radians(azimuth), F.radians(elevation)
    return F.cos(e) * F.sin(a), F.cos(e) * F.cos(a), F.sin(e)


def strike_dip(normal: Vector) -> tuple[Column, Column]:
    """Dip azimuth in [0, 360) and dip in degrees of a plane with an upward normal."""
    azimuth = F.degrees(F.atan2(normal[0], normal[1]))
    return F.when(azimuth < 0, azimuth + 360.0).otherwise(azimuth), F.degrees(F.acos(normal[2] / norm(normal)))


# Speed of light in km/s over the Hubble constant, and the shares of matter and dark energy.
HUBBLE_DISTANCE, OMEGA_M, OMEGA_L = 3.0e5 / 71.0, 0.3, 0.7


def scaled_distance(z: Column, steps: int = 100) -> Column:
    """Distance of a redshift in a flat universe (S8b): the sum of dz / E(z) at the lower end of each step, times the
    Hubble distance."""
    dz = z / steps

    def part(i: Column) -> Column:
        a = 1 + i * dz
        return dz / F.sqrt(OMEGA_M * a * a * a + OMEGA_L)

    return F.lit(HUBBLE_DISTANCE) * F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), part), F.lit(0.0), lambda x, y: x + y)


def cone_contains(p: Vector, apex: Vector, axis: Vector, cos_angle: float) -> Column:
    """Point inside a cone (F13): along the axis and within the angle."""
    d = sub(p, apex)
    along = dot(d, axis)
    return (along >= 0) & (along * along >= F.lit(cos_angle * cos_angle) * dot(axis, axis) * dot(d, d))


def lanczos(x: Column, lobes: int) -> Column:
    """Windowed sinc sinc(x) * sinc(x / lobes), 0 from ``lobes`` on."""
    a = x * math.pi
    b = a / lobes
    return F.when(F.abs(x) >= lobes, 0.0).when(a == 0, 1.0).otherwise(F.sin(a) / a * F.sin(b) / b)
