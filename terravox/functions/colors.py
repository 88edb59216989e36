"""Colour expressions (F3, F17-F19, F23 of SURVEY 2.3): channels are columns from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luma weights of the two colour conventions in use.
LUMA = (0.299, 0.587, 0.114)
LUMA_SHORT = (0.3, 0.59, 0.11)


def clamp_round(value: Column) -> Column:
    """Clamp to a byte and round half up."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("short")


def luma(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = LUMA) -> Column:
    return r * weights[0] + g * weights[1] + b * weights[2]


def masked(channels: tuple[Column, Column, Column], mask: tuple[float, float, float]) -> list[Column]:
    """Channels times a mask, clamped and rounded."""
    return [clamp_round(c * m) for c, m in zip(channels, mask, strict=True)]


def truncated(value: Column) -> Column:
    """To a whole number, as a conversion from a floating point number in 0 to 255 does it."""
    return F.floor(value).cast("short")


# Parts of the luma in the red, green and blue of ground (brown) and of vegetation (green).
GROUND, VEGETATION = (0.5, 0.333, 0.0), (0.0, 1.0, 0.0)
#: Fixed value: luma at which a selected point counts as bright.
BRIGHT = 127.5


def ground_colour(value: Column, ground: Column) -> list[Column]:
    """Brown for ground, green for vegetation, as bright as the luma ``value``."""
    return [truncated(F.when(ground, value * a).otherwise(value * b) + 0.5) if a or b else F.lit(0).cast("short") for a, b in zip(GROUND, VEGETATION, strict=True)]


def highlight(value: Column) -> list[Column]:
    """Selection colour (F19): a green that a dark point brightens, and on bright points a light green."""
    bright = value >= BRIGHT
    side = truncated(F.when(bright, value - BRIGHT).otherwise(0.0))
    return [side, truncated(F.when(bright, 255.0).otherwise(value + BRIGHT)), side]


def ramp(value: Column, stops: list[tuple[float, tuple[float, float, float]]], convert=clamp_round) -> list[Column]:
    """Piecewise linear colour between stops of ascending value; the end colours hold beyond them."""
    out = []
    for k in range(3):
        c = F.lit(stops[0][1][k])
        for (v0, c0), (v1, c1) in zip(stops, stops[1:], strict=False):
            c = F.when(value >= v0, (F.least(value, F.lit(v1)) - v0) * (c1[k] - c0[k]) / (v1 - v0) + c0[k]).otherwise(c)
        out.append(convert(c))
    return out


# Depths (F17) and their colours, linear in between; below the first its colour holds.
BATHYMETRY = [(-1575.0, (0.0, 0.0, 64.0)), (-1050.0, (0.0, 0.0, 255.0)), (-525.0, (0.0, 160.0, 255.0)), (0.0, (240.0, 255.0, 255.0))]
# Damage levels (F23) below which a colour (0 to 1) holds; red is the least level. From the last on it's the last colour.
DAMAGE = [(2.5, (1.0, 0.0, 0.0)), (3.5, (1.0, 0.5, 0.0)), (4.5, (0.5, 1.0, 0.0)), (5.5, (0.0, 1.0, 0.0))]


def bathymetry(depth: Column) -> list[Column]:
    """Colour of a height below zero."""
    return ramp(depth, BATHYMETRY, truncated)


def category_colour(level: Column) -> list[Column]:
    """Colour of a damage level, channels from 0 to 1."""
    out = []
    for k in range(3):
        c = F.lit(DAMAGE[-1][1][k])
        for below, colour in reversed(DAMAGE):
            c = F.when(level < below, colour[k]).otherwise(c)
        out.append(c)
    return out
