"""Raster colouring and ground classification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.functions.colors import clamp_round
from terravox.operators import blocks
from terravox.operators.spatial import _side, capsule_join


def image_footprints(images: DataFrame) -> DataFrame:
    """Images (img_id, a, d, b, e, c, f, width, height; world x = a u + b v + c, y = d u + e v + f) with the bounds
    of their pixel centres in the world."""
    corners = [(F.lit(0.0), F.lit(0.0)), (F.col("width") - 1, F.lit(0.0)), (F.lit(0.0), F.col("height") - 1), (F.col("width") - 1, F.col("height") - 1)]
    xs = [F.col("a") * u + F.col("b") * v + F.col("c") for u, v in corners]
    ys = [F.col("d") * u + F.col("e") * v + F.col("f") for u, v in corners]
    return images.withColumns({"min_x": F.least(*xs), "max_x": F.greatest(*xs), "min_y": F.least(*ys), "max_y": F.greatest(*ys)})


def _in_cells(footprints: DataFrame, width: float) -> DataFrame:
    """A row for every cell of the plane that a footprint (min_x ... max_y) touches."""
    cell = lambda c: F.floor(F.col(c) / width)
    out = footprints.withColumn("__cx", F.explode(F.sequence(cell("min_x"), cell("max_x"))))
    return out.withColumn("__cy", F.explode(F.sequence(cell("min_y"), cell("max_y"))))


def _mean_extent(footprints: DataFrame) -> float:
    """Cells as wide as footprints are on average: few cells for an image, few images in a cell."""
    got = footprints.agg(F.avg(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")))).first()[0]
    return float(got) if got and got > 0 else 1.0


def node_images(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """(node_key, img_id) of nodes (with min_x, min_y and edge) and the images whose footprints overlap them."""
    f = image_footprints(images).select("img_id", "min_x", "max_x", "min_y", "max_y")
    width = _mean_extent(f)
    nodes = boxes.select("node_key", F.col("min_x").alias("nx0"), (F.col("min_x") + F.col("edge")).alias("nx1"), F.col("min_y").alias("ny0"), (F.col("min_y") + F.col("edge")).alias("ny1"))
    # Each image in its cells against nodes in theirs; nodes far larger than images go by the images' own bounds instead.
    bounds = f.agg(F.min("min_x"), F.max("max_x"), F.min("min_y"), F.max("max_y")).first()
    if bounds[0] is None:
        return nodes.select("node_key", F.lit(None).cast(images.schema["img_id"].dataType).alias("img_id")).limit(0)
    x0, x1, y0, y1 = (float(v) for v in bounds)
    clipped = nodes.where((F.col("nx0") <= x1) & (F.col("nx1") >= x0) & (F.col("ny0") <= y1) & (F.col("ny1") >= y0))
    cells = clipped.select("*", F.greatest("nx0", F.lit(x0)).alias("min_x"), F.least("nx1", F.lit(x1)).alias("max_x"), F.greatest("ny0", F.lit(y0)).alias("min_y"), F.least("ny1", F.lit(y1)).alias("max_y"))
    pairs = _in_cells(cells, width).drop("min_x", "max_x", "min_y", "max_y").join(_in_cells(f, width), ["__cx", "__cy"])
    overlap = (F.col("nx0") <= F.col("max_x")) & (F.col("nx1") >= F.col("min_x")) & (F.col("ny0") <= F.col("max_y")) & (F.col("ny1") >= F.col("min_y"))
    return pairs.where(overlap).select("node_key", "img_id").distinct()


def raster_colour(points: DataFrame, images: DataFrame, pixels: DataFrame, id_column: str = "id") -> DataFrame:
    """Points with r, g, b from the first image (by img_id) they fall on, interpolated between four pixels; points on
    no image keep their own. ``img_id`` is null for those. Points meet images in cells of the plane, pixels are joined on
    image, column and row."""
    i = image_footprints(images)
    width = _mean_extent(i)
    i = _in_cells(i.select("img_id", "width", "height", "min_x", "max_x", "min_y", "max_y", *[F.col(k).alias(f"__{k}") for k in "adbecf"]), width)
    a, d, b, e, c, f = (F.col(f"__{k}") for k in "adbecf")
    det, dx, dy = a * e - b * d, F.col("x") - c, F.col("y") - f
    located = points.select(id_column, "x", "y").withColumns({"__cx": F.floor(F.col("x") / width), "__cy": F.floor(F.col("y") / width)})
    hits = located.join(i, ["__cx", "__cy"]).withColumn("u", (e * dx - b * dy) / det).withColumn("v", (a * dy - d * dx) / det)
    hits = hits.where((F.col("u") >= 0) & (F.col("u") < F.col("width") - 1) & (F.col("v") >= 0) & (F.col("v") < F.col("height") - 1))
    first = hits.groupBy(id_column).agg(F.min(F.struct("img_id", "u", "v")).alias("__k")).select(id_column, "__k.*")
    corners = F.explode(F.array(*[F.struct((F.floor("u") + i).alias("col"), (F.floor("v") + j).alias("row"), ((F.col("u") - F.floor("u") if i else 1 - F.col("u") + F.floor("u")) * (F.col("v") - F.floor("v") if j else 1 - F.col("v") + F.floor("v"))).alias("w")) for i in (0, 1) for j in (0, 1)]))
    parts = first.select(id_column, "img_id", corners.alias("k")).select(id_column, "img_id", "k.*")
    px = pixels.select("img_id", F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"), *[F.col(c).alias(f"p{c}") for c in "rgb"])
    colours = parts.join(px, ["img_id", "col", "row"]).groupBy(id_column).agg(F.first("img_id").alias("img_id"), *[clamp_round(F.sum(F.col("w") * F.col(f"p{c}"))).alias(f"n{c}") for c in "rgb"])
    out = points.join(colours, id_column, "left")
    return out.select(*[c for c in points.columns if c not in "rgb"], "img_id", *[F.coalesce(f"n{c}", F.col(c)).cast("short").alias(c) for c in "rgb"])


def coloured_count(coloured: DataFrame) -> DataFrame:
    """How many points have a colour from an image."""
    return coloured.agg(F.count("img_id").alias("n"))


def below_counts(cloud: DataFrame, radius: float, tolerance: float, id_column: str = "id") -> DataFrame:
    """(qid, below): points in the capsule below each point."""
    found = capsule_join(cloud, cloud, radius, tolerance, id_column).groupBy("qid").agg(F.count("*").alias("below"))
    return cloud.select(F.col(id_column).alias("qid")).join(found, "qid", "left").select("qid", F.coalesce("below", F.lit(0)).alias("below"))


def _capsules(cloud: DataFrame, radius: float, tolerance: float, max_angle: float, id_column: str, ordered: bool) -> DataFrame:
    """(qid, ground) of a sweep of the points below every point. The span of the directions to them only grows, so a point
    is settled as soon as it reaches ``max_angle``, mostly after few of them."""
    below, above = np.array([radius, radius, np.inf]), np.array([radius, radius, max(0.0, -tolerance)])
    sectors = max(8, 2 * math.ceil(360 / (360 - max_angle))) if max_angle < 360 else 8

    def begin(q: pa.Table) -> dict:
        p = blocks.xyz(q)
        state = {"qid": q.column("qid").combine_chunks(), "p": p, "open": blocks.close_groups(p), "ground": np.ones(len(p), bool)}
        if ordered:
            return state | {"first": np.full(len(p), np.nan), "least": np.zeros(len(p)), "most": np.zeros(len(p))}
        return state | {"least": np.full((len(p), sectors), np.inf), "most": np.full((len(p), sectors), -np.inf)}

    def hits(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries and points in the capsules below them but not straight below, and the directions."""
        dx, dy = p[None, :, 0] - q[:, None, 0], p[None, :, 1] - q[:, None, 1]
        r2 = dx * dx + dy * dy
        row, col = np.nonzero(r2 <= radius * radius)
        top = q[row, 2] - tolerance - radius
        dz = p[col, 2] - top
        good = ((p[col, 2] <= top) | (r2[row, col] + dz * dz <= radius * radius)) & ((dx[row, col] != 0) | (dy[row, col] != 0))
        row, col = row[good], col[good]
        return row, col, np.arctan2(dy[row, col], dx[row, col])

    def widest(state: dict, own: np.ndarray) -> np.ndarray:
        """Spans by the least and greatest direction in each sector: a gap inside one is too narrow to matter."""
        least, most = state["least"][own], state["most"][own]
        before = np.maximum.accumulate(most, axis=1)
        gap = np.where(np.isfinite(least[:, 1:]) & np.isfinite(before[:, :-1]), least[:, 1:] - before[:, :-1], 0.0).max(axis=1)
        return 360 - np.maximum(gap, (360 - before[:, -1]) + least.min(axis=1))

    def take(state: dict, own: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Take points into the state of some queries; spans, nan without a direction."""
        row, _, angle = hits(state["p"][own], p)
        if not ordered:
            angle = np.degrees(angle)
            sector = np.clip(np.floor((angle + 180) / 360 * sectors).astype(np.int64), 0, sectors - 1)
            np.minimum.at(state["least"], (own[row], sector), angle)
            np.maximum.at(state["most"], (own[row], sector), angle)
            return widest(state, own)
        found, at = np.unique(row, return_index=True)  # rows are ascending, and so are the points of each
        new = np.isnan(state["first"][own[found]])
        state["first"][own[found[new]]] = angle[at[new]]
        off = angle - state["first"][own[row]]
        turn = np.degrees(np.arctan2(np.sin(off), np.cos(off)))
        np.minimum.at(state["least"], own[row], turn)
        np.maximum.at(state["most"], own[row], turn)
        return state["most"][own] - state["least"][own]

    def feed(state: dict, points: np.ndarray) -> None:
        first, size = 0, 64
        while first < len(points) and state["open"]:
            some, still = points[first : first + size], []
            for own in state["open"]:
                near = some[blocks.within(some, state["p"][own], below, above)]
                for k in range(0, len(near), blocks.PAIRS // len(own)):
                    span = take(state, own, near[k : k + blocks.PAIRS // len(own)])
                    state["ground"][own[span >= max_angle]] = False
                    own = own[~(span >= max_angle)]
                    if not len(own):
                        break
                if len(own):
                    still.append(own)
            first, size = first + size, min(4 * size, 8192)
            if len(still) < len(state["open"]) or sum(map(len, still)) < 64 * len(still):  # few are left in most groups
                left = np.concatenate(still) if still else np.empty(0, np.int64)
                still = [left[g] for g in blocks.close_groups(state["p"][left])] if len(left) else []
            state["open"] = still

    def end(state: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([state["qid"], pa.array(state["ground"])], ["qid", "ground"])

    rows = _side(cloud, id_column, "qid")
    placed = rows.where(blocks.finite("x", "y", "z"))
    swept = blocks.sweep(placed, placed, below, above, begin, feed, end, f"qid {rows.schema['qid'].dataType.simpleString()}, ground boolean", ["qid"] if ordered else [])
    return swept.unionByName(rows.where(~blocks.finite("x", "y", "z")).select("qid", F.lit(True).alias("ground")))


def classify_ground(cloud: DataFrame, radius: float = 1.0, tolerance: float = 0.0, max_angle: float = 270.0, id_column: str = "id") -> DataFrame:
    """(qid, ground): a point is ground unless points in the capsule below it surround it: the directions to them,
    projected to the horizontal, span more than ``max_angle`` degrees (360 less the widest gap between neighbouring
    directions, whatever their order). Points straight below span nothing."""
    return _capsules(cloud, radius, tolerance, max_angle, id_column, ordered=False)


def ordered_ground(cloud: DataFrame, radius: float = 1.0, tolerance: float = 0.0, max_angle: float = 270.0, id_column: str = "id") -> DataFrame:
    """A18 in its order-dependent form: points below are taken by ascending id; the first gives the axis, each further one
    extends the widest angle on its side; ground while the two angles together stay below ``max_angle`` degrees."""
    return _capsules(cloud, radius, tolerance, max_angle, id_column, ordered=True)
