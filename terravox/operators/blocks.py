"""Searches by blocks of points, for joins whose pairs are too many to be rows.

Space is cut by a k-d tree into blocks with about as many queries each. Every block gets the points that its queries can
reach, once, and one task goes through them in batches; only what a query needs of its pairs is kept. The tree comes from
a sample of the points and decides the layout only, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of the sample for each block, and the most blocks of a tree.
SAMPLED, MOST_BLOCKS = 32, 1 << 15
#: Queries of a block of a sweep, while there are no more than so many blocks; then blocks grow, so that the copies of a
#: point don't.
SWEPT, SWEEPS = 2048, 256
#: Points of a block in which nearest neighbours are searched.
MET = 1024
#: Pairs that are looked at together: half a megabyte of doubles, which stays in the cache.
PAIRS = 1 << 16


class Tree(NamedTuple):
    """A balanced k-d tree in heap order: node n has the children 2 n and 2 n + 1; rows with a coordinate above ``at`` on
    ``axis`` go to the second. The leaves are the blocks."""

    axis: np.ndarray
    at: np.ndarray

    @property
    def blocks(self) -> int:
        return len(self.axis)

    def block(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), np.int64)
        rows = np.arange(len(p))
        while node.size and node[0] < self.blocks:
            node = 2 * node + (p[rows, self.axis[node]] > self.at[node])
        return node - self.blocks


def tree(sample: np.ndarray, blocks: int) -> Tree:
    """A tree of at least so many blocks (a power of two) that halves the sample on its widest axis again and again."""
    size = 1 << max(0, blocks - 1).bit_length()
    axis, at = np.zeros(size, np.int64), np.zeros(size)
    parts = {1: np.asarray(sample, float).reshape(-1, 3)}
    for node in range(1, size):
        p = parts.pop(node)
        if len(p):
            axis[node] = np.argmax(np.ptp(p, axis=0))
            v = p[:, axis[node]]
            at[node] = np.partition(v, (len(p) - 1) // 2)[(len(p) - 1) // 2]
            if at[node] == v.max() and (v < at[node]).any():
                at[node] = v[v < at[node]].max()  # ties: neither side stays empty
        if 2 * node < size:
            above = p[:, axis[node]] > at[node]
            parts[2 * node], parts[2 * node + 1] = p[~above], p[above]
    return Tree(axis, at)


def finite(*columns: str) -> Column:
    """Rows that have a place: neither null nor NaN."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return out


def sampled_tree(cloud: DataFrame, size: int, most: int) -> Tree:
    """The tree of a cloud (x, y, z) with about ``size`` points a block, and at most so many blocks."""
    n = cloud.count()
    blocks = min(most, max(1, -(-n // size)))
    rows = cloud.select("x", "y", "z") if n <= blocks * SAMPLED else cloud.select("x", "y", "z").sample(blocks * SAMPLED / n, 7)
    return tree(xyz(rows.toArrow()) if blocks > 1 else np.empty((0, 3)), blocks)


def xyz(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() if isinstance(batch, pa.Table) else batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz"], axis=1)


def with_blocks(cloud: DataFrame, layout: Tree) -> DataFrame:
    """Rows with the number of their block as ``block``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(layout.block(xyz(b)), pa.int64())], [*b.schema.names, "block"])

    return cloud.mapInArrow(add, f"{_ddl(cloud)}, block bigint")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _slack(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """More than the rounding of a bound can be."""
    return 1e-9 * (np.abs(low) + np.abs(high)) + 1e-300


def sweep(queries: DataFrame, points: DataFrame, below: Sequence[float], above: Sequence[float], begin: Callable, feed: Callable, end: Callable, schema: str, order: Sequence[str] = ()) -> DataFrame:
    """For each block of ``queries`` (x, y, z and more): ``begin`` (their columns) makes a state, ``feed`` (state, points)
    takes the points of a batch that lie at most ``below`` and ``above`` the block's bounds on each axis, and ``end``
    (state) gives columns of ``schema``. Points come in the ``order`` of their columns, which queries have too."""
    below, above = np.array(below, float), np.array(above, float)
    layout = sampled_tree(queries, SWEPT, SWEEPS)
    placed = with_blocks(queries, layout)
    bounds = placed.groupBy("block").agg(*[f(c) for f in (F.min, F.max) for c in "xyz"]).collect()
    blocks = np.array([r[0] for r in bounds], np.int64)
    box = np.array([r[1:] for r in bounds], float).reshape(-1, 6)
    slack = _slack(box[:, :3], box[:, 3:]) + 1e-9 * np.where(np.isfinite(below + above), below + above, 0)
    low, high = box[:, :3] - below - slack, box[:, 3:] + above + slack
    columns = points.columns

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = xyz(b)
            for first in range(0, len(p), 4096):
                some = p[first : first + 4096]
                inside = np.ones((len(some), len(blocks)), bool)
                for k in range(3):
                    inside &= (some[:, k, None] >= low[None, :, k]) & (some[:, k, None] <= high[None, :, k])
                row, block = np.nonzero(inside)
                taken = b.take(pa.array(row + first))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(blocks[block], pa.int64())], [*columns, "block"])

    copies = points.mapInArrow(reached, f"{_ddl(points)}, block bigint")
    rows = placed.withColumn("is_point", F.lit(False)).unionByName(copies.withColumn("is_point", F.lit(True)), allowMissingColumns=True)
    # A number of partitions that is named is kept: blocks are few bytes and much work.
    rows = rows.repartition(max(1, len(blocks)), "block").sortWithinPartitions("block", "is_point", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, state, waiting = None, None, []
        for b in batches:
            if not b.num_rows:
                continue
            key = 2 * b.column("block").to_numpy() + b.column("is_point").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for start, stop in zip(edges, edges[1:], strict=False):
                part = b.slice(start, stop - start)
                if block != key[start] // 2:
                    if block is not None:
                        yield end(begin(pa.Table.from_batches(waiting)) if state is None else state)
                    block, state, waiting = key[start] // 2, None, []
                if key[start] % 2:
                    state = begin(pa.Table.from_batches(waiting)) if state is None else state
                    feed(state, xyz(part))
                else:
                    waiting.append(part)
        if block is not None:
            yield end(begin(pa.Table.from_batches(waiting)) if state is None else state)

    return rows.mapInArrow(run, schema)


def close_groups(p: np.ndarray, size: int = 128) -> list[np.ndarray]:
    """Indices of points in groups of at most ``size`` that lie close together."""
    done, todo = [], [np.arange(len(p))]
    while todo:
        some = todo.pop()
        if len(some) <= size:
            done.append(some)
            continue
        axis = int(np.argmax(np.ptp(p[some], axis=0)))
        order = np.argpartition(p[some, axis], len(some) // 2)
        todo += [some[order[: len(some) // 2]], some[order[len(some) // 2 :]]]
    return done


def within(p: np.ndarray, q: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Indices of the points p that lie at most so far below and above the bounds of q."""
    low, high = q.min(axis=0), q.max(axis=0)
    slack = _slack(low, high) + 1e-9 * np.where(np.isfinite(below + above), below + above, 0)
    return np.flatnonzero(((p >= low - below - slack) & (p <= high + above + slack)).all(axis=1))


class Boxes(NamedTuple):
    """Bounds of the points below every node of a tree, in heap order, and how many each block has."""

    low: np.ndarray
    high: np.ndarray
    n: np.ndarray

    def reached(self, q: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of q and the blocks whose bounds lie at most the root of ``d2`` away, from the root of the tree down."""
        row, node = np.arange(len(q)), np.ones(len(q), np.int64)
        leaves = len(self.low) // 2
        while True:
            gap = np.maximum(0.0, np.maximum(self.low[node] - q[row], q[row] - self.high[node]))
            near = gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2] <= d2[row]
            row, node = row[near], node[near]
            if not len(node) or node[0] >= leaves:
                return row, node - leaves
            row, node = np.repeat(row, 2), np.stack([2 * node, 2 * node + 1], axis=1).ravel()

    def surely(self, q: np.ndarray, number: int) -> float:
        """A squared distance within which q has so many points, by the farthest corners of the blocks."""
        leaves = len(self.low) // 2
        some = np.flatnonzero(self.n)
        far = np.maximum(q - self.low[leaves:][some], self.high[leaves:][some] - q)
        d2 = (far * far).sum(axis=1) * (1 + 1e-9)
        order = np.argsort(d2)
        enough = np.flatnonzero(np.cumsum(self.n[some][order]) >= number)
        return float(d2[order[enough[0]]]) if len(enough) else np.inf


def boxes(placed: DataFrame, layout: Tree) -> Boxes:
    size = layout.blocks
    low, high, n = np.full((2 * size, 3), np.inf), np.full((2 * size, 3), -np.inf), np.zeros(size, np.int64)
    for r in placed.groupBy("block").agg(F.count("*"), *[f(c) for f in (F.min, F.max) for c in "xyz"]).collect():
        n[r[0]], low[size + r[0]], high[size + r[0]] = r[1], r[2:5], r[5:8]
    for node in range(size - 1, 0, -1):
        low[node], high[node] = np.minimum(low[2 * node], low[2 * node + 1]), np.maximum(high[2 * node], high[2 * node + 1])
    return Boxes(low, high, n)


def nearest(q: np.ndarray, p: np.ndarray, k: int, bound: np.ndarray, barred: Callable | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q and p and their squared distances: the k nearest p of each q not farther than the root of ``bound``,
    nearest first, ties by place in p. ``barred`` (first and last row of q, d2) says which pairs don't count."""
    out = []
    step = max(1, PAIRS // max(1, len(p)))
    for first in range(0, len(q) if len(p) else 0, step):
        some = q[first : first + step]
        dx, dy, dz = (some[:, axis, None] - p[None, :, axis] for axis in range(3))
        d2 = dx * dx + dy * dy + dz * dz
        good = d2 <= bound[first : first + step, None]
        if barred is not None:
            good &= ~barred(first, first + len(some), d2)
        if len(p) > k:
            good &= d2 <= np.partition(np.where(good, d2, np.inf), k - 1, axis=1)[:, k - 1, None]
        row, col = np.nonzero(good)
        order = np.lexsort((col, d2[row, col], row))
        row, col = row[order], col[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[rank < k], col[rank < k]
        out.append((row + first, col, d2[row, col]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
