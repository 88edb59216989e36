"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (what stands between line breaks; a long one counts as several of PARAGRAPH_WORDS words, counted from
its start) are digested; each digest goes to three cells of a small table that keep a
count, the sum of the digests and the sum of their checks. Two versions' tables are subtracted cell by cell; what they
share cancels, and peeling cells that hold one digest recovers the digests that differ and on which side they are. A
table too small for the difference shows that by not peeling to zero and is built again twice as large.

Tables of all texts of a batch lie in one array, so that building, subtracting and peeling are a few NumPy calls.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravox.llm.words import SPACED, _powers_to, chunks, give_back, mix, words
from terravox.plans.storage import bound_batches, cut

#: Cells of a fingerprint; each retry doubles them. A multiple of three.
CELLS = 24
#: Words of the longest paragraph that has one digest.
PARAGRAPH_WORDS = 32
_RAW = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_LOW = np.uint64(0xFFFFFFFF)


class Digests(NamedTuple):
    keys: np.ndarray  #: digests, text by text, distinct in each text
    of: np.ndarray  #: text of each
    n: np.ndarray  #: digests of each text


def paragraph_digests(texts: pa.Array) -> Digests:
    """A digest for each paragraph of each text; a repeated paragraph counts with the number of its repetition."""
    keys, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi, data, off in chunks(texts):
        w = words(data, off, SPACED)
        n = len(w.hashes)
        heads = np.zeros(n + 1, bool)
        heads[w.first] = True
        if n:
            lines = np.cumsum((data == 10) | (data == 13))
            heads[1:n] |= lines[w.start[1:]] > lines[w.end[:-1] - 1]
        paragraph = np.flatnonzero(heads[:n])
        place = np.arange(n) - np.repeat(paragraph, np.diff(np.append(paragraph, n)))
        start = np.flatnonzero(place % PARAGRAPH_WORDS == 0)
        units = np.searchsorted(start, w.first)
        a, b = w.start[start], w.end[np.append(start[1:], n)[: len(start)] - 1]
        power, inverse = _powers_to(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RAW[data] * power[: len(data)], out=total[1:])
        h = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        t = np.repeat(np.arange(hi - lo), np.diff(units))
        order = np.lexsort((h, t))
        fresh = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (t[order][1:] != t[order][:-1]))) if len(h) else np.zeros(0, bool)
        nth = np.arange(len(h)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(h) else np.zeros(0, np.int64)
        keys.append(mix(h[order] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        of.append(t[order] + lo)
    k, t = np.concatenate(keys), np.concatenate(of)
    return Digests(k, t, np.bincount(t, minlength=len(texts)))


class Tables(NamedTuple):
    count: np.ndarray  #: each of shape (texts, cells)
    keys: np.ndarray
    checks: np.ndarray


def _cells(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    part = cells // 3
    return [(mix(keys + np.uint64((s * 7 + cells) * 0x2545F4914F6CDD1D % (1 << 64))) % np.uint64(part)).astype(np.int64) + s * part for s in range(3)]


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0x6A09E667F3BCC909)) & _LOW


def _add_up(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums modulo 2**64; the halves of the values add up exactly in double precision."""
    low = np.bincount(at, (values & _LOW).astype(float), size).astype(np.uint64)
    return low + (np.bincount(at, (values >> np.uint64(32)).astype(float), size).astype(np.uint64) << np.uint64(32))


def build(keys: np.ndarray, of: np.ndarray, texts: int, cells: int) -> Tables:
    """The tables of so many texts."""
    at = np.concatenate([of * cells + c for c in _cells(keys, cells)])
    k3, size, shape = np.concatenate([keys] * 3), texts * cells, (texts, cells)
    return Tables(np.bincount(at, minlength=size).reshape(shape), _add_up(at, k3, size).reshape(shape), _add_up(at, _check(k3), size).reshape(shape))


def subtract(a: Tables, b: Tables) -> Tables:
    return Tables(a.count - b.count, a.keys - b.keys, a.checks - b.checks)


def peel(difference: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which texts' tables peel to zero, and of the recovered digests: text, digest, side (1 or -1)."""
    texts, cells = difference.count.shape
    count, keys, checks = (x.reshape(-1).copy() for x in difference)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.flatnonzero(np.abs(count) == 1)
    while len(look):
        side = count[look]
        k = np.where(side > 0, keys[look], np.uint64(0) - keys[look])
        c = np.where(side > 0, checks[look], np.uint64(0) - checks[look])
        pure = c == _check(k)
        t, k, side = look[pure] // cells, k[pure], side[pure]
        if not len(t):
            break
        order = np.lexsort((k, t))
        t, k, side = t[order], k[order], side[order]
        once = np.concatenate(([True], (k[1:] != k[:-1]) | (t[1:] != t[:-1])))
        t, k, side = t[once], k[once], side[once]
        found.append((t, k, side))
        at = np.concatenate([t * cells + x for x in _cells(k, cells)])
        s3 = np.concatenate([side] * 3)
        signed = lambda v: np.where(s3 > 0, np.concatenate([v] * 3), np.uint64(0) - np.concatenate([v] * 3))
        np.subtract.at(count, at, s3)
        np.subtract.at(keys, at, signed(k))
        np.subtract.at(checks, at, signed(_check(k)))
        look = np.unique(at)
        look = look[np.abs(count[look]) == 1]
    empty = ((count == 0) & (keys == 0) & (checks == 0)).reshape(texts, cells).all(axis=1)
    t, k, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return empty, t, k, s


def differences(a: Digests, b: Digests, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of texts, how many digests only the first and only the second has. Pairs whose tables don't peel
    are tried again with tables twice as large, as often as it takes."""
    n = len(a.n)
    only_a, only_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.arange(n)
    while len(left):
        number = np.full(n, -1)
        number[left] = np.arange(len(left))
        step = max(1, 4_000_000 // cells)
        failed = []
        for lo in range(0, len(left), step):
            some = left[lo : lo + step]
            sides = [build(d.keys[m], number[d.of[m]] - lo, len(some), cells) for d in (a, b) for m in [(number[d.of] >= lo) & (number[d.of] < lo + len(some))]]
            done, t, _, side = peel(subtract(*sides))
            only_a[some] = np.bincount(t, side > 0, len(some)).astype(np.int64)
            only_b[some] = np.bincount(t, side < 0, len(some)).astype(np.int64)
            failed.append(some[~done])
        left = np.concatenate(failed)
        cells *= 2
    return only_a, only_b


def likeness(a: Digests, b: Digests) -> np.ndarray:
    """Twice the shared digests over all digests of both, from the recovered differences; 1 for two empty texts."""
    only_a, only_b = differences(a, b)
    total = a.n + b.n
    return np.where(total > 0, (total - only_a - only_b) / np.maximum(total, 1), 1.0)


def written(d: Digests, texts: int) -> list[bytes]:
    """Fingerprints: of every cell the count (2 bytes), digest sum (8) and check sum (4)."""
    t = build(d.keys, d.of, texts, CELLS)
    raw = np.empty((texts, CELLS), [("n", ">u2"), ("k", ">u8"), ("c", ">u4")])
    raw["n"], raw["k"], raw["c"] = t.count & 0xFFFF, t.keys, t.checks & _LOW
    return [r.tobytes() for r in raw]


def _as_text(column: str) -> Column:
    return F.lower(F.hex(column)).alias(column)


def fingerprints(docs: DataFrame, text_column: str = "text", to: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text in hexadecimal, as the column ``to`` (replaced if it is there).

    Null counts as empty, an empty text has empty cells, and equal texts have equal fingerprints; a text of any length is
    read whole; all other columns and repeated rows stay; an empty table gives no rows."""
    bound_batches(docs.sparkSession)
    own = F.arrow_udf(lambda t: pa.array(written(paragraph_digests(t), len(t)), pa.binary()), "binary")
    return docs.withColumn(to, F.lower(F.hex(own(F.col(f"`{text_column}`").cast("string")))))


_OF_PAIR = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_OF_PAIR_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_VERSIONS = pa.schema([*_OF_PAIR, ("kind", pa.int32()), ("part", pa.int64()), ("text", pa.string())])
_DONE, _FIRST, _LAST = 0, 1, 2
#: Code points of text that are handled at a time (or two rows).
_STEP_CHARS = 2 << 20


def _against(ids: list, own: list[str], after: list[str]) -> list:
    """The columns of rows (id, text) with the text after each."""
    edited = [a[: len(a) - len(a) // 3] + b[: len(a) // 3] for a, b in zip(own, after, strict=True)]
    d, e, x = (paragraph_digests(pa.array(t, pa.string())) for t in (own, edited, after))
    n = len(own)
    columns = [ids, [len(t) for t in own], [sha256(t.encode()).hexdigest() for t in edited], written(d, n), written(e, n), likeness(d, e), likeness(d, x)]
    return [pa.array(c, t) for c, (_, t) in zip(columns, _OF_PAIR, strict=True)]


def _edge(kind: int, part: int, doc_id: int | None, text: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"kind": kind, "part": part, "doc_id": doc_id, "text": text}], _VERSIONS)


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) in order: each against the one after it. The text of the partition's first row and its last row,
    which has no successor here, come as rows of their own kinds."""
    part = TaskContext.get().partitionId()
    ids: list = []
    texts: list[str] = []
    chars, begun = 0, False

    def handed_out() -> pa.RecordBatch:
        """All rows but the last, whose successor isn't known yet."""
        nonlocal ids, texts, chars
        n = len(ids) - 1
        columns = _against(ids[:-1], texts[:-1], texts[1:])
        give_back()
        ids, texts = ids[-1:], texts[-1:]
        chars = len(texts[0])
        return pa.RecordBatch.from_arrays([*columns, pa.array([_DONE] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], schema=_VERSIONS)

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not begun:
                begun = True
                yield _edge(_FIRST, part, None, t)
            ids.append(i)
            texts.append(t)
            chars += len(t)
            if chars >= _STEP_CHARS and len(ids) > 1:
                yield handed_out()
    if len(ids) > 1:
        yield handed_out()
    if begun:
        yield _edge(_LAST, part, ids[0], texts[0])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays(_against(*(b.column(k).to_pylist() for k in ("doc_id", "text", "after"))), [n for n, _ in _OF_PAIR])


def version_fingerprints(docs: DataFrame, bucket_bytes: int = 32 << 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For every row: ``doc_id``, ``n_chars``, the SHA-256 of its edited text (the last third of its code points replaced
    by as many of the first of the next row), both fingerprints, and the likeness of its fingerprint to those of the
    edited text and of the next row.

    Ids are whole numbers. The next row is the next by descending id (null ids last; rows of one id by a hash of their
    text), after the last the first; a table of one row is its own next, an empty one gives no rows. Null texts count as
    empty; two empty texts are alike (1.0); repeated rows follow each other. Texts of any length are read whole, other
    columns ignored. Rows go to ranges of the order in one shuffle, as many as the bytes of text ask for; every range
    leaves its own rows' results and the texts at its two ends, from which the rows between two ranges are made.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    amount = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Rows that agree in id and text may stand in any order, so the input's partition may spread them.
    order = [F.desc_nulls_last("doc_id"), F.desc("h"), F.asc("source")]
    ranged = rows.withColumn("h", F.xxhash64("text")).withColumn("source", F.spark_partition_id()).repartitionByRange(amount // bucket_bytes + 1, *order)
    made = cut(ranged.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_versions, f"{_OF_PAIR_SQL}, kind int, part long, text string"))
    firsts = made.where(F.col("kind") == _FIRST).select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    parts = made.where(F.col("kind") == _FIRST).select("part")  # one number for each range, without texts
    ring = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    lasts = made.where(F.col("kind") == _LAST).select("part", "doc_id", "text")
    between = lasts.join(ring, "part").join(firsts, "next_part").select("doc_id", "text", "after").mapInArrow(_pairs, _OF_PAIR_SQL)
    whole = made.where(F.col("kind") == _DONE).select(*[n for n, _ in _OF_PAIR]).unionByName(between)
    return whole.select("doc_id", "n_chars", "edited_sha256", _as_text("fingerprint"), _as_text("edited_fingerprint"), "near_edited", "near_next")
