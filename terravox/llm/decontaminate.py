"""Benchmark decontamination: a broadcast set of normalised test n-grams is held against every training window.

The words of the benchmark, lower-cased and joined by single blanks, go to every task together with the sorted 64-bit
hashes of their windows, in blocks of at most BLOCK_BYTES of benchmark text (or one longer item): about six times the
text, so what is broadcast has a bound whatever the benchmark's size. A window whose hash is in the set is compared
word by word before it counts. With one block the scan, the verdict and the cut are one pass without a shuffle. With
several, each block is one pass that leaves only the texts it hits, by their MD5; these are joined back once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravox.llm.words import ALNUM, Words, buffers, chunks, free_name, give_back, ngrams, ragged, words
from terravox.plans.storage import bound_batches, cut

#: Words in a window.
WINDOW = 13
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 22
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Plain(NamedTuple):
    """Words in lower case, joined by single blanks, so that every window is one slice."""

    text: bytes
    start: np.ndarray  #: of each word
    end: np.ndarray

    def window(self, at: int, size: int) -> bytes:
        return self.text[self.start[at] : self.end[at + size - 1]]


def plain(data: np.ndarray, w: Words) -> Plain:
    lengths = w.end - w.start + 1
    end = np.cumsum(lengths) - 1
    out = _FOLD[np.append(data, np.uint8(32))[ragged(w.start, lengths)]]
    out[end] = 32
    return Plain(out.tobytes(), (end - lengths + 1).astype(np.uint32), end.astype(np.uint32))


class Block(NamedTuple):
    """Windows of some benchmark items, by number of words: sorted hashes, and for each the place of one such window and
    the items that hold it. Windows that share a hash but not the words stand one after the other."""

    plain: Plain
    hashes: dict[int, np.ndarray]
    place: dict[int, np.ndarray]
    holders: dict[int, tuple[np.ndarray, np.ndarray]]  #: items, and where those of each window begin (and the last's end)
    filters: dict[int, np.ndarray]
    names: list[str]


def build_block(items: list[tuple[str, str]], window: int) -> Block:
    """The windows of items (id, text); an item of fewer words, but not none, is one window."""
    data, off = buffers(pa.array([text for _, text in items], pa.string()))
    data, off = data[off[0] : off[-1]], off - off[0]
    w = words(data, off, ALNUM)
    p = plain(data, w)
    n_words = np.diff(w.first)
    hashes, place, holders, filters = {}, {}, {}, {}
    for size in np.unique(np.minimum(n_words[n_words > 0], window)).tolist():
        grams, at = ngrams(w, size)
        of = np.searchsorted(w.first, at, "right") - 1
        own = n_words[of] == size if size < window else np.ones(len(at), bool)
        grams, at, of = grams[own], at[own], of[own]
        order = np.lexsort((of, grams))
        grams, at, of = grams[order], at[order], of[order]
        kind = np.cumsum(np.concatenate(([False], grams[1:] != grams[:-1])))
        same = np.flatnonzero(grams[1:] == grams[:-1]) + 1
        if any(p.window(at[k], size) != p.window(at[k - 1], size) for k in same.tolist()):  # the hash isn't enough
            by_text = np.array([p.window(a, size) for a in at.tolist()], object)
            order = np.array(sorted(range(len(at)), key=lambda k: (grams[k], by_text[k], of[k])))
            grams, at, of, by_text = grams[order], at[order], of[order], by_text[order]
            kind = np.cumsum(np.concatenate(([False], (grams[1:] != grams[:-1]) | (by_text[1:] != by_text[:-1]))))
        fresh = np.concatenate(([True], (kind[1:] != kind[:-1]) | (of[1:] != of[:-1])))
        first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        hashes[size], place[size] = grams[first], at[first].astype(np.uint32)
        holders[size] = of[fresh].astype(np.uint32), np.searchsorted(kind[fresh], np.arange(len(first) + 1)).astype(np.uint32)
        filters[size] = np.zeros(1 << _FILTER_BITS, bool)
        filters[size][grams >> np.uint64(64 - _FILTER_BITS)] = True
    return Block(p, hashes, place, holders, filters, [i for i, _ in items])


class Scanned(NamedTuple):
    lo: int  #: first text of the chunk
    data: np.ndarray
    off: np.ndarray
    words: Words
    hit: np.ndarray  #: of each word, whether a window covers it
    items: list[set[str]]  #: of each text


def scan(texts: pa.Array, block: Block) -> Iterator[Scanned]:
    """Every chunk of a text column with its hit words and the items found in each text."""
    for lo, hi, data, off in chunks(texts):
        w = words(data, off, ALNUM)
        edges = np.zeros(len(w.hashes) + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(hi - lo)]
        own = None
        for size, known in block.hashes.items():
            grams, at = ngrams(w, size)
            maybe = block.filters[size][grams >> np.uint64(64 - _FILTER_BITS)]
            grams, at = grams[maybe], at[maybe]
            place = np.searchsorted(known, grams)
            found = known[np.minimum(place, len(known) - 1)] == grams
            if found.any() and own is None:
                own = plain(data, w)
            true, kinds = [], []
            for h, i, k in zip(grams[found].tolist(), at[found].tolist(), place[found].tolist(), strict=True):
                while k < len(known) and known[k] == h:
                    if block.plain.window(block.place[size][k], size) == own.window(i, size):
                        true.append(i)
                        kinds.append(k)
                        break
                    k += 1
            if not true:
                continue
            true, kinds = np.array(true), np.array(kinds)
            np.add.at(edges, true, 1)
            np.add.at(edges, true + size, -1)
            of = np.searchsorted(w.first, true, "right") - 1
            holders, bounds = block.holders[size]
            pairs = np.unique(np.stack((of, kinds)), axis=1)
            for t, k in pairs.T.tolist():
                items[t].update(block.names[x] for x in holders[bounds[k] : bounds[k + 1]])
        yield Scanned(lo, data, off, w, np.cumsum(edges)[:-1] > 0, items)


def _blocks(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded size; an item without an id or text has no windows. Only one block is held at a time."""
    rows = benchmark.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(id_column).cast("string").alias("i"), F.col(text_column).cast("string").alias("t")).toLocalIterator()
    held, size = [], 0
    for r in rows:
        held.append((r.i, r.t))
        size += len(r.t.encode())
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    yield held  # the last, which may be empty: words are counted even for an empty benchmark


_HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int32())), ("left", pa.string())])
_HITS_SQL = "n_words long, n_hit long, items array<string>, spans array<int>, left string"


def _spans(flags: np.ndarray) -> list[int]:
    """First word and word after it of every run of hit words."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0])))).tolist() if flags.any() else []


def _without(data: np.ndarray, start: np.ndarray, end: np.ndarray, spans: list[int]) -> str:
    """A text without the words of the spans and what stands between them."""
    kept, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        kept.append(data[at : start[a]].tobytes())
        at = int(end[b - 1])
    return b"".join([*kept, data[at:].tobytes()]).decode()


def _struct(columns: tuple) -> pa.Array:
    give_back()
    return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _HITS, strict=True)], fields=list(_HITS))


def _judged(texts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, set[str]]], percent: int, shorten: bool) -> pa.Array:
    """The struct column for texts given by bytes, word starts, word ends, flags and items."""
    out: tuple[list, ...] = ([], [], [], [], [])
    for data, start, end, flags, items in texts:
        n, hit, spans = len(flags), int(flags.sum()), _spans(flags)
        keep = shorten and hit and not _contaminated(hit, n, percent)
        for column, value in zip(out, (n, hit, sorted(items), spans, _without(data, start, end, spans) if keep else None), strict=True):
            column.append(value)
    return _struct(out)


def _contaminated(n_hit, n_words, percent: int):
    return (n_hit > 0) & (100 * n_hit >= percent * n_words)


def _found(texts: pa.Array, block: Block, percent: int, shorten: bool) -> pa.Array:
    """What one block finds in each text; ``left`` is the text without the hit words where it is wanted."""

    def each():
        for s in scan(texts, block):
            for i, items in enumerate(s.items):
                a, b = s.words.first[i], s.words.first[i + 1]
                yield s.data[s.off[i] : s.off[i + 1]], s.words.start[a:b] - s.off[i], s.words.end[a:b] - s.off[i], s.hit[a:b], items

    return _judged(each(), percent, shorten)


def _together(texts: pa.Array, items: pa.Array, spans: pa.Array, percent: int, shorten: bool) -> pa.Array:
    """The same from the items and spans that several blocks found (null: nothing)."""

    def each():
        for lo, hi, data, off in chunks(texts):
            w = words(data, off, ALNUM)
            for i in range(hi - lo):
                a, b = w.first[i], w.first[i + 1]
                flags = np.zeros(b - a, bool)
                s = spans[lo + i].as_py() or []
                for x, y in zip(s[::2], s[1::2], strict=True):
                    flags[x:y] = True
                yield data[off[i] : off[i + 1]], w.start[a:b] - off[i], w.end[a:b] - off[i], flags, set(items[lo + i].as_py() or ())

    return _judged(each(), percent, shorten)


def _with_hits(docs: DataFrame, text: Column, blocks: Iterator[list[tuple[str, str]]], window: int, percent: int, shorten: bool, name: str) -> DataFrame:
    """``docs`` with the struct of hits as the column ``name``. The functions count as nondeterministic, so that no filter
    on the result is moved below them and makes them run twice."""
    spark, first = docs.sparkSession, next(blocks)
    sent = spark.sparkContext.broadcast(build_block(first, window))
    second = next(blocks, None)
    if second is None:
        return docs.withColumn(name, F.arrow_udf(lambda t: _found(t, sent.value, percent, shorten), _HITS_SQL).asNondeterministic()(text))
    parts = []
    while sent is not None:
        look = F.arrow_udf(lambda t, sent=sent: _found(t, sent.value, percent, False), _HITS_SQL).asNondeterministic()
        hits = docs.select(F.md5(text.cast("binary")).alias("key"), look(text).alias("h")).where("h.n_hit > 0").select("key", "h.items", "h.spans")
        parts.append(cut(hits.groupBy("key").agg(F.first("items").alias("items"), F.first("spans").alias("spans"))))
        sent.destroy()
        sent = None if second is None else spark.sparkContext.broadcast(build_block(second, window))
        second = next(blocks, None)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    key, items, spans = f"{name}_key", f"{name}_items", f"{name}_spans"
    whole = whole.groupBy(F.col("key").alias(key)).agg(F.flatten(F.collect_set("items")).alias(items), F.flatten(F.collect_list("spans")).alias(spans))
    joined = docs.withColumn(key, F.md5(text.cast("binary"))).join(whole, key, "left")
    merge = F.arrow_udf(lambda t, i, s: _together(t, i, s, percent, shorten), _HITS_SQL).asNondeterministic()
    return joined.withColumn(name, merge(text, F.col(items), F.col(spans)))


def contamination(docs: DataFrame, benchmark: DataFrame, remove: str | None = None, window: int = WINDOW, percent: int = 5, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with the benchmark windows found in their texts.

    Adds ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``items`` (sorted ids, as strings, of items
    with occurring windows) and ``contaminated`` (at least one word and ``percent`` per cent of the words hit). With
    ``remove="documents"`` contaminated rows go and nothing is added; with ``remove="spans"`` the hit words leave the
    text instead; with ``remove="both"`` contaminated rows go and hit words leave the other texts. Columns of ``docs``
    that have an added name are replaced, all others stay, whatever their names. Null and empty texts have no words;
    items without id, text or words have no windows; an empty benchmark hits nothing and empty ``docs`` give no rows;
    repeated rows and repeated items are treated alike; a text of any length is scanned whole, in one piece.
    """
    bound_batches(docs.sparkSession)
    names = docs.columns
    hidden = free_name(names, "_hits")
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    docs = _with_hits(docs, text, _blocks(benchmark, item_column, text_column), window, 101 if remove == "spans" else percent, remove in ("spans", "both"), hidden)
    hits = F.col(hidden)
    contaminated = _contaminated(hits["n_hit"], hits["n_words"], percent)
    if remove in ("documents", "both"):
        docs = docs.where(~contaminated)
    if remove == "documents":
        return docs.select(*[F.col(f"`{c}`") for c in names])
    if remove in ("spans", "both"):
        own = F.col(f"`{text_column}`")
        return docs.select(*[F.when(hits["n_hit"] > 0, hits["left"]).otherwise(own).alias(c) if c == text_column else F.col(f"`{c}`") for c in names])
    added = {"n_words": hits["n_words"], "n_hit": hits["n_hit"], "items": hits["items"], "contaminated": contaminated}
    return docs.select(*[F.col(f"`{c}`") for c in names if c not in added], *[v.alias(k) for k, v in added.items()])
