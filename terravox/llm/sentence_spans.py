"""Substring deduplication by sliding sentence spans.

Every run of several consecutive sentences (at least three, with at least 25 words) is hashed, from each sentence on
forwards and from each sentence back; the hashes are joined over the whole corpus, and the sentences that any
non-first occurrence of a run covers are removed.

A run is known by 96 bits: a 64-bit hash that names its fragment and its place there, and a 32-bit one of its own. Among
four trillion runs, as 100 TB have, one false match is expected in ten thousand such corpora.

The join is by fragments of the hash space, of a fixed size; the first deal makes up to 2 ** FIRST_BITS of them, a second
one deals those on. A task first joins its own texts: later occurrences inside it are settled
there and then, and only one posting per distinct hash goes out, so a passage that a third of all texts hold costs one
row for each task.

Sentences of any length can be cut in two ways. At fixed offsets, a passage that stands elsewhere in a sentence is cut
elsewhere. With ``shifted``, a cut depends only on the words around it and no piece has more than PIECE_WORDS words, so
that two texts agree in all cuts of a common passage but those of PIECE_WORDS words at either end: whatever 50 words
they share hold a run of at least 25, wherever they stand and however their lines are broken.

Words stand between white space; of scripts that are written without it every character is a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.llm.words import SPACED, Words, _powers_to, chunks, free_name, give_back, mix, words
from terravox.plans.storage import bound_batches, cut

#: A run has at least so many sentences and so many words.
RUN_SENTENCES, RUN_WORDS = 3, 25
#: A longer sentence is cut after each so many words, counted from its start.
SENTENCE_WORDS = 16
#: With ``shifted``, the longest piece of a sentence; two of them are shorter than a run.
PIECE_WORDS = 12
#: Runs that a fragment is meant to hold, and that a task gathers before it hands them out.
FRAGMENT_RUNS, TASK_RUNS = 1_200_000, 750_000
#: Bits of a hash that name the fragments of the first deal.
FIRST_BITS = 12
_LAST = np.iinfo(np.int64).max
# Characters that end a sentence, and the ranges of scripts written without white space between words (Thai
# and Lao, Myanmar, Khmer, then Chinese, Japanese and Korean letters and full-width signs).
STOPS = ".!?。！？｡…؟।"
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3000, 0xD7FF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF))
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in STOPS if c < "\x80"]] = True
_LONG_STOPS = {n: np.array([int.from_bytes(c.encode()) for c in STOPS if len(c.encode()) == n]) for n in (2, 3)}


class Runs(NamedTuple):
    hashes: np.ndarray  #: of each run
    checks: np.ndarray  #: a second hash of each run, of 32 bits
    first: np.ndarray  #: its first sentence
    last: np.ndarray  #: its last sentence
    begin: np.ndarray  #: first byte of each sentence
    units: np.ndarray  #: index of each text's first sentence, and the count of sentences at the end
    of: np.ndarray  #: text of each run


class Sentences(NamedTuple):
    words: Words
    start: np.ndarray  #: first word of each sentence
    end: np.ndarray  #: word after it
    units: np.ndarray  #: index of each text's first sentence, and the count of sentences at the end


def _local_cuts(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Heads, and in each window of PIECE_WORDS words without one the word of the least hash (of it and the word before
    it; the last of equals)."""
    size, n = PIECE_WORDS, len(hashes)
    if n < size:
        return heads
    value = mix(hashes ^ (np.concatenate((hashes[:1], hashes[:-1])) * np.uint64(0xA24BAED4963EE407)))
    least = value[size - 1 :].copy()
    at = np.arange(size - 1, n)
    for k in range(size - 2, -1, -1):
        less = value[k : n - size + 1 + k] < least
        least[less] = value[k : n - size + 1 + k][less]
        at[less] = np.flatnonzero(less) + k
    seen = np.concatenate(([0], np.cumsum(heads)))
    cuts = heads.copy()
    cuts[at[seen[size:] == seen[:-size]]] = True
    return cuts


def _unspaced(data: np.ndarray) -> np.ndarray | None:
    """Where characters of the UNSPACED ranges begin, and where they end."""
    at = np.flatnonzero(data >= 0xE0)
    if not len(at):
        return None
    point = ((data[at].astype(np.int64) & 0x0F) << 12) | ((data[at + 1].astype(np.int64) & 0x3F) << 6) | (data[at + 2] & 0x3F)
    at = at[(data[at] < 0xF0) & np.logical_or.reduce([(point >= lo) & (point <= hi) for lo, hi in UNSPACED])]
    edges = np.union1d(at, at + 3)
    return edges[edges < len(data)]


def _stops(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the words that end there end a sentence."""
    found = _STOPS[data[end - 1]]
    high = np.flatnonzero(data[end - 1] >= 0x80)
    if len(high):
        e = end[high]
        two = (data[np.maximum(e - 2, 0)].astype(np.int64) << 8) | data[e - 1]
        three = (data[np.maximum(e - 3, 0)].astype(np.int64) << 16) | two
        found[high] = np.isin(two, _LONG_STOPS[2]) | np.isin(three, _LONG_STOPS[3])
    return found


def sentences(data: np.ndarray, off: np.ndarray, shifted: bool = False) -> Sentences:
    """The sentences of a chunk of texts. One ends after a word that ends with one of STOPS, at a line break, or after
    SENTENCE_WORDS words; with ``shifted`` after such a word or at a local cut."""
    w = words(data, off, SPACED, _unspaced(data))
    n = len(w.hashes)
    heads = np.zeros(n + 1, bool)
    heads[w.first] = True
    if n and shifted:
        heads[1:n] |= _stops(data, w.end[:-1])
        start = np.flatnonzero(_local_cuts(w.hashes, heads[:n]))
        return Sentences(w, start, np.append(start[1:], n), np.searchsorted(start, w.first))
    if n:
        lines = np.cumsum((data == 10) | (data == 13))
        heads[1:n] |= _stops(data, w.end[:-1]) | (lines[w.start[1:]] > lines[w.end[:-1] - 1])
    sentence = np.flatnonzero(heads[:n])
    place = np.arange(n) - np.repeat(sentence, np.diff(np.append(sentence, n)))
    start = np.flatnonzero(place % SENTENCE_WORDS == 0)
    return Sentences(w, start, np.append(start[1:], n), np.searchsorted(start, w.first))


def sentence_runs(data: np.ndarray, off: np.ndarray, shifted: bool = False) -> Runs:
    """The runs of a chunk of texts."""
    w, start, end, units = sentences(data, off, shifted)
    n = len(w.hashes)
    text = np.repeat(np.arange(len(off) - 1), np.diff(units))
    last = np.repeat(units[1:] - 1, np.diff(units))
    here = np.arange(len(start))
    forward = np.maximum(np.searchsorted(end, start + RUN_WORDS, "left"), here + RUN_SENTENCES - 1)
    ok = forward <= last
    i, j = here[ok], forward[ok]
    back = np.minimum(np.searchsorted(start, end - RUN_WORDS, "right") - 1, here - RUN_SENTENCES + 1)
    ok = (back >= np.repeat(units[:-1], np.diff(units))) & (back >= 0)
    ok[ok] = forward[back[ok]] != here[ok]
    i, j = np.concatenate((i, back[ok])), np.concatenate((j, here[ok]))
    power, inverse = _powers_to(n)
    a, b = start[i], end[j]

    def hashed(values: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], out=total[1:])
        return mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    checks = (hashed(mix(w.hashes ^ np.uint64(0x9FB21C651E98DF25))) >> np.uint64(32)).astype(np.uint32)
    return Runs(hashed(w.hashes), checks, i, j, w.start[start], units, text[i])


_OUT = pa.schema([("fragment", pa.int64()), ("ids", pa.binary()), ("keys", pa.binary()), ("texts", pa.binary()), ("hashes", pa.binary()), ("checks", pa.binary())])
_OUT_SQL = "fragment long, ids binary, keys binary, texts binary, hashes binary, checks binary"
_REPLY = pa.schema([("key", pa.int64()), ("later", pa.list_(pa.int64())), ("again", pa.list_(pa.int64()))])


def _lists(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The distinct owners, and for each its values; owners are sorted."""
    begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    return owner[begin], pa.ListArray.from_arrays(pa.array(np.append(begin, len(owner)).astype(np.int32)), pa.array(values.view(np.int64)))


def _by_run(h: np.ndarray, c: np.ndarray, *rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by run and then by the ranks (the last counts first), and which places of it begin a run. Runs differ in
    hash or check; the check is sorted by only where a hash alone doesn't do."""
    order = np.lexsort((*rank, h))
    s, t = h[order], c[order]
    if ((s[1:] == s[:-1]) & (t[1:] != t[:-1])).any():
        order = np.lexsort((*rank, c, h))
        s, t = h[order], c[order]
    return order, np.concatenate(([True], (s[1:] != s[:-1]) | (t[1:] != t[:-1]))) if len(s) else np.zeros(0, bool)


def _dealt(doc: np.ndarray, key: np.ndarray, t: np.ndarray, h: np.ndarray, c: np.ndarray, bits: int, before: int, done: int) -> Iterator[dict]:
    """Rows of postings (text, hash, check; sorted by hash) by the first ``bits`` bits below the first ``done``, which
    made fragment ``before``."""
    part = ((h << np.uint64(done)) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(part)][: len(begin)], strict=True):
        own, local = np.unique(t[lo:hi], return_inverse=True)
        yield {"fragment": before << bits | int(part[lo]), "ids": doc[own].tobytes(), "keys": key[own].tobytes(), "texts": local.astype(np.uint32).tobytes(), "hashes": h[lo:hi].tobytes(), "checks": c[lo:hi].tobytes()}


def _postings(batches: Iterator[pa.RecordBatch], bits: int, spread: int, shifted: bool) -> Iterator[pa.RecordBatch]:
    """First occurrences inside the task by fragment; from fragment ``1 << bits`` on what is settled already (its ids are
    flags: repeated inside its first text, or found in a later one)."""
    ids, keys, hashes, checks, texts, total = [], [], [], [], [], 0

    def handed_out() -> pa.RecordBatch:
        doc, key = np.concatenate(ids), np.concatenate(keys)
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((key, doc))] = np.arange(len(doc))
        h, c, t = np.concatenate(hashes), np.concatenate(checks), np.concatenate(texts)
        order, head = _by_run(h, c, rank[t])
        h, c, t = h[order], c[order], t[order]
        owner = key[t[np.flatnonzero(head)][np.cumsum(head) - 1]] if len(h) else np.zeros(0, np.int64)
        same = ~head & (key[t] == owner)
        rows = []
        settled = np.flatnonzero(~head)
        settled = settled[np.argsort(key[t[settled]], kind="stable")]
        if len(settled):
            rows.append({"fragment": (1 << bits) + int(key[0] % spread), "ids": same[settled].tobytes(), "keys": key[t[settled]].tobytes(), "texts": b"", "hashes": h[settled].tobytes(), "checks": b""})
        return pa.RecordBatch.from_pylist([*rows, *_dealt(doc, key, t[head], h[head], c[head], bits, 0, 0)], _OUT)

    n = 0
    for batch in batches:
        ids.append(batch.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False))
        keys.append(batch.column(1).to_numpy(zero_copy_only=False))
        for lo, _, data, off in chunks(batch.column(2)):
            runs = sentence_runs(data, off, shifted)
            hashes.append(runs.hashes)
            checks.append(runs.checks)
            texts.append(runs.of + (n + lo))
            total += len(runs.hashes)
        n += batch.num_rows
        if total >= TASK_RUNS:
            yield handed_out()
            ids, keys, hashes, checks, texts, total, n = [], [], [], [], [], 0, 0
            give_back()
    if n:
        yield handed_out()
        ids, keys, hashes, checks, texts = [], [], [], [], []
    give_back()


def _unpacked(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids and keys of the texts in all rows, and of their runs the text, hash and check."""
    doc, key, texts, n = [], [], [], 0
    for r in rows:
        doc.append(np.frombuffer(r["ids"], np.int64))
        key.append(np.frombuffer(r["keys"], np.int64))
        texts.append(np.frombuffer(r["texts"], np.uint32).astype(np.int64) + n)
        n += len(doc[-1])
    return np.concatenate(doc), np.concatenate(key), np.concatenate(texts), np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows]), np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in rows])


def _dealt_again(batches: Iterator[pa.RecordBatch], done: int, more: int) -> Iterator[pa.RecordBatch]:
    """Postings of fragments of ``done`` bits, in their order, dealt to fragments of ``more`` bits more."""
    held, total = [], 0

    def handed_out() -> pa.RecordBatch:
        doc, key, t, h, c = _unpacked(held)
        order = np.argsort(h)
        return pa.RecordBatch.from_pylist(list(_dealt(doc, key, t[order], h[order], c[order], more, held[0]["fragment"], done)), _OUT)

    for batch in batches:
        aside = []
        for r in batch.to_pylist():
            if r["fragment"] >= 1 << done:
                aside.append(r | {"fragment": r["fragment"] - (1 << done) + (1 << done + more)})
                continue
            if held and (r["fragment"] != held[0]["fragment"] or total >= TASK_RUNS):
                yield handed_out()
                held, total = [], 0
                give_back()
            held.append(r)
            total += len(r["hashes"]) // 8
        if aside:
            yield pa.RecordBatch.from_pylist(aside, _OUT)
    if held:
        yield handed_out()
    give_back()


def _replies(table: pa.Table) -> pa.Table:
    """For each text the hashes of runs of which an earlier text has the first occurrence, and of those that it repeats."""
    out, open_rows = [], []
    for r in table.to_pylist():
        if r["texts"]:
            open_rows.append(r)
            continue
        h, k, same = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["keys"], np.int64), np.frombuffer(r["ids"], bool)
        for some, name in ((~same, "later"), (same, "again")):
            owner, lists = _lists(k[some], h[some])
            out.append(pa.table({"key": owner, "later": lists if name == "later" else pa.nulls(len(owner), lists.type), "again": lists if name == "again" else pa.nulls(len(owner), lists.type)}, schema=_REPLY))
    if open_rows:
        doc, key, t, h, c = _unpacked(open_rows)
        order = np.argsort(h)
        s = h[order]
        equal = s[1:] == s[:-1]
        order = order[np.concatenate(([False], equal)) | np.concatenate((equal, [False]))]
        t, h, c = t[order], h[order], c[order]
        order, head = _by_run(h, c, key[t], doc[t])
        k, h = key[t[order]], h[order]
        later = k != k[np.flatnonzero(head)][np.cumsum(head) - 1] if len(h) else head
        k, h = k[later], h[later]
        order = np.argsort(k, kind="stable")
        owner, lists = _lists(k[order], h[order])
        out.append(pa.table({"key": owner, "later": lists, "again": pa.nulls(len(owner), lists.type)}, schema=_REPLY))
    give_back()
    return pa.concat_tables(out) if out else _REPLY.empty_table()


_SHORT = pa.struct([("text", pa.string()), ("sentences", pa.int64()), ("removed", pa.int64())])


def _shortened(texts: pa.Array, later: pa.Array, again: pa.Array, shifted: bool) -> pa.Array:
    """Each text without the sentences covered by a run in ``later``, or by a run in ``again`` after its first time."""
    out, counts, gone = [], [], []
    for lo, hi, data, off in chunks(texts):
        runs = sentence_runs(data, off, shifted)
        order = np.argsort(runs.of, kind="stable")
        bounds = np.searchsorted(runs.of[order], np.arange(hi - lo + 1))
        for i in range(hi - lo):
            u0, u1 = int(runs.units[i]), int(runs.units[i + 1])
            counts.append(u1 - u0)
            flags = np.zeros(u1 - u0 + 1, np.int64)
            if later[lo + i].is_valid or again[lo + i].is_valid:
                own = order[bounds[i] : bounds[i + 1]]
                h = runs.hashes[own]
                drop = np.isin(h, later[lo + i].values.to_numpy(zero_copy_only=False).view(np.uint64)) if later[lo + i].is_valid else np.zeros(len(h), bool)
                if again[lo + i].is_valid:
                    by_place = np.argsort(runs.first[own], kind="stable")
                    _, once = np.unique(h[by_place], return_index=True)
                    repeat = np.ones(len(h), bool)
                    repeat[by_place[once]] = False
                    drop |= repeat & np.isin(h, again[lo + i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                np.add.at(flags, runs.first[own][drop] - u0, 1)
                np.add.at(flags, runs.last[own][drop] - u0 + 1, -1)
            covered = np.cumsum(flags)[:-1] > 0
            gone.append(int(covered.sum()))
            raw = data[off[i] : off[i + 1]].tobytes()
            if gone[-1]:
                cuts = np.append(runs.begin[u0:u1] - off[i], len(raw))
                cuts[0] = 0
                kept = b"".join(raw[cuts[k] : cuts[k + 1]] for k in np.flatnonzero(~covered))
                raw = kept.rstrip() if covered[-1] else kept
            out.append(raw.decode())
    give_back()
    return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((out, counts, gone), _SHORT, strict=True)], fields=list(_SHORT))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shifted: bool = False) -> DataFrame:
    """``docs`` with the sentences removed that a non-first occurrence of a run covers.

    Order is by id (a whole number; null last), then by a hash of the text, then by place. The text column is replaced;
    the columns ``n_sentences`` and ``n_removed`` are added (columns of those names are replaced); all other columns stay,
    whatever their names. Every row stays, though its text may become empty. Null texts stay null and have no sentences;
    rows that agree in id and text count as one text and get the same result; texts of fewer than three sentences or 25
    words are never touched; a text of any length is read whole; an empty table gives no rows. With ``shifted``, sentences
    are cut at local cuts, so that no text keeps 50 words that an earlier one has; ``n_sentences`` and ``n_removed`` then
    count the pieces.
    """
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    own = free_name(docs.columns, "_spans")
    text = F.col(f"`{text_column}`").cast("string")
    keyed = docs.withColumn(own, F.xxhash64(F.col(f"`{id_column}`").cast("long"), text))
    amount = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    bits = int(np.ceil(np.log2(max(1, (amount[0] or 0) / 25 / FRAGMENT_RUNS))))
    first = min(bits, FIRST_BITS)
    spread = 1 + (amount[0] or 0) // (64 << 20)
    postings = keyed.select(F.col(f"`{id_column}`").cast("long"), own, text).mapInArrow(lambda it: _postings(it, first, spread, shifted), _OUT_SQL)
    if bits > first:
        # A fragment of the first deal has no bound: many tasks, of a bounded number of runs each, deal it again.
        shares = int((amount[0] or 0) / 25 / (1 << first) / (16 * TASK_RUNS)) + 1
        again = postings.repartition("fragment", F.pmod(F.xxhash64("hashes"), F.lit(shares))).sortWithinPartitions("fragment")
        postings = again.mapInArrow(lambda it: _dealt_again(it, first, bits - first), _OUT_SQL)
    replies = cut(postings.groupBy("fragment").applyInArrow(_replies, "key long, later array<long>, again array<long>"))
    later, repeat, short = f"{own}_later", f"{own}_again", f"{own}_short"
    together = replies.groupBy(F.col("key").alias(own)).agg(F.flatten(F.collect_set("later")).alias(later), F.flatten(F.collect_set("again")).alias(repeat))
    shorten = F.arrow_udf(lambda t, x, y: _shortened(t, x, y, shifted), "text string, sentences long, removed long")
    found = keyed.join(together, own, "left").withColumn(short, shorten(F.coalesce(text, F.lit("")), later, repeat))
    kept = [F.when(text.isNotNull(), F.col(short)["text"]).alias(c) if c == text_column else F.col(f"`{c}`") for c in names]
    return found.select(*kept, F.col(short)["sentences"].alias("n_sentences"), F.col(short)["removed"].alias("n_removed"))
