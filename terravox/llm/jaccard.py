"""N-gram Jaccard join by vertical partitioning.

The global order of the 64-bit n-gram hashes is cut into fragments of equal width. Every text's set, sorted, falls into
one segment per fragment, and each fragment is handled apart from the others:

1. A fragment gathers the segments of all texts and drops n-grams that only one set holds. N-grams held by exactly the
   same sets are counted together, so a fragment leaves, for each set, a few weighted entries ("held by this list of
   sets: so many n-grams here"). Two sets' partial overlap in a fragment is the sum of the weights of the entries they
   share; no pair is written out for that.
2. Over all fragments, a set whose entries weigh less than the threshold times its size can link with nothing.
3. The others are ordered rarest entry first; a pair can only reach the threshold if it shares an entry of both
   prefixes, with enough weight left from there on. Each entry links its holders to two of them first; where holders
   are still in different components, all pairs between different components are tried as well, so no link is lost.
4. A candidate's partial overlaps are summed over its fragments and held against the threshold in whole numbers.

Texts with equal sets are one node from the start, so groups of exact copies cost one node. A fragment's size is fixed,
their number isn't: the first deal makes up to 2 ** FIRST_BITS, a second one deals those on. An n-gram that a large share
of all texts holds would be a list without a bound in its fragment; such n-grams are found beforehand and become entries
of their own in the tasks that read the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from terravox.llm.components import connected_components
from terravox.llm.words import SPACED, chunks, give_back, mix, ngrams, sequence_hash, words
from terravox.plans.storage import bound_batches, cut, discard

#: N-grams that a fragment is meant to hold; the number of fragments grows with the input.
FRAGMENT_GRAMS = 3_000_000
#: N-grams a task gathers before it hands out its segments.
TASK_GRAMS = 1_500_000
#: Bits of a hash that name the fragments of the first deal; more fragments are dealt from those in a second one.
FIRST_BITS = 12
#: Texts from which very frequent n-grams are known beforehand, about, and how often those must be among them.
SAMPLED, SAMPLED_OFTEN = 200_000, 16
_WEIGHT = 0xFFFF


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each chunk of a text column its first index and the sorted distinct n-gram hashes of each of its texts."""
    for lo, hi, data, off in chunks(texts):
        w = words(data, off, SPACED)
        grams, at = ngrams(w, size)
        n_words = np.diff(w.first)
        bounds = np.concatenate(([0], np.cumsum(np.maximum(n_words - size + 1, 0))))
        sets = []
        for i in range(hi - lo):
            if n_words[i] >= size:
                g = np.sort(grams[bounds[i] : bounds[i + 1]])
                sets.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
            else:
                own = w.hashes[w.first[i] : w.first[i + 1]]
                sets.append(np.array([sequence_hash(own)] if len(own) else [], np.uint64))
        yield lo, sets


def _kept(bits: int) -> int:
    """Bytes that hold what is left of a hash below its first ``bits`` bits."""
    return (64 - bits + 7) // 8


def _pack(grams: np.ndarray, bits: int, done: int = 0) -> bytes:
    """What is left of each hash below the first ``bits`` bits, of hashes that have lost ``done`` bits at the upper end."""
    kept = _kept(bits + done)
    return ((grams << np.uint64(bits)) >> np.uint64(64 - 8 * kept)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :kept].tobytes()


def _unpack(packed: bytes, bits: int) -> np.ndarray:
    """The same at the upper end of 64 bits."""
    kept = _kept(bits)
    out = np.zeros((len(packed) // kept, 8), np.uint8)
    out[:, :kept] = np.frombuffer(packed, np.uint8).reshape(-1, kept)
    return out.reshape(-1).view("<u8") << np.uint64(64 - 8 * kept)


def _segments_type(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("fragment", pa.int64()), ("nodes", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary()), ("ids", pa.list_(id_type))])


def _entries_type(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("node", pa.int64()), ("doc_id", id_type), ("n", pa.int64()), ("entries", pa.list_(pa.int64()))])


def _row(fragment: int, nodes: np.ndarray, counts: np.ndarray, grams: bytes = b"", ids: list | None = None) -> dict:
    return {"fragment": fragment, "nodes": nodes.tobytes(), "counts": counts.astype(np.uint32).tobytes(), "grams": grams, "ids": ids or []}


def _dealt(nodes: np.ndarray, lengths: np.ndarray, grams: np.ndarray, bits: int, before: int, done: int) -> Iterator[dict]:
    """The segments of sets (node, n-grams; one after the other) by the first ``bits`` bits of their n-grams, of which
    ``done`` bits above are dealt already and made fragment ``before``."""
    if not len(grams):
        return
    fragment = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
    order = np.argsort(fragment.astype(np.uint16) if bits <= 16 else fragment, kind="stable")
    fragment, of = fragment[order], np.repeat(np.arange(len(nodes)), lengths)[order]
    grams = grams[order]
    head = np.flatnonzero(np.concatenate(([True], (fragment[1:] != fragment[:-1]) | (of[1:] != of[:-1]))))
    counts = np.diff(np.append(head, len(grams)))
    node, part = nodes[of[head]], fragment[head]
    begin = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(part)], strict=True):
        a, b = int(head[lo]), int(head[hi]) if hi < len(head) else len(grams)
        yield _row(before << bits | int(part[lo]), node[lo:hi], counts[lo:hi], _pack(grams[a:b], bits, done))


def _direct(grams: np.ndarray) -> np.ndarray:
    """An entry of its own for each n-gram that is known to be very frequent: last in the order, of weight 1."""
    return (np.int64(127) << np.int64(56)) | ((mix(grams) >> np.uint64(24)).astype(np.int64) << np.int64(16)) | np.int64(1)


def _segments(batches: Iterator[pa.RecordBatch], size: int, bits: int, directories: int, frequent: np.ndarray, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Segments by fragment; from ``1 << bits`` on the directory (which text has which set; counts are the sizes) and the
    entries of frequent n-grams (no ids)."""
    schema = _segments_type(id_type)
    ids: list = []
    nodes: list[int] = []
    sizes: list[int] = []
    held: dict[int, np.ndarray] = {}
    often: dict[int, np.ndarray] = {}
    total, turn = 0, 0

    def handed_out() -> pa.RecordBatch:
        nonlocal turn
        own = np.array(list(held), np.int64)
        grams = np.concatenate(list(held.values())) if held else np.zeros(0, np.uint64)
        rows = list(_dealt(own, np.array([len(g) for g in held.values()], np.int64), grams, bits, 0, 0))
        turn += 1
        aside = (1 << bits) + hash((nodes[0], turn)) % directories
        rows.append(_row(aside, np.array(nodes, np.int64), np.array(sizes), ids=list(ids)))
        if often:
            rows.append(_row(aside, np.array(list(often), np.int64), np.array([len(g) for g in often.values()]), np.concatenate(list(often.values())).tobytes()))
        return pa.RecordBatch.from_pylist(rows, schema)

    for batch in batches:
        doc_ids = batch.column(0).to_pylist()
        for lo, sets in shingle_sets(batch.column(1), size):
            for i, g in enumerate(sets):
                node = int((mix(g ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64) + np.uint64(len(g))).astype(np.int64)) if len(g) else 0
                ids.append(doc_ids[lo + i])
                nodes.append(node)
                sizes.append(len(g))
                if len(g) and node not in held:
                    if len(frequent):
                        hot = frequent[np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)] == g
                        if hot.any():
                            often[node] = _direct(g[hot])
                            g = g[~hot]
                    held[node] = g
                    total += len(g)
            if total >= TASK_GRAMS or len(ids) >= 200_000:
                yield handed_out()
                ids, nodes, sizes, held, often, total = [], [], [], {}, {}, 0
                give_back()
    if ids:
        yield handed_out()
    held.clear()
    give_back()


def _dealt_again(batches: Iterator[pa.RecordBatch], done: int, more: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Segments of fragments of ``done`` bits, in their order, dealt to fragments of ``more`` bits more."""
    schema = _segments_type(id_type)
    nodes, counts, grams, total, now = [], [], [], 0, -1

    def handed_out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(list(_dealt(np.concatenate(nodes), np.concatenate(counts), np.concatenate(grams), more, now, done)), schema)

    for batch in batches:
        aside = []
        for r in batch.to_pylist():
            if r["fragment"] >= 1 << done:
                aside.append(r | {"fragment": r["fragment"] - (1 << done) + (1 << done + more)})
                continue
            if total and (r["fragment"] != now or total >= TASK_GRAMS):
                yield handed_out()
                nodes, counts, grams, total = [], [], [], 0
                give_back()
            now = r["fragment"]
            nodes.append(np.frombuffer(r["nodes"], np.int64))
            counts.append(np.frombuffer(r["counts"], np.uint32).astype(np.int64))
            grams.append(_unpack(r["grams"], done))
            total += len(grams[-1])
        if aside:
            yield pa.RecordBatch.from_pylist(aside, schema)
    if total:
        yield handed_out()
    give_back()


def _lists(owner: np.ndarray, values: np.ndarray, schema: pa.Schema, n: int | None) -> pa.Table:
    """A row of entries for each owner; owners are sorted."""
    begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(owner)).astype(np.int32)), pa.array(values))
    return pa.table({"node": owner[begins], "doc_id": pa.nulls(len(begins), schema.field("doc_id").type), "n": pa.array([n] * len(begins), pa.int64()), "entries": lists}, schema=schema)


def _entries(fragment: int, table: pa.Table, bits: int, id_type: pa.DataType) -> pa.Table:
    """The weighted entries of each set in one fragment. Of a directory the texts' sets; entries that are known already
    stay as they are, with n = -1."""
    schema = _entries_type(id_type)
    all_nodes, all_counts, all_grams = [], [], []
    out = []
    for r in table.to_batches():
        for nodes, counts, grams, ids in zip(r.column("nodes").to_pylist(), r.column("counts").to_pylist(), r.column("grams").to_pylist(), r.column("ids"), strict=True):
            own, count = np.frombuffer(nodes, np.int64), np.frombuffer(counts, np.uint32).astype(np.int64)
            if len(ids.values):
                out.append(pa.table({"node": own, "doc_id": ids.values, "n": count, "entries": pa.nulls(len(own), pa.list_(pa.int64()))}, schema=schema))
            elif fragment >= 1 << bits:
                out.append(_lists(np.repeat(own, count), np.frombuffer(grams, np.int64), schema, -1))
            else:
                all_nodes.append(own)
                all_counts.append(count)
                all_grams.append(_unpack(grams, bits))
    if out or not all_nodes:
        return pa.concat_tables(out) if out else schema.empty_table()
    nodes, counts, grams = (np.concatenate(x) for x in (all_nodes, all_counts, all_grams))
    _, once = np.unique(nodes, return_index=True)  # a set that several tasks had
    if len(once) < len(nodes):
        new = np.zeros(len(nodes), bool)
        new[once] = True
        grams = grams[np.repeat(new, counts)]
        nodes, counts = nodes[new], counts[new]
    nodes = np.repeat(nodes, counts)
    order = np.argsort(grams)
    grams = grams[order]
    head = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
    holders = np.diff(np.append(head, len(grams)))
    nodes = nodes[order][np.repeat(holders > 1, holders)]
    holders = holders[holders > 1]
    if not len(holders):
        return schema.empty_table()
    head = np.cumsum(holders) - holders
    salt = np.uint64((fragment + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    lists = mix(np.add.reduceat(mix(nodes.astype(np.uint64)), head) ^ salt)
    _, first, weight = np.unique(lists, return_index=True, return_counts=True)
    # A weight that its 16 bits can't hold is spread over several entries of the same list.
    parts = (weight + _WEIGHT - 1) // _WEIGHT
    which = np.repeat(np.arange(len(first)), parts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    part = np.minimum(weight[which] - nth * _WEIGHT, _WEIGHT)
    rarity = np.minimum(126, np.floor(3 * np.log2(holders[first][which])).astype(np.int64))
    entry = (rarity << 56) | ((mix(lists[first][which] + nth.astype(np.uint64)) >> np.uint64(24)).astype(np.int64) << 16) | part
    at = np.repeat(head[first][which] - (np.cumsum(holders[first][which]) - holders[first][which]), holders[first][which]) + np.arange(holders[first][which].sum())
    owner, values = nodes[at], np.repeat(entry, holders[first][which])
    order = np.argsort(owner, kind="stable")
    return _lists(owner[order], values[order], schema, None)


def _fragment(key: tuple, table: pa.Table, bits: int, id_type: pa.DataType) -> pa.Table:
    made = _entries(key[0].as_py(), table, bits, id_type)
    give_back()
    return made


def _grams_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sets in shingle_sets(batch.column(0), size):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["gram"])
    give_back()


def frequent_grams(docs: DataFrame, rows: int, size: int) -> np.ndarray:
    """Sorted hashes of n-grams so frequent in a sample of about SAMPLED texts that one fragment had better not list their
    holders. Only the layout depends on the sample, never a result: a frequent n-gram is an entry of its own. No text is
    looked at where a fragment can hold a list of all rows. At most the sample's n-grams over SAMPLED_OFTEN are sent."""
    if rows <= FRAGMENT_GRAMS:
        return np.zeros(0, np.uint64)
    share = min(1.0, SAMPLED / rows)
    often = max(SAMPLED_OFTEN, int(share * FRAGMENT_GRAMS / 4))
    grams = docs.where(F.rand(0) < share).select("text").mapInArrow(lambda it: _grams_of(it, size), "gram long")
    found = grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= often).select("gram").toPandas()
    return np.sort(found.gram.to_numpy(np.int64).view(np.uint64))


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(entry, node, n, rest, share): each set's entries, rarest first, as long as the weight from there on can still
    reach the threshold; share is the part of the set that other sets hold too, in millionths."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for node, n, entries in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("entries"), strict=True):
            e = np.sort(entries.values.to_numpy(zero_copy_only=False))
            rest = np.cumsum((e & _WEIGHT)[::-1])[::-1]
            keep = 100 * rest >= percent * n
            k = int(keep.sum())
            out[0].append(e[keep])
            out[1].append(np.full(k, node))
            out[2].append(np.full(k, n))
            out[3].append(rest[keep])
            out[4].append(np.full(k, rest[0] * 1_000_000 // n))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], ["entry", "node", "n", "rest", "share"])


def _overlap(a: str, b: str):
    """Sum over the fragments of the weights of shared entries."""
    return F.aggregate(F.array_intersect(a, b), F.lit(0).cast("long"), lambda total, x: total + x.bitwiseAND(F.lit(_WEIGHT).cast("long")))


def jaccard_groups(docs: DataFrame, percent: int = 80, size: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``; other columns, whatever their names, are ignored.

    Two texts link when 100 * intersection >= percent * union of their sets of distinct ``size``-word shingles; a text
    of fewer words has its whole sequence as its one shingle. ``component_id`` is the smallest id reachable by links.
    Null and empty texts and texts of white space have no shingles and link with nothing. Ids are whole numbers or
    strings, and ordered as such. A null id stays null, takes part in links, and names no component unless all ids of its
    component are null. Repeated rows give repeated results. A text of any length is one set, of whole 64-bit hashes. An
    empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    sql_type = "long" if isinstance(docs.schema[id_column].dataType, IntegralType) else "string"
    id_type = pa.int64() if sql_type == "long" else pa.string()
    docs = docs.select(F.col(f"`{id_column}`").cast(sql_type).alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    amount = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    bits = int(np.ceil(np.log2(max(1, (amount[0] or 0) / 6 / FRAGMENT_GRAMS))))
    first = min(bits, FIRST_BITS)
    directories = 1 + amount[1] // 100_000
    frequent = frequent_grams(docs, amount[1], size)
    kept = f"fragment long, nodes binary, counts binary, grams binary, ids array<{sql_type}>"
    segments = docs.mapInArrow(lambda it: _segments(it, size, first, directories, frequent, id_type), kept)
    if bits > first:
        # A fragment of the first deal has no bound: many tasks, of a bounded number of n-grams each, deal it again.
        shares = int((amount[0] or 0) / 6 / (1 << first) / (16 * TASK_GRAMS)) + 1
        spread = segments.repartition("fragment", F.pmod(F.xxhash64("nodes"), F.lit(shares))).sortWithinPartitions("fragment")
        segments = spread.mapInArrow(lambda it: _dealt_again(it, first, bits - first, id_type), kept)
    found = cut(segments.groupBy("fragment").applyInArrow(lambda k, t: _fragment(k, t, bits, id_type), f"node long, doc_id {sql_type}, n long, entries array<long>"))

    directory = found.where("entries is null").select("node", "doc_id", "n")
    sets = directory.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.min("doc_id").alias("least"))
    sets = cut(sets)  # written, as other sides of later joins are, so that those may split what one hot node has
    listed = found.where("entries is not null and n is null").select("node", "entries")
    known = found.where("entries is not null and n = -1").groupBy("node").agg(F.first("entries").alias("entries"))  # the same from every task that had the set
    entries = listed.unionByName(known).groupBy("node").agg(F.flatten(F.collect_list("entries")).alias("entries"))
    weight = F.aggregate("entries", F.lit(0).cast("long"), lambda total, x: total + x.bitwiseAND(F.lit(_WEIGHT).cast("long")))
    near = cut(entries.where(F.size("entries") > 0).join(sets.select("node", "n"), "node").where(100 * weight >= percent * F.col("n")))

    prefixes = near.mapInArrow(lambda it: _prefixes(it, percent), "entry long, node long, n long, rest long, share long")
    # The two holders that all others are tried with: one at random, and the one that has least of its own, as the
    # text that the others are edited from.
    ends = prefixes.groupBy("entry").agg(F.count("*").alias("holders"), F.min(F.struct("node", "n", "rest")).alias("low"), F.max(F.struct("share", "node", "n", "rest")).alias("high"), F.min("n").alias("least"))
    ends = cut(ends.where("holders > 1").drop("holders"))  # written, so that the join that follows may split a hot entry
    # No partner is smaller than the smallest holder, nor than the threshold allows.
    partner = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    useful = prefixes.join(ends, "entry").where((100 + percent) * F.col("rest") >= percent * (F.col("n") + partner))
    shared = cut(useful.drop("least"))

    def can_reach(n, rest, n2, rest2):
        return ((100 + percent) * F.least(rest, rest2) >= percent * (n + n2)) & (100 * F.least(n, n2) >= percent * F.greatest(n, n2))

    def linked(pairs: DataFrame) -> DataFrame:
        """Of candidates (a, b) those that link."""
        side = near.select("node", "n", "entries")
        both = pairs.join(side.toDF("a", "na", "ea"), "a").join(side.toDF("b", "nb", "eb"), "b")
        return both.withColumn("overlap", _overlap("ea", "eb")).where((100 + percent) * F.col("overlap") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")

    def candidates(end: str) -> DataFrame:
        x = F.col(end)
        return shared.where((x["node"] != F.col("node")) & can_reach(F.col("n"), F.col("rest"), x["n"], x["rest"])).select(F.least("node", x["node"]).alias("a"), F.greatest("node", x["node"]).alias("b"))

    tried = cut(candidates("low").unionByName(candidates("high")).distinct())
    links = cut(linked(tried))
    part = cut(connected_components(links))
    # Entries whose holders are in several components: all pairs between different components.
    placed = shared.select("entry", "node", "n", "rest").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = cut(placed.groupBy("entry").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("entry"))
    placed = cut(placed.join(mixed, "entry").select("entry", "node", "n", "rest", "component"))
    # Partners' sizes lie within one class of each other, so holders of very different sizes never meet, and one entry's
    # holders are spread over the classes.
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent) if percent < 100 else 1.0) + 1e-9)
    placed_by = placed.withColumn("class", size_class)
    left = placed_by.select("entry", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("rest").alias("ra"), F.col("component").alias("ca"))
    right = placed_by.select("entry", "class", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("rb"), F.col("component").alias("cb"))
    apart = left.join(right, ["entry", "class"]).where((F.col("ca") < F.col("cb")) & can_reach(F.col("na"), F.col("ra"), F.col("nb"), F.col("rb")))
    apart = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = cut(linked(apart.join(tried, ["a", "b"], "left_anti")))
    # One component for each node: links of the second kind join components of the first.
    of = part.toDF("node", "component")
    ends_of = more.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = cut(connected_components(ends_of).toDF("component", "whole"))
    lone = joined.join(part.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), "whole")
    whole = part.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("whole")).unionByName(lone)
    named = whole.join(sets.select("node", "least"), "node")
    names = named.groupBy("whole").agg(F.min("least").alias("name"))
    named = named.join(names, "whole").select("node", "name")
    of_set = cut(sets.join(named, "node", "left").select("node", F.coalesce("name", "least").alias("name")))
    discard(sets, near, ends, shared, tried, links, part, mixed, placed, more, joined)
    return (
        directory.join(of_set, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("name", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )
