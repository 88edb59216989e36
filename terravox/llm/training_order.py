"""Training-order materialisation of token ids.

Documents, each closed by an end id, are laid one after the other and cut into sequences of a fixed number of 16- or
32-bit ids. Their order is that of a hash of id and content, in buckets of about BUCKET_BYTES whose number follows from
the amount of content alone, so the same documents and key give the same shards however the input is partitioned; only
the last sequence of a bucket is padded. All sequences are numbered without gaps by bucket, and a keyed Feistel
permutation with cycle-walking sends each number to its slot in training order. Ranges
of slots are written as shards of fixed-stride records, so that slot s lies at byte (s mod per_shard) * stride of shard
s div per_shard: a reader starts, skips and resumes anywhere by a seek.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from terravox.llm.words import give_back
from terravox.plans.storage import bound_batches, cut, discard

#: Sequences in one packed row, and those that a task gathers before it hands them to shards.
BLOCK, GATHERED = 64, 2048
#: Bytes of content in one bucket, about.
BUCKET_BYTES = 64 << 20
#: Buckets whose offsets are broadcast at most; beyond, they are joined.
BROADCAST_PARTS = 200_000
ROUNDS = 6


def _halves(n: int) -> int:
    """Bits of each half of the smallest even-width domain that holds n."""
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def _round(half: np.ndarray, key: int, turn: int, mask: np.uint64) -> np.ndarray:
    x = half + np.uint64((key * 0x9E3779B97F4A7C15 + (turn + 1) * 0xD1B54A32D192ED03) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & mask


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0 .. n - 1, or its inverse: a Feistel network over the next even number of bits, walked along
    its cycles until the value is below n again."""
    bits = np.uint64(_halves(n))
    mask = np.uint64((1 << int(bits)) - 1)
    out = np.array(index, dtype=np.uint64)
    walk = np.arange(len(out))
    while len(walk):
        left, right = out[walk] >> bits, out[walk] & mask
        for turn in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ _round(left, key, turn, mask), left
            else:
                left, right = right, left ^ _round(right, key, turn, mask)
        out[walk] = left << bits | right
        walk = walk[out[walk] >= n]
    return out.astype(np.int64)


def listed(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a column of lists, one after the other, and where each list begins (and the last ends); null is empty."""
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    return ids.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))


_PACKED = pa.schema([("part", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int32())), ("docs", pa.list_(pa.list_(pa.int64()))), ("ids", pa.binary())])
_PACKED_SQL = "part long, first long, n long, tokens array<int>, docs array<array<long>>, ids binary"


def _packed(batches: Iterator[pa.RecordBatch], encode: Callable, length: int, end: int, pad: int, kind: str) -> Iterator[pa.RecordBatch]:
    """The sequences of buckets, which come one after the other, in blocks, with the documents in each."""
    press, part = zstandard.ZstdCompressor(level=3), -1
    held: list[np.ndarray] = []  # ids of documents that no block has yet
    begins: list[tuple[int, int | None]] = []  # where each of their documents begins, and its id
    size, first = 0, 0

    def block(closing: bool) -> pa.RecordBatch | None:
        nonlocal held, begins, size, first
        ids = np.concatenate(held) if held else np.zeros(0, kind)
        n = -(-len(ids) // length) if closing else len(ids) // length
        if not n:
            held = [ids]
            return None
        cut = min(n * length, len(ids))
        own = ids[:cut]
        tokens = [min(length, cut - k * length) for k in range(n)]
        if cut < n * length:
            own = np.concatenate([own, np.full(n * length - cut, pad, kind)])
        starts = np.array([b for b, _ in begins], np.int64)
        docs = []
        for k in range(n):
            lo, hi = np.searchsorted(starts, k * length, "right") - 1, np.searchsorted(starts, (k + 1) * length, "left")
            docs.append([begins[i][1] for i in range(max(lo, 0), hi)])
        out = pa.RecordBatch.from_pylist([{"part": part, "first": first, "n": n, "tokens": tokens, "docs": docs, "ids": press.compress(own.tobytes())}], _PACKED)
        keep = max(int(np.searchsorted(starts, cut, "right")) - 1, 0)
        held, begins = [ids[cut:]], [(b - cut, i) for b, i in begins[keep:]] if cut < len(ids) else []
        size, first = len(ids) - cut, first + n
        return out

    for b in batches:
        ids, bounds = encode(b.column(1))
        ids = ids.astype(kind)
        for doc_id, bucket, lo, hi in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if bucket != part:
                if size and (out := block(True)) is not None:
                    yield out
                part, held, begins, size, first = bucket, [], [], 0, 0
            begins.append((size, doc_id))
            held += [ids[lo:hi], np.array([end], kind)]
            size += hi - lo + 1
            if size >= BLOCK * length and (out := block(False)) is not None:
                yield out
        give_back()
    if size and (out := block(True)) is not None:
        yield out


_HANDED = pa.schema([("shard", pa.int64()), ("slots", pa.list_(pa.int64())), ("sequences", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int32())), ("docs", pa.list_(pa.list_(pa.int64()))), ("ids", pa.binary())])
_HANDED_SQL = "shard long, slots array<long>, sequences array<long>, tokens array<int>, docs array<array<long>>, ids binary"


def _handed(batches: Iterator[pa.RecordBatch], length: int, kind: str, total: int, key: int, per_shard: int) -> Iterator[pa.RecordBatch]:
    """Sequences with their slots, those for one shard together."""
    press, open_up = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    numbers: list[np.ndarray] = []
    records: list[np.ndarray] = []
    tokens: list[int] = []
    docs: list[list] = []

    def out() -> pa.RecordBatch:
        number, record = np.concatenate(numbers), np.concatenate(records)
        slot = permute(number.astype(np.uint64), total, key)
        order = np.argsort(slot)
        shard = slot[order] // per_shard
        cuts = np.flatnonzero(np.diff(shard)) + 1
        rows = []
        for some in np.split(order, cuts):
            rows.append({"shard": int(slot[some[0]] // per_shard), "slots": slot[some].tolist(), "sequences": number[some].tolist(), "tokens": [tokens[i] for i in some], "docs": [docs[i] for i in some], "ids": press.compress(record[some].tobytes())})
        return pa.RecordBatch.from_pylist(rows, _HANDED)

    for b in batches:
        for start, n, t, d, packed in zip(*(b.column(k).to_pylist() for k in ("start", "n", "tokens", "docs", "ids")), strict=True):
            numbers.append(start + np.arange(n))
            records.append(np.frombuffer(open_up.decompress(packed), kind).reshape(n, length))
            tokens += t
            docs += d
            if len(tokens) >= GATHERED:
                yield out()
                numbers, records, tokens, docs = [], [], [], []
                give_back()
    if tokens:
        yield out()
    give_back()


_MANIFEST = "slot long, sequence long, shard long, record long, n_tokens int, doc_ids array<long>"


def _shard(table: pa.Table, folder: str, length: int, kind: str, per_shard: int) -> pa.Table:
    """Writes one shard; it appears under its name when it is complete, so a task that is run again does no harm."""
    open_up = zstandard.ZstdDecompressor()
    rows = table.to_pylist()
    slots = np.concatenate([r["slots"] for r in rows]).astype(np.int64)
    records = np.concatenate([np.frombuffer(open_up.decompress(r["ids"]), kind).reshape(-1, length) for r in rows])
    order = np.argsort(slots)
    files, base = pafs.FileSystem.from_uri(folder)
    shard = int(slots[0]) // per_shard
    temporary = f"{base}/_{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as f:
        f.write(np.ascontiguousarray(records[order]).tobytes())
    files.move(temporary, f"{base}/shard-{shard:08d}.bin")
    flat = {k: [x for r in rows for x in r[k]] for k in ("sequences", "tokens", "docs")}
    made = {"slot": slots[order], "sequence": [flat["sequences"][i] for i in order], "shard": np.full(len(slots), shard), "record": slots[order] % per_shard, "n_tokens": pa.array([flat["tokens"][i] for i in order], pa.int32()), "doc_ids": pa.array([flat["docs"][i] for i in order], pa.list_(pa.int64()))}
    give_back()
    return pa.table(made)


def materialise(docs: DataFrame, folder: str, length: int, end: int, pad: int, key: int = 0, kind: str = "<u2", per_shard: int = 4096, id_column: str = "doc_id", ids_column: str = "ids", encode: Callable = listed) -> DataFrame:
    """Write the token ids of ``docs`` to ``folder`` in training order, and return the manifest: ``slot``, ``sequence``
    (number before the permutation), ``shard``, ``record`` (in the shard), ``n_tokens`` (before padding) and ``doc_ids``
    (of the documents in the sequence, in order).

    ``encode`` turns an Arrow array of the ids column into ids and bounds; by default the column holds lists of ids.
    ``folder`` is a URI that executors can write to (anything ``pyarrow.fs`` opens). Every document ends with the id
    ``end``; null and empty documents are that id alone. Ids are whole numbers; rows without one stay (null in
    ``doc_ids``). Repeated rows are written as often as they occur, one after the other. A document of any length goes on
    over as many sequences as it takes. An empty table writes no shard. Other columns are ignored. Sequences, slots and
    files are the same whatever the input's partitions and order: documents follow a hash of id and content (ties by id
    and content) in buckets by that hash.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    chosen = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{ids_column}`").alias("ids"))
    ids_are_text = not isinstance(docs.schema[ids_column].dataType, ArrayType)
    amount = chosen.agg(F.sum(F.octet_length(F.col("ids").cast("string"))) if ids_are_text else F.sum(4 * F.greatest(F.size("ids"), F.lit(0)))).first()[0] or 0
    placed = chosen.withColumn("key", F.xxhash64("doc_id", "ids")).withColumn("bucket", F.pmod("key", F.lit(amount // BUCKET_BYTES + 1)))
    sorted_rows = placed.repartition("bucket").sortWithinPartitions("bucket", "key", "doc_id", "ids").select("doc_id", "ids", "bucket")
    packed = cut(sorted_rows.mapInArrow(lambda it: _packed(it, encode, length, end, pad, kind), _PACKED_SQL))
    sums = packed.groupBy("part").agg(F.sum("n").alias("size"))
    sums = cut(sums.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    parts, total = sums.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    offsets = sums.select("part", "before")
    placed = packed.join(F.broadcast(offsets) if parts <= BROADCAST_PARTS else offsets, "part").select((F.col("before") + F.col("first")).alias("start"), "n", "tokens", "docs", "ids")
    handed = placed.mapInArrow(lambda it: _handed(it, length, kind, total, key, per_shard), _HANDED_SQL)
    files, base = pafs.FileSystem.from_uri(folder)
    files.create_dir(base, recursive=True)
    manifest = cut(handed.groupBy("shard").applyInArrow(lambda t: _shard(t, folder, length, kind, per_shard), _MANIFEST))
    discard(packed, sums)
    with files.open_output_stream(f"{base}/meta.json") as out:
        out.write(json.dumps({"sequences": total, "length": length, "end": end, "pad": pad, "key": key, "kind": kind, "per_shard": per_shard}).encode())
    return manifest


def read_slots(folder: str, start: int, count: int) -> np.ndarray:
    """The records of consecutive slots, as an array of shape (slots, length), read by seeking."""
    files, base = pafs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{base}/meta.json") as f:
        meta = json.loads(f.read())
    stride = meta["length"] * np.dtype(meta["kind"]).itemsize
    stop, parts = min(start + count, meta["sequences"]), []
    while start < stop:
        shard, record = divmod(start, meta["per_shard"])
        n = min(stop - start, meta["per_shard"] - record)
        with files.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
            f.seek(record * stride)
            parts.append(f.read(n * stride))
        start += n
    return np.frombuffer(b"".join(parts), meta["kind"]).reshape(-1, meta["length"])


def record_digests(spark: SparkSession, folder: str, length: int, kind: str, per_shard: int) -> DataFrame:
    """(slot, record_sha256) of every record in the shards, read back from the files."""
    stride = length * np.dtype(kind).itemsize

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                first = int(path.as_py().rsplit("shard-", 1)[1].split(".")[0]) * per_shard
                raw = content.as_buffer()
                found = [sha256(raw[k : k + stride]).hexdigest() for k in range(0, len(raw), stride)]
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(found)), pa.int64()), pa.array(found)], ["slot", "record_sha256"])

    shards = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder)
    return shards.select("path", "content").mapInArrow(digests, "slot long, record_sha256 string")
