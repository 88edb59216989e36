"""Byte-level BPE through sentencepiece, with a model serialised straight from a rank table.

Every token of the table becomes a piece: its bytes mapped one by one to printable characters, its score the negative
rank, so that sentencepiece merges exactly the pair that a rank table would merge next. Normalisation is the identity.
Pre-tokens are encoded one by one; ids are the ranks. Decoding maps ids back to bytes.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravox.llm.words import _powers_to, free_name, give_back, mix, ragged
from terravox.plans.storage import bound_batches

#: Distinct pre-tokens whose ids a worker remembers; beyond it starts anew. It bounds memory, not results.
REMEMBERED = 500_000
#: Characters of text handled at a time (or one text).
BATCH_CHARS = 1 << 19


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a file of lines "base64 rank", by rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be gapless from 0")
    return [t for _, t in pairs]


def byte_characters() -> list[str]:
    """A printable character for each byte: its own where Latin-1 has one, else the next free one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protocol buffer field: bytes as length-delimited, an int as varint."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model of the tokens: ids are ranks, and one id more is <unk>."""
    table = dict(enumerate(byte_characters()))
    score = lambda x: _varint(2 << 3 | 5) + np.float32(x).tobytes()
    pieces = [_field(1, _field(1, t.decode("latin-1").translate(table).encode()) + score(-rank)) for rank, t in enumerate(tokens)]
    unknown = _field(1, _field(1, b"<unk>") + score(0) + _field(3, 2))
    no_id = (1 << 64) - 1  # -1 as a varint
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + _field(41, no_id) + _field(42, no_id) + _field(43, no_id)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*pieces, unknown, _field(2, trainer), _field(3, normalizer)])


def _gather(table: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a flat byte table for the ids, one after the other, and where each begins (and the last ends)."""
    lengths = (offsets[1:] - offsets[:-1])[ids]
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return table[np.arange(ends[-1]) + np.repeat(offsets[ids] - ends[:-1], lengths)], ends


def _flat(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(entries), np.uint8), np.concatenate(([0], np.cumsum([len(e) for e in entries])))


@functools.cache
def _classes() -> np.ndarray:
    """For every code point: 0 white space, 1 letter, 2 number, 3 anything else."""
    table = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    for kind, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (0, r"\s")):
        for m in regex.finditer(f"{pattern}+", every):
            table[np.array([ord(c) for c in m[0]])] = kind
    return table


#: The pattern whose matches _split() finds without a regular expression.
CLASS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHORTENED = regex.compile(r"'(?:[stmd]|re|ve|ll)")


def _split(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts (code points, one after the other) begin, for texts without '-contractions: runs of
    one class, with the one space before a run; of longer white space before a run the last character stands alone."""
    n = len(points)
    kind = _classes()[points]
    heads = off[:-1][off[:-1] < n]
    fresh = np.zeros(n + 1, bool)
    fresh[heads] = True
    fresh[n] = True
    begin = fresh.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    lead = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & ~fresh[1:n]) if n else np.zeros(0, np.int64)
    begin[lead] = True
    begin[lead[points[lead] == 0x20] + 1] = False
    return np.flatnonzero(begin[:n])


class ByteBPE:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.pattern = regex.compile(pattern)
        self.by_class = pattern == CLASS_PATTERN
        self.characters = dict(enumerate(byte_characters()))
        self.tokens = _flat(tokens)
        self.decimals = _flat([b"%d " % i for i in range(len(tokens))])
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # of known pre-tokens, sorted
        self.place = np.zeros(1, np.int64)  # where the ids of each begin, and the last's end
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pretokens: list[str]) -> None:
        mapped = [p.encode().decode("latin-1").translate(self.characters) for p in pretokens]
        made = self.processor.encode(mapped, num_threads=1)
        lengths = np.concatenate((np.diff(self.place), [len(x) for x in made]))
        ids = np.concatenate((self.ids, np.fromiter(itertools.chain.from_iterable(made), np.uint32)))
        starts = np.cumsum(lengths) - lengths
        hashes = np.concatenate((self.hashes, hashes))
        order = np.argsort(hashes)
        self.hashes, lengths = hashes[order], lengths[order]
        self.ids = ids[ragged(starts[order], lengths)]
        self.place = np.concatenate(([0], np.cumsum(lengths)))

    def _pretokens(self, texts: list[str], points: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where the pre-tokens begin."""
        odd = np.array([not self.by_class or ("'" in t and _SHORTENED.search(t) is not None) for t in texts], bool)
        if not odd.any():
            return _split(points, off)
        found = _split(points, off) if not odd.all() else np.zeros(0, np.int64)
        of = np.searchsorted(off, found, "right") - 1
        matches = [off[i] + np.fromiter((m.start() for m in self.pattern.finditer(texts[i])), np.int64) for i in np.flatnonzero(odd)]
        return np.sort(np.concatenate([found[~odd[of]], *matches]))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (and the last's end)."""
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        begin = self._pretokens(texts, points, off)
        end = np.append(begin[1:], len(points))
        power, inverse = _powers_to(len(points))
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=total[1:])
        h = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
        for k in np.flatnonzero(end - begin > 64):  # long ones by a hash that no text can be made to defeat
            h[k] = int.from_bytes(sha256(points[begin[k] : end[k]].tobytes()).digest()[:8], "little")
        unique, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, unique), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[at] != unique) if len(self.hashes) else np.arange(len(unique))
        if len(new):
            text = "".join(texts)
            self._learn(unique[new], [text[begin[k] : end[k]] for k in first[new]])
            at = np.searchsorted(self.hashes, unique)
        starts, lengths = self.place[at][which], np.diff(self.place)[at][which]
        ids = self.ids[ragged(starts, lengths)]
        counts = np.concatenate(([0], np.cumsum(lengths)))
        return ids, counts[np.searchsorted(begin, off)]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each text."""
        data, ends = _gather(*self.tokens, ids)
        raw = data.tobytes()
        return [raw[ends[a] : ends[b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def write_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The decimal ids of each text, joined by one space."""
        data, ends = _gather(*self.decimals, ids)
        raw = data.tobytes()
        return [raw[ends[a] : max(ends[a], ends[b] - 1)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@functools.lru_cache(2)
def coder(path: str, pattern: str) -> ByteBPE:
    """One coder for each worker process."""
    return ByteBPE(read_ranks(path), pattern)


def _batches(texts: pa.Array) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts.to_pylist():
        held.append(t or "")
        size += len(held[-1])
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


_IDS = pa.list_(pa.int32())
_CODED = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_texts(texts: pa.Array, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text column, one after the other, and where each text's begin (and the last's end)."""
    bpe, ids, counts = coder(path, pattern), [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
    for some in _batches(texts):
        found, bounds = bpe.encode_all(some)
        ids.append(found)
        counts.append(np.diff(bounds))
    return np.concatenate(ids), np.cumsum(np.concatenate(counts))


def _encoded(texts: pa.Array, path: str, pattern: str) -> pa.Array:
    """Lists of ids."""
    bpe, out = coder(path, pattern), []
    for some in _batches(texts):
        ids, bounds = bpe.encode_all(some)
        out.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
    give_back()
    return pa.concat_arrays(out) if out else pa.array([], _IDS)


def _decoded(lists: pa.Array, path: str, pattern: str) -> pa.Array:
    """Bytes of lists of ids."""
    bpe, out = coder(path, pattern), []
    for k in range(0, len(lists), 256):
        some = lists[k : k + 256]
        lengths = np.array([len(x.values) if x.is_valid else 0 for x in some], np.int64)
        out += bpe.decode_all(some.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(lengths))))
    return pa.array(out, pa.binary())


def _digests(texts: pa.Array, path: str, pattern: str) -> pa.Array:
    """Encodes, decodes the ids, and gives the count of ids and the digests of their decimals and of the bytes."""
    bpe = coder(path, pattern)
    n, ids_hex, bytes_hex = [], [], []
    for some in _batches(texts):
        ids, bounds = bpe.encode_all(some)
        n += np.diff(bounds).tolist()
        ids_hex += [sha256(x).hexdigest() for x in bpe.write_all(ids, bounds)]
        bytes_hex += [sha256(x).hexdigest() for x in bpe.decode_all(ids, bounds)]
    give_back()
    return pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((n, ids_hex, bytes_hex), _CODED, strict=True)], fields=list(_CODED))


def with_ids(docs: DataFrame, path: str, pattern: str, text_column: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids (array<int>), replaced if it is there; null texts count as empty, empty texts have
    no ids, a text of any length is encoded whole, all other columns and repeated rows stay, an empty table gives no rows."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(to, F.arrow_udf(lambda t: _encoded(t, path, pattern), "array<int>")(F.col(f"`{text_column}`").cast("string")))


def with_bytes(coded: DataFrame, path: str, pattern: str, ids_column: str = "ids", to: str = "decoded") -> DataFrame:
    """``coded`` with the bytes of its token ids; a null list gives no bytes."""
    bound_batches(coded.sparkSession)
    return coded.withColumn(to, F.arrow_udf(lambda x: _decoded(x, path, pattern), "binary")(F.col(f"`{ids_column}`")))


def round_trip(docs: DataFrame, path: str, pattern: str, text_column: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space) and ``decoded_sha256`` (of the
    bytes that the ids decode to).

    Null texts count as empty; empty texts have no ids; a text of any length is encoded whole. Columns of these names are
    replaced, all others stay, whatever their names; repeated rows give repeated results; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    coded = F.arrow_udf(lambda t: _digests(t, path, pattern), "n_tokens long, ids_sha256 string, decoded_sha256 string")(F.col(f"`{text_column}`").cast("string"))
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    name = free_name(docs.columns, "_coded")
    return docs.withColumn(name, coded).select(*own, f"{name}.n_tokens", f"{name}.ids_sha256", f"{name}.decoded_sha256")
