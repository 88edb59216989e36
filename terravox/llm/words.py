"""Words and word n-grams of whole texts as 64-bit hashes, computed on the UTF-8 bytes of Arrow columns with NumPy.

A word is a maximal run of bytes of one class; every class used here is exact on UTF-8, since it takes or leaves all
bytes of 0x80 and above. Hashes are polynomial in the byte position, so that one cumulative sum gives all words of a
chunk, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer text is a chunk of its own.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def give_back() -> None:
    """Return freed memory to the system, where the C library can: workers stay for later tasks, and what they once
    needed would stay with them. Powers for a text longer than a chunk go too."""
    global _powers
    if len(_powers[0]) > CHUNK + 1:
        _powers = (_powers[0][: CHUNK + 1].copy(), _powers[1][: CHUNK + 1].copy())
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for b in (_BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = (made[0], made[1])
    return _powers


def byte_class(is_word) -> np.ndarray:
    """A table of 256 values: 0 for a byte between words, else a random odd-mixed value; A-Z count as a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    table[65:91] = table[97:123]
    return np.where(np.array([is_word(b) for b in range(256)]), table, np.uint64(0))


#: Words between ASCII white space.
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words of ASCII letters, ASCII digits and everything beyond ASCII.
ALNUM = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())


class Words(NamedTuple):
    hashes: np.ndarray  #: one per word
    start: np.ndarray  #: first byte of each word in the chunk
    end: np.ndarray  #: byte after each word
    first: np.ndarray  #: index of each text's first word, and the count of words at the end


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each text; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive groups of texts of at most ``limit`` bytes (or one text): first, last + 1, bytes, offsets in them."""
    data, off = buffers(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def free_name(columns: list[str], name: str) -> str:
    """``name``, or a longer one that none of the columns begins with: for columns that a plan needs in between."""
    while any(c.lower().startswith(name) for c in columns):
        name = f"_{name}"
    return name


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray, cuts: np.ndarray | None = None) -> Words:
    """All words of a chunk, in order; at ``cuts`` (bytes, ascending) a word ends and another begins."""
    n = len(data)
    values = table[data]
    inside = values != 0
    heads = off[:-1]
    heads = heads[heads < n]
    before = np.empty(n, bool)
    before[1:] = inside[:-1]
    before[heads] = False
    after = np.empty(n, bool)
    after[:-1] = inside[1:]
    if n:
        after[-1] = False
    after[heads[heads > 0] - 1] = False
    if cuts is not None:
        before[cuts] = False
        after[cuts[cuts > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _powers_to(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(h, start, end, np.searchsorted(start, off))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count, one after the other."""
    done = np.cumsum(counts)
    return np.arange(done[-1] if len(done) else 0) + np.repeat(starts - (done - counts), counts)


def ngrams(w: Words, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and the index of each run's first word."""
    at = ragged(w.first[:-1], np.maximum(np.diff(w.first) - size + 1, 0))
    return gram_hash([w.hashes[at + k] for k in range(size)], seed), at


def gram_hash(parts: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """One hash for each position from the words there; their order counts."""
    total = np.full(len(parts[0]), (len(parts) + 1000 * seed) * 0x2545F4914F6CDD1D % (1 << 64), np.uint64)
    for k, p in enumerate(parts):
        total += p * np.uint64((_BASE * (2 * k + 1)) % (1 << 64) | 1)
        total = (total << np.uint64(7)) | (total >> np.uint64(57))
    return mix(total)


def sequence_hash(h: np.ndarray) -> int:
    """The hash of one whole sequence of words, of any length."""
    return int(gram_hash([h[k : k + 1] for k in range(len(h))])[0])


def beginnings(data: np.ndarray, w: Words, table: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the hashes of the first so many bytes of all words that have them, and which words those are."""
    power, inverse = _powers_to(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[: len(data)], out=total[1:])
    for size in sizes:
        of = np.flatnonzero(w.end - w.start >= size)
        a = w.start[of]
        yield mix((total[a + size] - total[a]) * inverse[a] + np.uint64((1000 + size) * _BASE % (1 << 64))), of
