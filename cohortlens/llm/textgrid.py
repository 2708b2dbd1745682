"""Words and shingles of many texts at once: numpy over the buffers of an Arrow column.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``; bytes of one UTF-8 character are never split, so words are the same
as on characters. Texts are handled whole, in groups of about ``BLOCK`` bytes (a longer text is a group of its own), so a
task holds one group and not one partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK * 2)
        made = []
        for base in (_PRIME, _INVERSE):
            steps = np.full(size, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (made[0], made[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])


@dataclass
class Block:
    """Texts ``lo:hi`` of a column: their bytes, and where each text begins (one more entry than texts)."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """The texts of an Arrow string column (null: empty), grouped by bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offsets, raw = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    raw = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield Block(lo, hi, raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
        lo = hi


@dataclass
class Words:
    """Words of a block in order: byte range, number of the text, hash. ``first[i]:first[i+1]`` are the words of text i."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(block: Block, lower: bool = False) -> Words:
    data, bounds = block.data, block.bounds
    n, docs = len(data), len(bounds) - 1
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, none.astype(np.uint64), np.zeros(docs + 1, dtype=np.int64))
    space = SPACE[data]
    before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
    before[0] = after[-1] = True
    before[1:] = space[:-1]
    after[:-1] = space[1:]
    inner = bounds[1:-1]
    before[inner[inner < n]] = True
    after[inner[inner > 0] - 1] = True
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    doc = np.searchsorted(bounds, start, side="right") - 1
    first = np.searchsorted(start, bounds)
    return Words(start, end, doc, span_hash(data, start, end, lower), first)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte ranges, from one running sum over the bytes."""
    n = len(data)
    power, inverse = _tables(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[data] * power[:n], dtype=np.uint64, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row (across texts too; the caller leaves those out)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _U(0xD6E8FEB86659FD93)
        out += hashes[j:j + n]
    return mix(out)


def shingle_sets(w: Words, k: int = 5) -> Iterator[np.ndarray]:
    """For every text of the block the sorted distinct shingles; with fewer than k words the whole sequence is one."""
    rolled = shingle_hash(w.hash, k)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(rolled[a:b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
        elif b > a:
            yield shingle_hash(w.hash[a:b], b - a)
        else:
            yield rolled[:0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
