"""Vectorised hashing of texts: byte chunks of Arrow batches, words, word shingles, MinHash signatures.

Words, shingles and word windows are hashed by chains and trees of a bijective mixer, never by a polynomial, whose value
is the same for whole families of different texts. ``prefix_hash`` is a polynomial: it only picks places to compare bytes at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240817)
#: A random 64-bit value for each byte.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: A-Z folded.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Words of more bytes take a library's digest.
LONG_WORD = 512
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


@lru_cache(1)
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INV):
        p = np.ones(1 << log2, U64)
        n = 1
        while n < p.size:
            p[n : 2 * n] = p[:n] * U64(pow(base, n, 1 << 64))
            n *= 2
        out.append(p)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(21, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    out = x >> U64(31)
    out ^= x
    out *= U64(0xBF58476D1CE4E5B9)
    out ^= out >> U64(29)
    out *= U64(0x94D049BB133111EB)
    out ^= out >> U64(32)
    return out


def chunks(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) with at most ``limit`` bytes, or one longer text; nulls are empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] scaled by the inverse power i: a polynomial hash of values[i:j]."""
    up, _ = powers(values.size + 1)
    out = np.zeros(values.size + 1, U64)
    np.cumsum(values * up[: values.size], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(prefix.size)
    return mix((prefix[end] - prefix[start]) * down[start])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; none crosses the end of a text."""
    gap = IS_SPACE[data]
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(~gap & (np.concatenate(([True], gap[:-1])) | edge[:-1]))
    return starts, np.flatnonzero(~gap & (np.concatenate((gap[1:], [True])) | edge[1:])) + 1


def words(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z folded) and, for each text, the index of its first word; one more at the end."""
    (out,), first = words_by(data, offsets, (seed,))
    return out, first


def words_by(data: np.ndarray, offsets: np.ndarray, seeds: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """The hashes of ``words`` for each seed, from words found and read once."""
    starts, ends = word_bounds(data, offsets)
    return hashes_at(data, starts, ends, seeds), np.searchsorted(starts, offsets)


def hashes_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """The hashes of the words from starts to ends for each seed.

    Each word is read eight bytes at a time, and each eight are mixed with what came before.
    """
    folded = np.concatenate((FOLD[data], np.zeros(8, np.uint8)))
    eight = np.ndarray((data.size + 1,), "<u8", folded, strides=(1,))
    size = ends - starts
    outs = [mix(size.astype(U64) * U64(_BASE) + U64(seed)) for seed in seeds]
    long = np.flatnonzero(size > LONG_WORD)
    at, k = np.flatnonzero((size > 0) & (size <= LONG_WORD)), 0
    while at.size:
        left = np.minimum(size[at] - 8 * k, 8).astype(U64)
        part = eight[starts[at] + 8 * k] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - left * U64(8)))
        for out in outs:
            out[at] = mix((out[at] ^ part) * U64(_BASE) + U64(k + 1))
        k += 1
        at = at[size[at] > 8 * k]
    for i in long:
        for out, seed in zip(outs, seeds, strict=True):
            out[i] = int.from_bytes(hashlib.blake2b(folded[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return outs


def chain(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the words begin to begin + size - 1, one after the other."""
    out = mix(size.astype(U64) + U64(_BASE))
    for k in range(int(size.max()) if size.size else 0):
        at = slice(None) if int(size.min()) > k else np.flatnonzero(size > k)
        out[at] = mix(out[at] * U64(_BASE) ^ hashes[begin[at] + k])
    return out


def tree(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the words begin to begin + size - 1, from hashes of 1, 2, 4, ... words: two of the largest that fits cover a span."""
    out = np.zeros(begin.size, U64)
    if not begin.size:
        return out
    level, have, most = hashes, 1, int(size.max())
    while True:
        at = np.flatnonzero((size >= have) & (size < 2 * have))
        out[at] = mix(mix(level[begin[at]] * U64(_BASE) + size[at].astype(U64)) ^ level[begin[at] + size[at] - have] * U64(_INV))
        if 2 * have > most:
            return out
        level = mix(mix(level[:-have] * U64(_BASE) + U64(have)) ^ level[have:])
        have *= 2


def sequence(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hashes of the non-empty sequences of words that begin there (one more at the end): sums of a mix of each word with its place."""
    size = np.diff(begin)
    if not size.size:
        return np.zeros(0, U64)
    place = (np.arange(hashes.size) - np.repeat(begin[:-1], size)).astype(U64)
    return mix(np.add.reduceat(mix(hashes * U64(_BASE) ^ mix(place + U64(1))), begin[:-1]) + size.astype(U64))


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles (all words as one if there are fewer) and each text's first; one more at the end."""
    count = np.diff(first)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    out_first = np.concatenate(([0], np.cumsum(size)))
    total = int(out_first[-1])
    if not total:
        return np.zeros(0, U64), out_first
    begin = np.repeat(first[:-1] - out_first[:-1], size) + np.arange(total)
    return chain(hashes, begin, np.repeat(np.minimum(count, n), size)), out_first


def shared_shingles(a: str, b: str, n: int = 5) -> tuple[int, int]:
    """Sizes of the intersection and of the union of two texts' sets of n-word shingles, from the words themselves."""
    one, two = (x.encode().translate(FOLD.tobytes()).split() for x in (a, b))
    if len(one) + len(two) < 50_000:
        x, y = ({tuple(own)} if 0 < len(own) < n else set(zip(*(own[k:] for k in range(n)), strict=False)) for own in (one, two))
        both = len(x & y)
        return both, len(x) + len(y) - both
    ids: dict[bytes, int] = {}
    # Each word is its number among the distinct words, so a shingle is a row of numbers and equality is exact.
    rows = []
    for own in (one, two):
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in own), np.int64, len(own))
        short = 0 < w.size < n
        rows.append(np.pad(w, (0, n - w.size), constant_values=-1)[None] if short else np.lib.stride_tricks.sliding_window_view(w, n) if w.size else np.zeros((0, n), np.int64))
    code = np.concatenate([r[:, 0] for r in rows]) + 1
    for k in range(1, n):
        code = code * (len(ids) + 1) + np.concatenate([r[:, k] for r in rows]) + 1
        code = np.unique(code, return_inverse=True)[1]
    x, y = np.unique(code[: len(rows[0])]), np.unique(code[len(rows[0]) :])
    both = np.intersect1d(x, y, assume_unique=True).size
    return both, x.size + y.size - both


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats."""
    parts = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate(([0], np.cumsum([p.size for p in parts]))).astype(np.int64)


def parity(values: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """Each text's bits (texts x bits / 64, uint64): whether an odd number of its values falls on each. Two texts' bits differ in at most as many places as their sets do in values."""
    n = first.size - 1
    text = np.repeat(np.arange(n), np.diff(first))
    odd = np.bincount(text * bits + (mix(values) & U64(bits - 1)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8").reshape(n, bits // 64)


class MinHash:
    """bands x rows minima; band keys from the full minima, and b low bits of every minimum packed as a signature."""

    def __init__(self, bands: int, rows: int, bits: int = 2, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, bits
        self.a = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) * U64(2) + U64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def __call__(self, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys (texts x bands, int64) and packed signatures (texts x words, int64); zeros for empty sets."""
        n = first.size - 1
        full = np.flatnonzero(np.diff(first))
        mins = np.zeros((self.a.size, n), U64)
        if full.size:
            at = first[:-1][full]
            for k in range(self.a.size):
                mins[k, full] = np.minimum.reduceat(values * self.a[k] + self.b[k], at)
        keys = np.zeros((n, self.bands), U64)
        for band in range(self.bands):
            key = np.full(n, band + 1, U64)
            for k in range(band * self.rows, (band + 1) * self.rows):
                key = mix(key * U64(_BASE) + mins[k])
            keys[:, band] = key
        per = 64 // self.bits
        low = (mix(mins) & U64((1 << self.bits) - 1)).T
        low = np.pad(low, ((0, 0), (0, -low.shape[1] % per)))
        packed = np.zeros((n, low.shape[1] // per), U64)
        for k in range(low.shape[1]):
            packed[:, k // per] |= low[:, k] << U64(self.bits * (k % per))
        return keys.view(np.int64), packed.view(np.int64)


def list_array(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Arrow lists of int64 from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(np.ascontiguousarray(values).view(np.int64)))


def matrix_array(values: np.ndarray) -> pa.Array:
    n, w = values.shape
    return list_array(values.reshape(-1), np.arange(n + 1) * w)
