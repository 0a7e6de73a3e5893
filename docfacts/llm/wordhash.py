"""Words of whole columns of texts at once, as numpy arrays over Arrow buffers.

A word is a run of bytes other than ASCII white space (0x20, 0x09 to 0x0D), so
UTF-8 text needs no decoding. Words, shingles and windows are named by 64-bit
hashes: polynomials of their bytes modulo 2^64, mixed. Two of n different ones
share a name with a chance of about n^2 / 2^65 unless made to; for inputs made to
collide (words of over a thousand bytes) there is a second family of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at a time; a longer text is a piece of its own.
PIECE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Odd bases of two independent polynomial hashes, and of those over words.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_STEPS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F))
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (one to one)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_table(which: int, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        table = np.full(max(n, 64), _BASES[which], np.uint64)
        table[0] = 1
        have = np.cumprod(table, dtype=np.uint64)
        _powers[which] = have
    return have


class Words:
    """Words of some texts: ``doc`` (row of each word), ``start``, ``end`` (bytes in ``data``), ``first`` (index of each row's first word, one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:-1]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.rows), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A hash per word: its bytes as a polynomial, then mixed with its length."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lens = self.end - self.start
        firsts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        total = int(lens.sum())
        shift = np.repeat(self.start - firsts, lens)
        rel = np.arange(total) - np.repeat(firsts, lens)
        values = self.data[np.arange(total) + shift].astype(np.uint64)
        values += np.uint64(1)
        values *= _power_table(which, int(lens.max()) + 1)[rel]
        h = np.add.reduceat(values, firsts)
        return mix(h + lens.astype(np.uint64) * _STEPS[which])

    def grams(self, k: int, hashes: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of k words of one row."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = hashes[:n].copy()
        for j in range(1, k):
            h *= _STEPS[which]
            h += hashes[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 : k - 1 + n]) if k > 1 else np.arange(n)
        return at, mix(h[at] + np.uint64(k))


def buffers(texts: pa.Array | pa.ChunkedArray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a column of texts; null is empty; ``lower`` lower-cases A to Z."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return (_LOWER[raw] if lower else raw), offsets - offsets[0]


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes of text each, and of one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(texts):
        upto = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + most, "right")))
        yield row, upto
        row = upto


def pieces(texts: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words), some text at a time; only that is copied."""
    for row, upto in slices(texts, PIECE_BYTES):
        yield row, upto, Words(*buffers(texts.slice(row, upto - row), lower))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class Places:
    """Finds hashes in ascending ``keys``; an index over their first bits leads to about one key at a time."""

    def __init__(self, keys: np.ndarray, spare: int = 1):
        self.keys = keys
        bits = max(4, len(keys).bit_length() + spare)
        self.shift = np.uint64(64 - bits)
        self.at = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys):
            return out
        first = (wanted >> self.shift).astype(np.int64)
        at, end = self.at[first], self.at[first + 1]
        left = None
        while True:
            near = np.minimum(at, len(self.keys) - 1)
            hit = (self.keys[near] == (wanted if left is None else wanted[left])) & (at < end)
            if left is None:
                out[hit] = near[hit]
                left = np.flatnonzero(~hit & (at + 1 < end))
                at, end = at[left], end[left]
            else:
                out[left[hit]] = near[hit]
                on = ~hit & (at + 1 < end)
                left, at, end = left[on], at[on], end[on]
            if not len(left):
                return out
            at = at + 1
