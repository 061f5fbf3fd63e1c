"""Words of a batch of texts as numpy arrays.

A word is a maximal run of ASCII letters and digits and of bytes from 0x80 up,
with ASCII and Latin-1 letters in lower case; everything else separates. In
SQL: ``regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+')``.
A word is known by a 64-bit hash of its bytes; byte offsets lead back to the
text. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from mergeloom.llm.common import mix

WORD = np.zeros(256, bool)
WORD[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    WORD[_a:_b] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_UP1 = np.zeros(256, bool)
_UP1[0x80:0x9F] = True
_UP1[0x97] = False
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Text bytes worked on at once, and rows (a row index then fits 16 bits).
SLICE_BYTES, SLICE_ROWS = 4 << 20, 60_000


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has bounded bytes of text; a longer text is a slice alone."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        a = 0
        while a < n:
            z = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
            z = min(n, max(a + 1, z), a + SLICE_ROWS)
            yield batch.slice(a, z - a)
            a = z


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, o, d = col.buffers()
    off = np.frombuffer(o, np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def hash_ranges(low: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range, eight bytes at a time."""
    pad = np.zeros(len(low) // 8 * 8 + 24, np.uint8)
    pad[: len(low)] = low
    w = pad.view("<u8")

    def load(pos: np.ndarray, n: np.ndarray) -> np.ndarray:
        i, s = pos >> 3, ((pos & 7) << 3).astype(np.uint64)
        v = (w[i] >> s) | ((w[i + 1] << (np.uint64(63) - s)) << np.uint64(1))
        return v & _MASK[np.minimum(n, 8)]

    h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = mix(h ^ load(start, length))
    k, rest = 8, np.flatnonzero(length > 8)
    while len(rest):
        h[rest] = mix(h[rest] ^ load(start[rest] + k, length[rest] - k))
        k += 8
        rest = rest[length[rest] > k]
    return h


class Words:
    """``hash``, ``start``, ``end`` (bytes) of each word, ``doc`` of each word, ``first`` word of each row."""

    def __init__(self, col: pa.Array):
        self.data, self.off = data, off = text_bytes(col)
        n = len(data)
        is_word = WORD[data]
        begins, ends = is_word.copy(), is_word.copy()
        begins[1:] &= ~is_word[:-1]
        ends[:-1] &= ~is_word[1:]
        edge = off[(off > 0) & (off < n)]
        begins[edge] = is_word[edge]
        ends[edge - 1] = is_word[edge - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), self.count)
        self.low = low = LOWER[data]
        if n:
            latin = np.flatnonzero(data[:-1] == 0xC3) + 1
            low[latin] += np.where(_UP1[data[latin]], 32, 0).astype(np.uint8)
        self.hash = hash_ranges(low, self.start, self.end - self.start)

    def grams(self, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of every n consecutive words of a row.

        ``short``: a row of 1 to n-1 words counts as one gram of all its words.
        """
        h = window_hash(self.hash, n)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[n - 1 :]) if len(h) else np.zeros(0, np.int64)
        h = h[at]
        if short:
            rows = np.flatnonzero((self.count > 0) & (self.count < n))
            if len(rows):
                extra = np.array([_fold(self.hash[self.first[r] : self.first[r + 1]]) for r in rows], np.uint64)
                h, at = np.concatenate([h, extra]), np.concatenate([at, self.first[rows]])
        return h, at


_B = 0x9E3779B97F4A7C15


def _fold(h: np.ndarray) -> int:
    x = len(h)
    for v in h:
        x = (x * _B + int(v)) % (1 << 64)
    return x


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values, by doubling: O(log n) passes."""
    out, have, power, base = None, 0, 1, h
    bit, mult = 1, _B
    while bit <= n:
        if n & bit:
            if out is None:
                out, have = base, bit
            else:  # out covers `have` values, base the next `bit`
                m = len(h) - have - bit + 1
                if m <= 0:
                    return np.zeros(0, np.uint64)
                out = out[:m] * np.uint64(mult) + base[have : have + m]
                have += bit
        bit <<= 1
        if bit <= n:
            m = len(h) - bit + 1
            if m <= 0:
                return np.zeros(0, np.uint64)
            base = base[:m] * np.uint64(mult) + base[bit // 2 : bit // 2 + m]
            mult = mult * mult % (1 << 64)
    out = out[: max(0, len(h) - n + 1)]
    return mix(out)
