"""Vectorised text primitives over Arrow string buffers.

A batch of texts is one byte buffer plus offsets. Tokens are found with a
byte-class table and hashed with a prefix polynomial, so no Python object is
made per word. Work goes in blocks of bounded bytes; a text is never cut
short, only its hashing is spread over several blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
#: Bytes hashed at once.
BLOCK = 1 << 20

_pow = np.ones(1, U)
_inv = np.ones(1, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        _pow = np.cumprod(np.r_[U(1), np.full(n, BASE)], dtype=U)
        inverse = U(pow(int(BASE), -1, 1 << 64))
        _inv = np.cumprod(np.r_[U(1), np.full(n, inverse)], dtype=U)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def byte_class(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Everything but the six ASCII white-space bytes.
WORDS = byte_class(lambda b: b not in (32, 9, 10, 11, 12, 13))
#: ASCII letters and all bytes of longer UTF-8 characters.
LETTERS = byte_class(lambda b: b >= 128 or 65 <= b <= 90 or 97 <= b <= 122)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1) of a string column; nulls have no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def tokens(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every token, and the tokens before each text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(raw))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_tokens(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each token's bytes."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK)))
        a, b = int(starts[i]), int(ends[j - 1])
        power, inverse = _powers(b - a)
        sums = np.zeros(b - a + 1, U)
        np.cumsum((raw[a:b].astype(U) + U(1)) * power[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(U)
        i = j
    return mix(out)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width``-word shingles of each text, and their bounds.

    A text with fewer words has its whole sequence as the one shingle; a text
    without words has none. ``bounds`` holds the words before each text.
    """
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out_bounds = np.r_[0, np.cumsum(count)]
    pos = np.arange(out_bounds[-1]) - np.repeat(out_bounds[:-1], count) + np.repeat(bounds[:-1], count)
    size = np.repeat(np.minimum(n, width), count)
    total = np.zeros(len(pos), U)
    for k in range(width):
        take = size > k
        w = words[np.minimum(pos + k, len(words) - 1)] if len(words) else np.zeros(0, U)
        total = np.where(take, mix(total ^ w) + w * U(2 * k + 3), total)
    return mix(total + size.astype(U)), out_bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each segment, and the new bounds."""
    seg = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, seg))
    v, s = values[order], seg[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (s[1:] != s[:-1])
    v, s = v[keep], s[keep]
    return v, np.searchsorted(s, np.arange(len(bounds)))


def blocks(batch: pa.RecordBatch, text: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text, whole rows each."""
    _, offsets = buffers(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def reduce_segments(ufunc: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """``ufunc.reduceat`` by segment, with ``empty`` for segments without values."""
    out = np.full(len(bounds) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = ufunc.reduceat(values, bounds[:-1][full])
    return out


class Memo:
    """64-bit hashes to places, by open addressing in numpy arrays."""

    def __init__(self, most: int):
        self.most, self.count = most, 0
        self.slots = 1 << (2 * most).bit_length()
        self.keys = np.zeros(self.slots, np.uint64)
        self.value = np.zeros(self.slots, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places, -1 where there is none."""
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        slot = (h >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        while len(todo):
            k = self.keys[slot]
            hit = k == h[todo]
            out[todo[hit]] = self.value[slot[hit]]
            on = ~hit & (k != 0)
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct new hashes."""
        self.count += len(h)
        todo = np.arange(len(h))
        slot = (h >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == 0)
            s, which = np.unique(slot[free], return_index=True)
            won = free[which]
            self.keys[s], self.value[s] = h[todo[won]], values[todo[won]]
            on = np.ones(len(todo), bool)
            on[won] = False
            todo, slot = todo[on], slot[on]
            slot = np.where(self.keys[slot] == 0, slot, (slot + 1) & (self.slots - 1))
