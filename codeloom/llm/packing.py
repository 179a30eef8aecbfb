"""Best-fit packing of tokenized documents into sequences.

Bounded-space online best-fit: a task holds at most ``OPEN_BINS`` open
sequences in a bitset keyed by free space; a piece goes to the fullest
sequence that still has room, found with one bit operation. If none has room
and all places are taken, the fullest sequence is closed. Pieces wait in a
bounded look-ahead and the longest of it goes first. A piece's place is known
when it is placed, so rows leave at once and there is no shuffle at all.

Tokens come from the ``tokenizers`` file; its pre-tokens are looked up in a
bounded memo, and only new ones are encoded. Texts with characters for which
the split isn't certain go to the tokenizer whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import text_batches

CAPACITY = 2048
OPEN_BINS = 1024
#: Pieces that wait and are placed longest first. Many more than the open
#: sequences would fill all of these with long pieces before the short ones come.
LOOKAHEAD = 1024
#: Pre-tokens held by one worker.
MEMO = 1_000_000

#: Anything but ASCII and the Latin letters whose case and form are plain.
_ODD = re.compile("[^\x00-\x7fÀ-ÖØ-öø-įĲ-ſ]|<\\|")
#: Classes of UTF-8 bytes of a text without odd characters.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.array([_SPACE if b in (32, 9, 10, 11, 12, 13) else _LETTER if b >= 128 or 97 <= b <= 122 else _DIGIT if 48 <= b <= 57 else _OTHER for b in range(256)], np.uint8)


def pre_tokens(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokenizer's pre-tokens in lower-cased bytes:
    runs of letters, single digits, runs of other characters, and the endings
    's 't 'm 'd 're 've 'll where the apostrophe begins such a run."""
    kind = _CLASS[raw]
    first = kind != _SPACE
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    quote = np.flatnonzero((raw == 39) & first)
    quote = quote[quote + 1 < len(raw)]
    if len(quote):
        one = raw[quote + 1]
        two = raw[np.minimum(quote + 2, len(raw) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (((one == 114) | (one == 118)) & (two == 101)) | ((one == 108) & (two == 108))
        long &= quote + 2 < len(raw)
        first[quote[short | long] + 1] = False
        for at in (quote[short] + 2, quote[long] + 3):
            at = at[at < len(raw)]
            first[at] |= kind[at] == _LETTER
    last = kind != _SPACE
    last[:-1] &= (kind[1:] == _SPACE) | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Encoder:
    """Ids of whole texts, equal to those of the tokenizer file.

    Pre-tokens are looked up by 64-bit hash in a memo of ``MEMO`` entries. A
    full memo keeps what it has; pre-tokens beyond it are encoded anew in each
    batch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = K.Memo(MEMO)
        self.start = np.zeros(MEMO, np.int64)
        self.size = np.zeros(MEMO, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the pre-tokens at these places."""
        data = raw.tobytes()
        words = [data[s:e].decode() for s, e in zip(starts.tolist(), ends.tolist())]
        flat: list[int] = []
        sizes = []
        for at in range(0, len(words), 1 << 13):
            for e in self.tokenizer.encode_batch_fast(words[at : at + (1 << 13)], add_special_tokens=False):
                ids = e.ids
                sizes.append(len(ids))
                flat += ids
        return np.array(sizes, np.int64), np.array(flat, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        odd = [i for i, t in enumerate(texts) if ("<|" in t if t.isascii() else _ODD.search(t))]
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False) if odd else []):
            out[i] = np.array(e.ids, np.uint32)
        plain = [i for i in range(len(texts)) if out[i] is None]
        if not plain:
            return out  # type: ignore[return-value]
        lowered = [texts[i].lower().encode() for i in plain]
        raw = np.frombuffer(b"\n".join(lowered), np.uint8)
        starts, ends = pre_tokens(raw)
        h = np.maximum(K.hash_tokens(raw, starts, ends), K.U(1))
        k = self.memo.find(h)
        miss = np.flatnonzero(k < 0)
        start, size, ids = self.start, self.size, self.ids
        if len(miss):
            new, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            more_size, more_ids = self._encode(raw, starts[miss[at]], ends[miss[at]])
            n, fits = self.memo.count, self.memo.count + len(new) <= MEMO
            if fits:
                k[miss] = n + back
                if self.used + len(more_ids) > len(ids):
                    self.ids = ids = np.resize(ids, 2 * (self.used + len(more_ids)))
                ids[self.used : self.used + len(more_ids)] = more_ids
                start[n : n + len(new)] = self.used + np.cumsum(more_size) - more_size
                size[n : n + len(new)] = more_size
                self.memo.add(new, np.arange(n, n + len(new), dtype=np.int32))
                self.used += len(more_ids)
            else:
                k[miss] = len(start) + back
                start = np.r_[start, len(ids) + np.cumsum(more_size) - more_size]
                size, ids = np.r_[size, more_size], np.r_[ids, more_ids]
        part = size[k]
        done = np.cumsum(part)
        total = int(done[-1]) if len(done) else 0
        ids = ids[np.arange(total) + np.repeat(start[k] - (done - part), part)]
        begin = np.cumsum(np.r_[0, [len(t) + 1 for t in lowered]])
        bounds = np.r_[0, done][np.searchsorted(starts, begin)]
        for j, i in enumerate(plain):
            out[i] = ids[bounds[j] : bounds[j + 1]]
        return out  # type: ignore[return-value]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file; its memo outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class BestFit:
    """Open sequences by free space; ``place`` gives (sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, bins: int = OPEN_BINS, first: int = 0):
        self.capacity, self.bins, self.next = capacity, bins, first
        self.bits = 0
        self.open = 0
        self.closed = 0  # for want of a place
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        rest = self.bits >> length
        if rest:
            free = length + (rest & -rest).bit_length() - 1
            seq = self._take(free)
        else:
            if self.open >= self.bins and length < self.capacity:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
                self.closed += 1
            free, seq = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            self.by_free[left].append(seq)
            self.bits |= 1 << left
            self.open += 1
        return seq, self.capacity - free

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        seq = stack.pop()
        self.open -= 1
        if not stack:
            self.bits ^= 1 << free
        return seq


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _packer(path: str, capacity: int, bins: int, end: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fit = BestFit(capacity, bins, (context.partitionId() if context else 0) << 36)
        enc = encoder(path)
        wait: list[tuple] = []

        def flush() -> pa.RecordBatch:
            wait.sort(key=lambda r: -r[3])
            rows = [(*r, *fit.place(r[3])) for r in wait]
            wait.clear()
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts)):
                if end is not None:
                    ids = np.append(ids, np.uint32(end))
                for p, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    wait.append((doc, p, start, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            if len(wait) >= LOOKAHEAD:
                yield flush()
        if wait:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, bins: int = OPEN_BINS, end: int | None = 0) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    docs: doc_id, text. Ids are those of the tokenizer file plus ``end``, where
    it isn't None. Only documents longer than ``capacity`` are cut, into
    pieces of that length; the last may be shorter. Null and empty texts are
    the end id alone (no row, if that is None). Repeated rows are packed each
    for itself; ids may be null. sequence_id is unique, by task and count;
    offsets in a sequence are gapless from 0. Other columns are ignored, an
    empty table gives no rows. The same input files give the same packing.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_packer(tokenizer, capacity, bins, end), SCHEMA)
