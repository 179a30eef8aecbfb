"""Homomorphic multiset hash of a document's paragraphs.

A paragraph (a line with words) is hashed to a wide vector, and a document's
state is the sum of its paragraphs' vectors, each lane modulo a power of two:
``EQUAL`` lanes modulo 2^64 are words of a keyed 256-bit digest of the
paragraph's bytes (from its first word to its last) and decide equality;
``LIKE`` lanes modulo 2^32 sum +1 and -1 for the paragraph's word pairs, so
that inner products of states estimate shared pairs (a tug-of-war sketch); no
text that fits a row has enough pairs for these to wrap. Order doesn't matter,
and a paragraph is put in or taken out by adding or subtracting its vector:
``combine``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import text_batches

EQUAL, LIKE = 4, 128
KEY = b"codeloom paragraph"
#: Rows that one range of ids should hold, and the most ranges.
RANGE_ROWS, MOST_RANGES = 8192, 16384
#: Rows of the least range that is made so that all cores have work.
LEAST_ROWS = 256
_LINE = K.byte_class(lambda b: b not in (10, 13))


def states(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lanes of every text: uint64 (texts, EQUAL) and int64 (texts, LIKE)."""
    n = len(offsets) - 1
    starts, ends, bounds = K.tokens(raw, offsets, K.WORDS)
    words = K.hash_tokens(raw, starts, ends)
    equal, like = np.zeros((n, EQUAL), np.uint64), np.zeros((n, LIKE), np.int64)
    if not len(words):
        return equal, like
    lines, _, _ = K.tokens(raw, offsets, _LINE)
    line_of = np.searchsorted(lines, starts, "right")
    new = np.r_[True, line_of[1:] != line_of[:-1]]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:], len(words)] - 1
    data = raw.tobytes()
    digests = b"".join(hashlib.blake2b(data[a:b], digest_size=8 * EQUAL, key=KEY).digest() for a, b in zip(starts[begin].tolist(), ends[last].tolist()))
    whole = np.frombuffer(digests, "<u8").reshape(-1, EQUAL)
    per_text = np.searchsorted(begin, bounds)
    for j in range(EQUAL):
        equal[:, j] = K.reduce_segments(np.add, np.ascontiguousarray(whole[:, j]), per_text, K.U(0))
    # word pairs within a line; a line of one word has that word
    nxt = np.r_[words[1:], K.U(0)]
    final = np.r_[new[1:], True]
    pair = K.mix(words * K.U(3) + np.where(final, K.U(0), K.mix(nxt)))
    keep = ~final | new
    pair = pair[keep]
    count = np.searchsorted(np.flatnonzero(keep), bounds)
    size = np.diff(count)
    # at most 65535 in a segment, so that 16-bit sums of single bits don't carry
    cuts = np.unique(np.concatenate([np.arange(a, b, 65535) for a, b in zip(count[:-1][size > 0], count[1:][size > 0])])) if (size > 65535).any() else count[:-1][size > 0]
    owner = np.searchsorted(count, cuts, "right") - 1
    mask = K.U(0x0001000100010001)
    for w in range(LIKE // 64):
        h = pair if w == 0 else K.mix(pair + K.U(w * 0xA0761D6478BD642F % 2**64))
        for b in range(16):
            sums = np.add.reduceat((h >> K.U(b)) & mask, cuts)
            for lane in range(4):
                part = ((sums >> K.U(16 * lane)) & K.U(0xFFFF)).astype(np.int64)
                np.add.at(like[:, w * 64 + lane * 16 + b], owner, part)
    like *= 2
    like -= size[:, None]
    return equal, like


def render(equal: np.ndarray, like: np.ndarray) -> list[str]:
    """Fingerprints: the lanes, little-endian, in base64."""
    rows = np.concatenate([equal.astype("<u8").view(np.uint8).reshape(len(equal), -1), like.astype("<i8").astype("<i4").view(np.uint8).reshape(len(like), -1)], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in rows]


def parse(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * EQUAL], "<u8").astype(np.uint64), np.frombuffer(raw[8 * EQUAL :], "<i4").astype(np.int64)


def combine(fingerprint: str, other: str, sign: int = 1) -> str:
    """The fingerprint of the union of two multisets of paragraphs; with
    sign -1 the other's paragraphs are taken out."""
    (e, x), (f, y) = parse(fingerprint), parse(other)
    return render((e + f if sign > 0 else e - f)[None], (x + sign * y)[None])[0]


def likeness(e: np.ndarray, x: np.ndarray, f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row: 1 for equal states, else an estimate, below 1, of the Dice
    coefficient 2 fg / (ff + gg) of the word pairs' frequencies f and g."""
    same = (e == f).all(1) & (x == y).all(1)
    x, y = x.astype(np.float64), y.astype(np.float64)
    total = (x * x).sum(1) + (y * y).sum(1)
    dice = np.divide(2 * (x * y).sum(1), total, out=np.zeros(len(x)), where=total > 0)
    return np.where(same, 1.0, np.clip(dice, 0.0, 1.0 - 1e-6))


def _states_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts, batch = [], pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
    for part in K.blocks(batch, "text"):
        parts.append(states(*K.buffers(part.column("text"))))
    if not parts:
        return np.zeros((0, EQUAL), np.uint64), np.zeros((0, LIKE), np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with ``fingerprint``. Null texts count as empty; the
    empty text's state is zero. Other columns are kept out."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = render(*_states_of([t or "" for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


EDIT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, tail, doc_id): each with its successor, which is
    the next row of the range; a range's tail row serves its last document."""
    held: tuple | None = None
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("range", "tail", "doc_id", "text"))))
        if held:
            rows.insert(0, held)
        if not rows:
            continue
        texts = [r[3] or "" for r in rows]
        held = rows[-1] if not rows[-1][1] else None
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not pairs:
            continue
        e, x = _states_of(texts)
        edited = []
        for i in pairs:
            n = len(texts[i])
            edited.append(texts[i][: n - n // 2] + texts[i + 1][: n // 2])
        ee, xx = _states_of(edited)
        a = np.array(pairs)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in pairs], pa.int64()),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(render(e[a], x[a])),
                pa.array(render(ee, xx)),
                pa.array(likeness(e[a], x[a], ee, xx)),
                pa.array(likeness(e[a], x[a], e[a + 1], x[a + 1])),
            ],
            names=[c.split()[0] for c in EDIT_SCHEMA.split(", ")],
        )


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of edited texts and of the next documents.

    A text's last floor(n / 2) code points are replaced by the first as many
    (or all) of the next document's in ascending doc_id; after the last comes
    the first. Null ids come before all others; rows that repeat an id come in
    order of their text. Null texts are empty. A table of one row is its own
    next; an empty one gives no rows. Other columns are ignored.

    The order needs one shuffle of the texts, by ranges of ids from approximate
    quantiles, a partition each; a range is sorted on disk where it must be,
    streamed and never held whole. Only range borders, at most
    ``MOST_RANGES``, come to the driver. Ids are meant to be few rows each: all
    rows of one id fall in one range, whose task then streams them.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    least = -(1 << 63)
    ids = docs.select(F.coalesce("doc_id", F.lit(least)).alias("id"))
    rows = ids.count()
    wanted = min(MOST_RANGES, max(1, -(-rows // RANGE_ROWS), min(2 * spark.sparkContext.defaultParallelism, rows // LEAST_ROWS)))
    splits: list[int] = []
    if wanted > 1:
        splits = sorted(set(ids.agg(F.percentile_approx("id", [i / wanted for i in range(1, wanted)], 10 * wanted)).first()[0]))
    border = np.array(splits, np.int64)

    @F.pandas_udf("int")
    def range_of(id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(border, id.to_numpy(np.int64), "right").astype(np.int32))

    first = {r["range"]: r["id"] for r in ids.groupBy(range_of("id").alias("range")).agg(F.min("id").alias("id")).collect()}
    order = sorted(first)
    before = {first[r]: order[i - 1] for i, r in enumerate(order)}  # of the first range: the last

    @F.pandas_udf("array<int>")
    def places(id: pd.Series) -> pd.Series:
        at = np.searchsorted(border, id.to_numpy(np.int64), "right").tolist()
        return pd.Series([[r, -1 - before[i]] if i in before else [r] for r, i in zip(at, id.tolist())])

    placed = docs.select("doc_id", "text", F.explode(places(F.coalesce("doc_id", F.lit(least)))).alias("place"))
    placed = placed.select(
        F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("range"),
        (F.col("place") < 0).alias("tail"),
        "doc_id",
        "text",
    )
    return placed.repartitionById(len(splits) + 1, "range").sortWithinPartitions("range", "tail", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")).mapInArrow(_edits, EDIT_SCHEMA)
