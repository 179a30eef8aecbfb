"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the list of the ``PROFILE`` most frequent character n-grams
(1 to 3 code points of lower-cased words with a mark at either end). A text
goes to the language whose profile is nearest by out-of-place distance: the
sum over the text's own most frequent n-grams of the difference of ranks, or
``PROFILE`` where the language's profile lacks the n-gram.

Three code points fit into an integer, so n-grams are counted exactly with
sorted integer arrays; whole texts are counted, in training as in prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches

PROFILE = 300
MARK = ord("_")
UNKNOWN = "und"
#: N-grams a training task holds before it passes its counts on.
HELD = 1_000_000
#: Code points whose n-grams are sorted at once, if no word is longer.
PIECE = 1 << 20

_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower case (where it is one code point) and whether it is a letter."""
    if not _tables:
        lower = np.arange(0x110000, dtype=np.int64)
        letter = np.zeros(0x110000, bool)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                letter[c] = True
                low = s.lower()
                if len(low) == 1:
                    lower[c] = ord(low)
        _tables.append((lower, letter))
    return _tables[0]


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, with repeats; none without a letter."""
    lower, letter = _letters()
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    inside = letter[c]
    if not inside.any():
        return np.zeros(0, np.int64)
    # every run of other characters becomes one mark
    c = np.where(inside, lower[c], MARK)
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    c = c[keep]
    if c[0] != MARK:
        c = np.r_[MARK, c]
    if c[-1] != MARK:
        c = np.r_[c, MARK]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[c != MARK], two, three[c[1:-1] != MARK]])


def counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.r_[first, len(codes)])


def pieces(text: str) -> Iterator[str]:
    """A text in parts of about ``PIECE`` code points that end between words,
    so that the counts of the parts add up to those of the whole."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        yield text[at:end]
        at = end


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.zeros(len(codes), np.int64)
    np.add.at(n, back, np.concatenate([p[1] for p in parts]))
    return codes, n


def counts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the n-grams of several whole texts, some ``PIECE`` at a time."""
    parts, some, size = [], [], 0
    for text in texts:
        for piece in pieces(text) if len(text) > PIECE else (text,):
            some.append(ngrams(piece))
            size += len(piece)
            if size >= PIECE:
                parts.append(counts(np.concatenate(some)))
                some, size = [], 0
    if some or not parts:
        parts.append(counts(np.concatenate([np.zeros(0, np.int64), *some])))
    return _merge(parts)


def ranked(text: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    codes, n = counts_of([text])
    return codes[np.argsort(-n, kind="stable")[:size]]


class Profiles:
    """Rank of every n-gram in every language's profile, as one table."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted(profiles)
        self.codes = np.array(sorted({c for p in profiles.values() for c in p}), np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            for r, c in enumerate(profiles[lang]):
                self.ranks[np.searchsorted(self.codes, c), j] = r

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and 1 less its distance over the greatest possible."""
        own = ranked(text, self.size) if text else np.zeros(0, np.int64)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        known = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == own)
        r = self.ranks[np.where(known, at, len(self.codes))]
        far = np.where(r < 0, self.size, np.abs(r - np.arange(len(own))[:, None])).sum(0)
        best = int(np.argmin(far))  # ties: the first language by code point
        return self.langs[best], float(max(0.0, 1.0 - far[best] / (self.size * len(own))))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, n = _merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])
        held.clear()

    for batch in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if text:
                texts.setdefault(lang, []).append(text)
        for lang, some in texts.items():
            part = counts_of(some)
            held.setdefault(lang, []).append(part)
            size += len(part[0])
        if size > HELD:
            for lang in held:
                held[lang] = [_merge(held[lang])]
            size = sum(len(p[0][0]) for p in held.values())
            if size > HELD // 2:
                yield from flush()
                size = 0
    yield from flush()


def learn(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles from all rows of docs (text, lang) with a lang and a letter.

    Counts of n-grams are summed on the executors; only the profiles, ``size``
    integers a language, come to the driver.
    """
    text_batches(docs.sparkSession)
    rows = docs.filter("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    total = rows.mapInArrow(_gather, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in total.withColumn("place", place).filter(F.col("place") <= size).collect():
        profiles.setdefault(r["lang"], []).append((r["place"], r["code"]))
    return Profiles({lang: [c for _, c in sorted(p)] for lang, p in profiles.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str | Column] | None = None) -> DataFrame:
    """docs with lang_pred and score, both from the text alone.

    keep: columns of docs to carry along (all, by default, but any of the names
    that are added). A null text or one
    without a letter gives ``und`` and 0, as does an empty set of profiles.
    Repeated rows give equal results; an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    cols = [F.col(f"`{c}`") if isinstance(c, str) else c for c in (keep if keep is not None else [c for c in docs.columns if c.lower() not in ("lang_pred", "score")])]
    rows = docs.select(F.struct(*cols).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["row", "lang_pred", "score"],
            )

    kind = rows.schema["row"].dataType
    schema = T.StructType([T.StructField("row", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(f"row.`{f.name}`").alias(f.name) for f in kind.fields), "lang_pred", "score")
