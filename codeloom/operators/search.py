"""Full-text, vector and fused search.

BM25 over a fixed query needs no inverted index: term counts and lengths are
computed in one scan, which keeps those of documents with a term and observes
the few sums over all. For many queries
``postings`` gives the index, to be written once, and ``bm25_postings`` reads
only the query's terms of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..functions.vector import cosine_distance
from ..schema import RRF_K
from ..session import ship, spread, written

K1, B = 1.2, 0.75
_CHAR = r"[\p{L}\p{N}]"
#: A token: a run of letters and digits of two bytes or more.
_TOKEN = rf"{_CHAR}{{2,}}|[\p{{L}}\p{{N}}&&[^\x00-\x7F]]"


def query_terms(text: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+|_+", text.lower()) if len(t.encode()) > 1]


def _idf(n: Column | int, df: Column) -> Column:
    return F.log(1 + (F.lit(n) - df + 0.5) / (0.5 + df))


def _term_counts(docs: DataFrame, text: Column | str, terms: list[str], keys: list[str]) -> DataFrame:
    """keys, dl (tokens) and tf (of each term) of every document; two passes
    of a regular expression over a text."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    found = F.regexp_extract_all("_low", F.lit(rf"(?<!{_CHAR})(?:{'|'.join(map(re.escape, terms)) or '(?!)'})(?!{_CHAR})"), F.lit(0))

    def count(term: str) -> Column:
        return F.size(F.filter("_hits", lambda t: t == F.lit(term)))

    counts = F.array(*map(count, terms)) if terms else F.array().cast("array<int>")
    length = F.coalesce(F.regexp_count("_low", F.lit(_TOKEN)), F.lit(0))
    narrow = spread(docs).select(*keys, low.alias("_low")).select(*keys, length.alias("dl"), F.coalesce(found, F.array().cast("array<string>")).alias("_hits"))
    return narrow.select(*keys, "dl", counts.alias("tf"))


def _stats(terms: list[str]) -> list[Column]:
    return [F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count(F.when(F.col("tf")[i] > 0, 1)).alias(f"df{i}") for i in range(len(terms)))]


def _score(terms: list[str], stat) -> Column:
    """BM25 of a row with dl and tf; stat gives n, avgdl and df0, df1 ..."""
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.col("tf")[i].cast("double")
        score = score + _idf(stat("n"), stat(f"df{i}")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / stat("avgdl")))
    return score


def bm25(docs: DataFrame, text: Column | str, query: str, keys: list[str]) -> DataFrame:
    """(keys, score) of documents with any of the query's terms; a term that
    the query repeats counts as often. Scores are not rounded.

    Texts are read once: the sums over all documents are observed while the
    counts of those with a term are written to the shared folder.
    """
    terms = query_terms(query)
    counted = _term_counts(docs, text, terms, keys)
    if not terms:
        return counted.select(*keys, F.lit(0.0).alias("score")).filter("false")
    seen = Observation()
    hits = written(counted.observe(seen, *_stats(terms)).filter(F.exists("tf", lambda x: x > 0)))
    sums = seen.get
    return hits.select(*keys, _score(terms, lambda name: F.lit(sums[name] or (1.0 if name == "avgdl" else 0))).alias("score"))


def postings(docs: DataFrame, text: Column | str, key: str) -> DataFrame:
    """(term, key, tf, dl): the inverted index. Write it partitioned or
    bucketed by term; terms are counted before the shuffle."""
    words = docs.select(key, tokens(text).alias("w"))
    return words.select(key, F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf")).select("term", key, "tf", "dl")


def bm25_postings(index: DataFrame, query: str, key: str, docs: int, mean_length: float) -> DataFrame:
    terms = query_terms(query)
    times = {t: terms.count(t) for t in terms}
    hits = index.filter(F.col("term").isin(list(times)))
    weight = F.create_map(*(F.lit(x) for kv in times.items() for x in kv))[F.col("term")]
    df = F.count("*").over(W.partitionBy("term"))
    part = weight * _idf(docs, df) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean_length))
    return hits.withColumn("part", part).groupBy(key).agg(F.sum("part").alias("score"))


def ranked(scores: DataFrame, keys: list[str], k: int | None = None, by: str = "score", partition: list[str] | None = None) -> DataFrame:
    """Adds rank from 1, best score first, ties by keys."""
    if partition is None and k is not None:
        scores = scores.orderBy(F.desc(by), *keys).limit(k)
    w = W.partitionBy(*(partition or [])).orderBy(F.desc(by), *keys)
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)


def fts(docs: DataFrame, text: Column | str, query: str, label: str, key: str, path: str, limit: int) -> DataFrame:
    """(path, score, rank): the best ``limit`` of each label, summed by path.

    All labels in one pass: their sums are a small table, joined to the counts
    of the documents with a term.
    """
    terms = query_terms(query)
    counted = written(_term_counts(docs, text, terms, [key, path, label]))
    stats = counted.groupBy(F.col(label).alias("_of")).agg(*_stats(terms)).withColumn("avgdl", F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0))
    hits = counted.filter(F.exists("tf", lambda x: x > 0)).join(stats, F.col(label).eqNullSafe(F.col("_of"))).select(key, path, label, _score(terms, F.col).alias("score"))
    best = ranked(hits, [key], limit, partition=[label])
    return ranked(best.groupBy(path).agg(F.sum("score").alias("score")), [path], limit)


def vector_topk(vectors: DataFrame, query: list[float], key: str, vector: str, k: int, below: float | None = None) -> DataFrame:
    """(key, distance): the k nearest by cosine distance, then those below a
    threshold. Exact; a partial top-k runs before the only shuffle."""
    d = vectors.select(key, cosine_distance(vector, query).alias("distance")).filter("distance is not null").orderBy("distance", key).limit(k)
    return d if below is None else d.filter(F.col("distance") < below)


def rrf(keyword: DataFrame, semantic: DataFrame, key: str, limit: int | None = None, start: int = 1, k: int = RRF_K) -> DataFrame:
    """(key, score, sources, rank) of two ranked lists (key, rank from 1).

    The score is the sum of 1 / (k + rank - 1 + start); repeats add up.
    """
    part = lambda df, name: df.select(key, (F.lit(1.0) / (k + start + F.col("rank") - 1)).alias("s"), F.lit(name).alias("source"))
    both = part(keyword, "bm25").unionByName(part(semantic, "semantic"))
    fused = both.groupBy(key).agg(F.sum("s").alias("score"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return ranked(fused, [key], limit)


def enrich(hits: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """hits (id) with the first callees, callers of each, by id."""
    def side(a: str, b: str, name: str) -> DataFrame:
        x = edges.select(F.col(a).alias("id"), F.col(b).alias("other")).join(hits.select("id"), "id", "left_semi")
        return x.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("other")), 1, most).alias(name))

    return hits.join(side("src", "dst", "outgoing"), "id", "left").join(side("dst", "src", "incoming"), "id", "left")


def embed(texts: DataFrame, key: str, text: str, dim: int = 384, embedder=None) -> DataFrame:
    """(key, embedding): by the given function of a list of texts to an array,
    or by hashed words, normalised; runs in Arrow batches."""
    ship(texts.sparkSession)

    def hashed(batch: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(batch), dim), np.float32)
        for i, t in enumerate(batch):
            for w in query_terms(t or ""):
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 0x80000000 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    run = embedder or hashed

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "embedding": list(run(f[text].tolist()))})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInPandas(batches, f"{key} {kind}, embedding array<float>")


def hybrid(docs: DataFrame, vectors: DataFrame, text: str, probe: list[float] | None, mode: str = "hybrid", limit: int = 10, id_col: str = "id") -> DataFrame:
    """(id, score, sources, rank): by words, by vector, or both fused.

    docs: id, text; vectors: id, embedding. The limit is 1 to 100; each list
    is fetched to twice the limit before it is fused.
    """
    limit = max(1, min(100, limit))
    if mode not in ("hybrid", "semantic", "bm25"):
        raise ValueError(f"no mode {mode}")
    kw = ranked(bm25(docs, "text", text, [id_col]), [id_col], 2 * limit)
    if mode == "bm25" or probe is None:
        return kw.filter(F.col("rank") <= limit).select(id_col, "score", F.lit("bm25").alias("sources"), "rank")
    near = vector_topk(vectors, probe, id_col, "embedding", 2 * limit).select(id_col, (1 - F.col("distance")).alias("score"))
    sem = ranked(near, [id_col], 2 * limit)
    if mode == "semantic":
        return sem.filter(F.col("rank") <= limit).select(id_col, "score", F.lit("semantic").alias("sources"), "rank")
    return rrf(kw, sem, id_col, limit)


def augment(hits: DataFrame, nodes: DataFrame, edges: DataFrame, cohesion: DataFrame, word: str, files: int = 5, most: int = 3) -> DataFrame:
    """(id, callers, callees, cohesion): symbols of the best files whose name
    holds a word, with up to three callers and callees, tightest cluster first.

    hits: filePath, score; cohesion: id, cohesion.
    """
    best = hits.orderBy(F.desc("score"), "filePath").limit(files)
    some = nodes.filter(F.contains(F.lower("name"), F.lit(word.lower()))).join(F.broadcast(best.select("filePath")), "filePath", "left_semi").select("id")  # at most ``files`` rows
    side = lambda a, b, n: edges.select(F.col(a).alias("id"), F.col(b).alias("o")).join(some, "id", "left_semi").groupBy("id").agg(F.slice(F.sort_array(F.collect_set("o")), 1, most).alias(n))
    return some.join(side("dst", "src", "callers"), "id", "left").join(side("src", "dst", "callees"), "id", "left").join(cohesion, "id", "left").orderBy(F.desc("cohesion"), "id")


def register_search(spark, docs: DataFrame, vectors: DataFrame, id_col: str = "id") -> None:
    """Views over an index for SQL: ``search_postings`` (term, id, tf, dl) and
    ``search_vectors`` (id, embedding)."""
    postings(docs, "text", id_col).createOrReplaceTempView("search_postings")
    vectors.createOrReplaceTempView("search_vectors")
