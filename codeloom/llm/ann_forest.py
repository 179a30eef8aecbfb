"""Approximate nearest neighbours by a hash-prefix forest (Bawa, Condie and
Ganesan, 2005).

Each of ``TREES`` trees gives a vector a string of ``BITS`` hash bits; a tree
is the sorted array of the strings. A query descends in every tree to the
longest prefix that it shares with any row, of whatever length, and then the
trees ascend together: prefixes are shortened by one bit in all trees at once
until they cover ``want`` candidates, and never fewer than hold k other ids.
All rows under those prefixes are compared with the query by their exact
distance, each in the first tree that has it under the prefix.

A sorted array is kept in ranges by its first ``top`` bits, and a range of
more than ``RANGE_ROWS`` rows in several salted parts, so a group of equal
vectors of any size is spread; a part's queries come in blocks of about
``QUERY_ROWS``. Counts of prefixes come from binary search in the parts and
are summed, which gives every query its level; then each part returns its
nearest k rows for each query and the best k of all parts remain.

``want`` is fitted, not guessed: for ``FIT_QUERIES`` queries the true
neighbours among all rows are found in one linear pass, with the level at
which the forest would reach them, and the least ``want`` that reaches the
aimed recall is taken. Vectors without any structure, such as points drawn
evenly from a sphere in many dimensions, need a large share of all rows; no
forest can do better there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, join_small, text_batches

TREES, BITS = 10, 48
#: Rows of one part of a sorted array, and of one block of the queries it gets.
RANGE_ROWS, QUERY_ROWS = 20_000, 5_000
#: Vectors that the hash functions are fitted on, and queries for the fit of want.
FIT_ROWS, FIT_QUERIES = 2048, 64
RECALL = 0.95


class Hashes:
    """Hash bits: sides of hyperplanes midway between two sampled vectors."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        r = np.random.default_rng(seed)
        n, dim = sample.shape
        i = r.integers(0, n, trees * bits)
        j = (i + r.integers(1, max(2, n), trees * bits)) % n
        normal = sample[i] - sample[j]
        flat = np.linalg.norm(normal, axis=1) == 0
        normal[flat] = r.standard_normal((int(flat.sum()), dim))
        normal /= np.linalg.norm(normal, axis=1, keepdims=True)
        self.normal = normal.T.copy()
        self.offset = ((sample[i] + sample[j]) / 2 * normal).sum(1)
        self.trees, self.bits = trees, bits

    def __call__(self, v: np.ndarray) -> np.ndarray:
        """Strings as integers, one column a tree; the first bit is the highest."""
        side = (v @ self.normal > self.offset).reshape(len(v), self.trees, self.bits)
        return side.astype(np.int64) @ (np.int64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.int64))


def _usable(v: np.ndarray | None, dim: int) -> bool:
    if v is None or len(v) != dim or not dim:
        return False
    v = np.asarray(v, np.float64)
    return bool(np.isfinite(v).all() and v.any())


def _matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a list column and their rows."""
    rows = [(i, v) for i, v in enumerate(col.to_numpy(zero_copy_only=False)) if _usable(v, dim)]
    if not rows:
        return np.zeros((0, dim)), np.zeros(0, np.int64)
    return np.stack([np.asarray(v, np.float64) for _, v in rows]), np.array([i for i, _ in rows])


def _bounds(sorted_h: np.ndarray, h: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array of the rows that share ``level`` bits with h."""
    shift = BITS - level
    low = (h >> shift) << shift
    return np.searchsorted(sorted_h, low), np.searchsorted(sorted_h, low + ((1 << shift) - 1), "right")


def _nearest(q: np.ndarray, qid: int, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows in double precision, ties to the smaller id, without
    the query itself; equal ids once."""
    other = ids != qid
    v, ids = v[other], ids[other]
    d = np.sqrt(((v - q) ** 2).sum(1))
    if len(d) > 4 * k:
        near = d <= np.partition(d, 2 * k)[2 * k]
        if len(np.unique(ids[near])) >= k:
            d, ids = d[near], ids[near]
    order = np.lexsort((ids, d))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[order], d[order]


def search(vectors: DataFrame, is_query, k: int = 10, want: int | None = None, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each query.

    vectors: vec_id, embedding. is_query: a condition on vec_id. Candidates
    are all other rows; score is the Euclidean distance in double precision,
    ties go to the smaller vec_id. Vectors that are null, zero, or hold null
    or non-finite components take no part, nor do those of another length
    than most have, or rows without an id. Rows that repeat an id count once,
    with the nearest of their vectors. Queries with fewer candidates return
    all. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann-forest")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter("id is not null and v is not null")
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = common[0]["dim"] if common else 0
    if not dim:
        return empty
    sample, _ = _matrix(rows.filter(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toArrow().column("v").combine_chunks(), dim)
    if not len(sample):
        return empty
    hashes = Hashes(sample)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, at = _matrix(batch.column("v"), dim)
            h = hashes(m)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.asarray(batch.column("id"))[at]),
                    pa.array([x.tobytes() for x in m], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * hashes.trees), pa.array(h.ravel())),
                ],
                names=["id", "v", "h"],
            )

    text_batches(spark, 4096)
    indexed = scratch.write(rows.mapInArrow(index, "id long, v binary, h array<long>"), "index")
    per_id = indexed.groupBy("id").count().agg(F.sum("count"), F.max("count")).first()
    total, repeats = per_id[0] or 0, per_id[1] or 1
    if not total:
        return empty
    top = int(np.clip(np.ceil(np.log2(max(1, total / RANGE_ROWS))), 0, 12))
    ranges = indexed.select(F.posexplode("h").alias("tree", "h")).groupBy("tree", F.shiftright("h", BITS - top).alias("at")).count().collect()  # at most TREES * 2^top
    count = {(r["tree"], r["at"]): r["count"] for r in ranges}
    parts = spark.createDataFrame([(t, a, -(-n // RANGE_ROWS)) for (t, a), n in count.items()], "tree int, at long, parts int")
    # counts of the levels above the ranges, as these are prefixes too
    shallow = np.zeros((TREES, top + 1, 1 << top), np.int64)
    for (t, a), n in count.items():
        for level in range(top + 1):
            shallow[t, level, a >> (top - level)] += n

    placed = indexed.select("id", "v", F.col("h").alias("all"), F.posexplode("h").alias("tree", "h")).withColumn("at", F.shiftright("h", BITS - top))
    placed = join_small(placed, parts, ["tree", "at"], "inner").withColumn("salt", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    queries = scratch.write(indexed.filter(is_query(F.col("id"))).dropDuplicates(["id"]), "queries")
    asked = queries.select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.col("h").alias("qall"), F.posexplode("h").alias("tree", "qh"))

    def meet(sent: DataFrame, left: list[str], right: list[str]):
        """Parts of the arrays and the queries sent to them, cogrouped in blocks."""
        blocks = sent.groupBy("tree", "at").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
        blocks = scratch.write(blocks, f"blocks-{len(left)}")  # at most a row for each range
        key = ["tree", "at", "salt", "block"]
        rows = join_small(placed, blocks, ["tree", "at"], "inner").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asks = join_small(join_small(sent, parts, ["tree", "at"], "inner"), blocks, ["tree", "at"], "inner")
        asks = asks.withColumn("block", F.pmod(F.xxhash64("qid"), "blocks").cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return rows.select(*key, *left).groupBy(*key).cogroup(asks.select(*key, *right).groupBy(*key))

    # 1. rows under each prefix of a query, by level
    def levels(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qid": np.zeros(0, np.int64), "level": np.zeros(0, np.int32), "n": np.zeros(0, np.int64)})
        h, qh = np.sort(left["h"].to_numpy()), right["qh"].to_numpy()
        out = []
        for level in range(top + 1, BITS + 1):
            a, b = _bounds(h, qh, level)
            found = b > a
            if not found.any():
                break
            out.append(pd.DataFrame({"qid": right["qid"].to_numpy()[found], "level": np.int32(level), "n": (b - a)[found]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": np.zeros(0, np.int64), "level": np.zeros(0, np.int32), "n": np.zeros(0, np.int64)})

    spread = asked.select("qid", "tree", "qh", F.shiftright("qh", BITS - top).alias("at"))
    deep = meet(spread, ["h"], ["qid", "qh"]).applyInPandas(levels, "qid long, level int, n long").groupBy("qid", "level").agg(F.sum("n").alias("n"))
    deep = deep.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("deep"))  # at most BITS levels

    def upper(hs: pd.Series) -> pd.Series:
        out = []
        for h in hs:
            at = np.asarray(h, np.int64) >> (BITS - top)
            out.append([int(sum(shallow[t, level, at[t] >> (top - level)] for t in range(TREES))) for level in range(top + 1)])
        return pd.Series(out)

    tops = F.pandas_udf(upper, "array<long>")
    known = queries.select(F.col("id").alias("qid"), "h", tops("h").alias("tops")).join(deep, "qid", "left")
    known = known.withColumn("n", F.concat("tops", F.transform(F.sequence(F.lit(top + 1), F.lit(BITS)), lambda i: F.coalesce(F.element_at("deep", i), F.lit(0).cast("long")))))
    known = scratch.write(known.select("qid", "n"), "levels")

    # 2. the least want that reaches the aimed recall
    if want is None:
        want = _fit(indexed, queries, known, hashes, dim, k, recall)
    want = max(want, TREES * (k + 1) * repeats)  # a row counts once a tree: so many hold k other ids

    # 3. every query's level, and all rows under its prefixes there
    level = F.size(F.filter("n", lambda x: x >= want)) - 1
    chosen = known.select("qid", F.greatest(level, F.lit(0)).alias("level"))
    routed = asked.join(chosen, "qid")
    wide = F.greatest(F.lit(0), F.lit(top) - F.col("level"))
    low = F.expr(f"shiftleft(shiftright(shiftright(qh, {BITS - top}), int(greatest(0, {top} - level))), int(greatest(0, {top} - level)))")
    routed = routed.withColumn("low", low).withColumn("wide", wide)
    routed = routed.withColumn("at", F.explode(F.expr("sequence(low, low + shiftleft(1L, int(wide)) - 1)")))

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            order = np.argsort(left["h"].to_numpy(), kind="stable")
            h, ids = left["h"].to_numpy()[order], left["id"].to_numpy()[order]
            v = np.frombuffer(b"".join(left["v"]), np.float64).reshape(len(left), dim)[order]
            earlier = np.stack(left["all"].to_numpy())[order, : key[0]]  # strings in the trees before this one
            for qid, qv, qh, qall, lev in zip(right["qid"], right["qv"], right["qh"].to_numpy(), right["qall"], right["level"]):
                a, b = (0, len(h)) if lev <= top else (int(x[0]) for x in _bounds(h, np.array([qh]), int(lev)))
                if b > a:
                    new = np.flatnonzero((((earlier[a:b] ^ np.asarray(qall)[: key[0]]) >> (BITS - int(lev))) != 0).all(1)) + a
                    if len(new):
                        out.append((qid, *_nearest(np.frombuffer(qv, np.float64), qid, v[new], ids[new], k)))
        return pd.DataFrame(
            {
                "query_id": np.concatenate([np.full(len(i), q) for q, i, _ in out]) if out else np.zeros(0, np.int64),
                "vec_id": np.concatenate([i for _, i, _ in out]) if out else np.zeros(0, np.int64),
                "score": np.concatenate([d for _, _, d in out]) if out else np.zeros(0),
            }
        )

    best = meet(routed, ["id", "h", "all", "v"], ["qid", "qv", "qh", "qall", "level"]).applyInPandas(compare, "query_id long, vec_id long, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _fit(indexed: DataFrame, queries: DataFrame, known: DataFrame, hashes: Hashes, dim: int, k: int, recall: float) -> int:
    """The least number of candidates that gives the aimed recall on a bounded
    set of queries, whose true neighbours among all rows are found."""
    some = queries.orderBy(F.xxhash64("id"), "id").limit(FIT_QUERIES).collect()
    if not some:
        return k
    qid = np.array([r["id"] for r in some])
    q = np.stack([np.frombuffer(r["v"], np.float64) for r in some])
    qh = np.array([r["h"] for r in some], np.int64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column("id"))
            v = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.float64).reshape(batch.num_rows, dim)
            h = batch.column("h").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            out = []
            for i in range(len(qid)):
                got, d = _nearest(q[i], qid[i], v, ids, k)
                where = {x: n for n, x in enumerate(ids.tolist())}
                differ = h[[where[x] for x in got.tolist()]] ^ qh[i]
                shared = np.where(differ > 0, BITS - 1 - np.floor(np.log2(np.maximum(differ, 1))).astype(np.int64), BITS)
                out.append((np.full(len(got), i), got, d, shared.max(1)))
            cols = [np.concatenate(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int32)), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3].astype(np.int32))], names=["q", "id", "d", "shared"])

    found: dict[int, list[tuple[float, int, int]]] = {}
    place = F.row_number().over(W.partitionBy("q").orderBy("d", "id"))
    for r in indexed.mapInArrow(near, "q int, id long, d double, shared int").withColumn("r", place).filter(F.col("r") <= k).collect():
        found.setdefault(r["q"], []).append((r["d"], r["id"], r["shared"]))
    counts = {r["qid"]: np.array(r["n"]) for r in known.filter(F.col("qid").isin(qid.tolist())).collect()}
    pairs = [(counts[qid[i]], s) for i, rows in found.items() for _, _, s in rows]
    if not pairs:
        return k
    # a neighbour at level s is found if want is more than the rows of level s + 1
    need = np.sort([int(n[s + 1]) + 1 if s < BITS else 1 for n, s in pairs])
    return max(k, int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]))
