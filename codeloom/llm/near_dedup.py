"""MinHash near-duplicates by a multi-index Hamming join.

1. Every text becomes its set of word-shingle hashes, a 128-bit fingerprint
   of the whole set and a signature of ``lanes`` b-bit MinHash values.
2. Texts with equal sets form a class; only one representative goes on, so
   thousands of copies cost as much as one.
3. The signature is split into m chunks with 2 * m > d, where d is the largest
   signature distance that a pair at the threshold reaches but with chance
   ``miss``. By the pigeonhole principle any pair within distance d has a
   chunk with at most one differing lane, so keys of each chunk with one lane
   left out (all allowed errors enumerated) find every such pair.
4. In each bucket all members are compared with its best connected member
   (star pairs: linear, whatever the bucket's size). Pairs within distance d
   are confirmed on the full shingle sets.
5. Buckets that still hold several components are joined exactly: every pair
   of members in different components within distance d is confirmed as well.
   Large buckets are split into blocks; nothing is capped or dropped.
6. Components come from contraction rounds on tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Scratch, join_small, text_batches
from .components import components

#: Members of a bucket that are compared in one block.
BLOCK_ROWS = 4096
#: Star pairs confirmed against one copy of the leader's text.
STAR_ROWS = 2000


@dataclass(frozen=True)
class Plan:
    """Settings of the join. ``percent`` is the least Jaccard similarity in %."""

    words: int = 5
    percent: int = 80
    lanes: int = 40
    bits: int = 16
    miss: float = 1e-5

    @property
    def distance(self) -> int:
        p = (1 - self.percent / 100) * (1 - 2.0**-self.bits)
        left = 1.0
        for d in range(self.lanes + 1):
            left -= comb(self.lanes, d) * p**d * (1 - p) ** (self.lanes - d)
            if left <= self.miss:
                return d
        return self.lanes

    @property
    def chunks(self) -> list[list[int]]:
        m = min(self.lanes, self.distance // 2 + 1)
        return [list(map(int, x)) for x in np.array_split(np.arange(self.lanes), m)]

    def keys(self, sig: Column) -> Column:
        """Array of bucket keys: one per chunk and left-out lane."""
        return F.array(*(F.xxhash64(F.lit(out), *(sig[i] for i in chunk if i != out)) for chunk in self.chunks for out in chunk))


def shingle_sets(batch: pa.RecordBatch, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a batch and their bounds."""
    raw, offsets = K.buffers(batch.column(text))
    raw = K.lower_ascii(raw)
    starts, ends, bounds = K.tokens(raw, offsets, K.WORDS)
    s, b = K.shingles(K.hash_tokens(raw, starts, ends), bounds, words)
    return K.distinct(s, b)


def _signer(plan: Plan):
    rng = np.random.default_rng(20240501)
    mul = rng.integers(0, 1 << 63, plan.lanes, dtype=np.uint64) * K.U(2) + K.U(1)
    add = rng.integers(0, 1 << 63, plan.lanes, dtype=np.uint64)
    mask = K.U((1 << plan.bits) - 1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in K.blocks(whole, "text"):
                s, b = shingle_sets(part, "text", plan.words)
                sig = np.empty((part.num_rows, plan.lanes), np.int32)
                for j in range(plan.lanes):
                    h = s * mul[j]
                    h ^= h >> K.U(29)
                    h += add[j]
                    low = K.reduce_segments(np.minimum, h, b, K.U(0))
                    sig[:, j] = (K.mix(low) & mask).astype(np.int32)
                f1 = K.reduce_segments(np.add, K.mix(s + K.U(1)), b, K.U(0))
                f2 = K.reduce_segments(np.add, K.mix(s ^ K.U(0x5BD1E995AF1C3D27)), b, K.U(0))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(b).astype(np.int64)),
                        pa.array(f1.view(np.int64)),
                        pa.array(f2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * plan.lanes), pa.array(sig.ravel())),
                    ],
                    names=["doc_id", "n", "f1", "f2", "sig"],
                )

    return sign


def _distance(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.when(a == b, 0).otherwise(1)), F.lit(0), lambda s, v: s + v)


def _confirm(plan: Plan):
    """Streams rows sorted by (a, salt, ord): a leader's text, then its partners'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, sets = None, []
        for whole in batches:
            for part in K.blocks(whole, "text"):
                s, b = shingle_sets(part, "text", plan.words)
                out_a, out_b = [], []
                keys = zip(*(part.column(c).to_pylist() for c in ("a", "salt", "b", "ord")))
                for i, (a, salt, other, order) in enumerate(keys):
                    mine = s[b[i] : b[i + 1]]
                    if order == 0:
                        if leader != (a, salt):
                            leader, sets = (a, salt), []
                        sets.append(mine)
                    elif leader == (a, salt):
                        for x in sets:
                            both = len(np.intersect1d(x, mine, assume_unique=True))
                            if both and 100 * both >= plan.percent * (len(x) + len(mine) - both):
                                out_a.append(a)
                                out_b.append(other)
                                break
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def confirm(docs: DataFrame, pairs: DataFrame, plan: Plan, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold.

    Each a's text goes once per ``STAR_ROWS`` partners, not once per pair, and
    rows are streamed in sorted order, so no group has to fit in memory.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = scratch.write(join_small(docs, ids, ["doc_id"], "inner"), f"{name}-texts")
    count = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("salts"))
    partners = (
        pairs.join(count, "a")
        .select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), "b")
        .join(texts.withColumnRenamed("doc_id", "b"), "b")
        .select("a", "salt", "b", "text", F.lit(1).alias("ord"))
    )
    leaders = (
        count.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        .join(texts.withColumnRenamed("doc_id", "a"), "a")
        .select("a", "salt", F.col("a").alias("b"), "text", F.lit(0).alias("ord"))
    )
    rows = leaders.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", "ord")
    return rows.mapInArrow(_confirm(plan), "a long, b long")


def _bucket_join(plan: Plan):
    """Pairs of different components within the distance, for rows sorted by
    (key, x, y): one block, or two blocks (side 0 and 1) of a large bucket."""

    limit = plan.distance

    def pairs(rows: dict[str, np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        left = rows["side"] == 0
        same = rows["x"][0] == rows["y"][0]
        one = {k: v[left] for k, v in rows.items()}
        two = one if same else {k: v[~left] for k, v in rows.items()}
        got_a, got_b = [], []
        for i in range(0, len(one["id"]), 256):
            part = slice(i, i + 256)
            n1, n2 = one["n"][part, None], two["n"][None]
            ok = (one["comp"][part, None] != two["comp"][None]) & (100 * np.minimum(n1, n2) >= plan.percent * np.maximum(n1, n2))
            p, q = np.nonzero(ok)
            if len(p):
                near = np.zeros(len(p), bool)
                for k in range(0, len(p), 1 << 16):
                    w = slice(k, k + (1 << 16))
                    near[w] = (one["sig"][part][p[w]] != two["sig"][q[w]]).sum(1) <= limit
                got_a.append(one["id"][part][p[near]])
                got_b.append(two["id"][q[near]])
        return got_a, got_b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        group = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = pairs({k: np.concatenate([h[k] for h in held]) for k in held[0]})
                a = np.concatenate(a) if a else np.zeros(0, np.int64)
                b = np.concatenate(b) if b else np.zeros(0, np.int64)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "x", "y", "side", "id", "comp", "n")}
            rows["sig"] = batch.column("sig").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.uint16 if plan.bits <= 16 else np.int32)
            new = (np.diff(rows["key"]) != 0) | (np.diff(rows["x"]) != 0) | (np.diff(rows["y"]) != 0)
            edges = [0, *(np.flatnonzero(new) + 1), batch.num_rows]
            for i, j in zip(edges, edges[1:]):
                at = (rows["key"][i], rows["x"][i], rows["y"][i])
                if at != group:
                    yield from flush()
                    held, group = [], at
                held.append({k: v[i:j] for k, v in rows.items()})
        yield from flush()

    return run


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Words are runs of characters other than the six ASCII white-space
    characters, with A-Z lower-cased. Null or word-less texts have an empty
    set, are linked with nothing and are kept. Texts with fewer words than a
    shingle have their whole sequence as the only one. A row with a null id
    can't be linked: its component is null and it is kept. Rows that repeat an
    id each give a row, with the size of their own set; links belong to the
    id, so what one of its texts is linked with, the id's other rows are too.
    Other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.write(docs.mapInArrow(_signer(plan), "doc_id long, n long, f1 long, f2 long, sig array<int>"), "signed")
    full = signed.filter("n > 0 and doc_id is not null")
    classes = full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"))
    members = full.join(classes, ["n", "f1", "f2"]).select("doc_id", "n", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("sig")).alias("sig"))
    members = scratch.write(members, "members")
    reps = members.filter("sig is not null").select(F.col("rep").alias("id"), "n", "sig")

    keyed = reps.select("id", F.explode(plan.keys(F.col("sig"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi")
    buckets = scratch.write(keyed.join(shared.select("key", "size"), "key"), "buckets")
    degree = buckets.groupBy("id").agg(F.sum("size").alias("degree"))
    lead = buckets.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("id"))).alias("top"))
    star = buckets.join(lead, "key").select((-F.col("top.id")).alias("a"), F.col("id").alias("b")).filter("a <> b").distinct()
    sigs = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"sig{c}"))
    near = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * plan.percent) & (_distance("siga", "sigb") <= plan.distance)
    star = scratch.write(star.join(sigs("a"), "a").join(sigs("b"), "b").filter(near).select("a", "b").distinct(), "star")
    links = scratch.write(confirm(docs, star, plan, scratch, "star"), "star-links")
    first = scratch.write(components(links, scratch, "first"), "first")

    placed = buckets.join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    parts = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    mine = F.pmod(F.xxhash64("id"), "parts").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rest = (
        placed.join(mixed, "key")
        .join(reps, "id")
        .withColumn("parts", parts)
        .withColumn("mine", mine)
        .withColumn("other", other)
        .select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "id", "comp", "n", "sig")
        .repartition("key", "x", "y")
        .sortWithinPartitions("key", "x", "y")
        .mapInArrow(_bucket_join(plan), "a long, b long")
        .filter("a <> b")
        .distinct()
    )
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = scratch.write(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    more = scratch.write(confirm(docs, rest, plan, scratch, "rest"), "rest-links")
    found = components(links.unionByName(more), scratch, "last")

    named = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = signed.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
