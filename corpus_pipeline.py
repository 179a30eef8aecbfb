"""Corpus pipeline: language ID, near-dedup, secret scan, source mix, packing.

Each stage takes what the one before kept, as written Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import language_id as lang
from codeloom.llm.common import Scratch, join_small
from codeloom.llm.near_dedup import Plan, near_duplicates
from codeloom.llm.packing import pack
from codeloom.llm.queries import tokenizer_path
from codeloom.llm.secret_scan import redact_secrets
from codeloom.llm.source_mix import mixed

#: A text farther than this from every language (1 less its share of the
#: greatest distance) is in none of them. Texts in two languages stay above 0.35.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; those without a letter, or unlike
    every profile, go. A null lang is set to the predicted language. Where no
    row has a lang, nothing can be learned: all documents with a letter stay."""
    profiles = lang.learn(docs.select("lang", "text"))
    if not profiles.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = lang.identify(docs, profiles)
    kept = found.filter((F.col("lang_pred") != lang.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays
    (five-word shingles, similarity 0.8); repeated rows stay once. Rows that
    share an id but not a text are judged each for itself, after all others of
    their group."""
    scratch = Scratch(spark, "dedup-gone")
    by_text = F.xxhash64("text")
    several = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(by_text).alias("a"), F.max(by_text).alias("b")).filter("a <> b")
    several = scratch.write(several.select("doc_id", F.lit(True).alias("_several")), "several")
    keyed = docs.withColumn("_row", F.col("doc_id").cast("long"))
    if not several.isEmpty():
        stand_in = F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
        keyed = join_small(docs, several, ["doc_id"]).withColumn("_row", F.when(F.col("_several"), stand_in).otherwise(F.col("doc_id").cast("long")))
    found = near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text"), Plan())
    gone = scratch.write(found.filter(~F.col("kept")).select(F.col("doc_id").alias("_row")).distinct(), "ids")
    kept = join_small(keyed, gone, ["_row"], "left_anti")
    repeated = kept.filter("_row is not null").groupBy("_row").count().filter("count > 1").select("_row")
    if not repeated.isEmpty():
        once = kept.join(repeated, "_row", "left_semi").dropDuplicates(["_row", "text"])
        kept = kept.join(repeated, "_row", "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by its kind in brackets; all documents stay."""
    return redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 3 times."""
    found = mixed(docs)
    return found.filter("mix_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Not expressible in SQL: trained profiles, compression and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
