"""The registered queries of this subpackage: thin digests of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language_id, license_scan, source_mix, toxicity
from .ann_forest import search
from .common import doc_bucket
from .html_extract import extract
from .license_scan import licenses
from .multiset_hash import edit_likeness
from .near_dedup import Plan, near_duplicates
from .packing import pack
from .secret_scan import scan_secrets
from .source_mix import mix


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda c: c % 100 == 0)


def op2_pareto_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = doc_bucket("doc_id", 3) == 1
    profiles = language_id.learn(docs.filter(~held_out))
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles, ["doc_id", "held_out"])


def op4_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    held_out = doc_bucket("doc_id", 5) == 0
    net = toxicity.fit(docs, labels.filter(~held_out).select("doc_id", "toxic"))
    return toxicity.score(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, Plan(words=3, percent=85))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann_forest": op1_ann_forest,
    "op2_pareto_source_mix": op2_pareto_source_mix,
    "op3_language_id": op3_language_id,
    "op4_multiset_fingerprints": op4_multiset_fingerprints,
    "op5_toxicity": op5_toxicity,
    "op6_license_scan": op6_license_scan,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_secret_scan": op8_secret_scan,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_html_extract": op10_html_extract,
}
ORACLE_SQL: dict[str, str] = {
    "op2_pareto_source_mix": source_mix.SQL,
    "op6_license_scan": license_scan.oracle(),
}
