"""The pipeline by stages, against brute force where SQL can't say it."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from codeloom.llm import secret_scan

from .test_operators import DOC, brute_components, text_in, words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = [(i, text_in("aa" if i % 2 else "bb", i, 60), "aa" if i % 2 else "bb", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail", rows[i][2], "s0", 1) for i in range(20)]
    rows += [(200, None, None, None, None), (201, "", None, "s1", 0), (202, "12 34 --", "aa", "s1", 8), (203, text_in("aa", 77, 50) + " token = abcdefabcdefabcdef01", None, None, 1)]
    rows += [rows[0], rows[0]]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOC).write.parquet(f"{d}/documents.parquet")
    return d, rows


def test_stages(spark, tables, tmp_path):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    by = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{tmp_path}/{name}")
        by[name] = docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
    lang = by["language_id"].collect()
    assert {r.doc_id for r in lang} == {r[0] for r in rows} - {200, 201, 202}
    assert next(r.lang for r in lang if r.doc_id == 203) == "aa"
    comp, _ = brute_components([(r.doc_id, r.text) for r in lang], 5, 80)
    kept = by["near_dedup"].collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(comp.values()))
    assert {r.doc_id: r.text for r in by["secret_scan"].collect()} == {r.doc_id: secret_scan.redact(r.text, secret_scan.find_spans(r.text)) for r in kept}
    assert "[assign]" in next(r.text for r in by["secret_scan"].collect() if r.doc_id == 203)
    mixed = by["source_mix"].groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert all(1 <= r.n <= 3 for r in mixed)
    assert {r.doc_id for r in by["packing"].collect()} == {r.doc_id for r in mixed}


def test_run_and_registration(spark, tables):
    d, _ = tables
    assert corpus_pipeline.run(spark, d).count() > 0
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_that_share_an_id(spark):
    a, b, c = text_in("aa", 1, 60), text_in("aa", 2, 60), text_in("bb", 3, 60)
    docs = spark.createDataFrame([(1, a, "aa", "s", 1), (4, a + " tail", "aa", "s", 1), (4, b, "aa", "s", 1), (4, b, "aa", "s", 1), (5, c, "bb", "s", 1), (5, c, "bb", "s", 1), (None, a, "aa", "s", 1)], DOC)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, a), (4, b), (5, c), (0, a)])


def test_documents_without_any_language(spark):
    docs = spark.createDataFrame([(1, text_in("aa", 1, 60), None, "s", 1), (2, "12 34", None, "s", 1), (3, None, None, "s", 1), (4, "é", None, "s", 1)], DOC)
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [1, 4]


def test_words_helper():
    assert words(1, 3) == words(1, 3)
