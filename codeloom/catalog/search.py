"""Search queries over documents, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import search as S
from ..sources.tables import flow_edges, processes, table, with_
from .registry import query

Q = "public license version token public"
_TERMS = S.query_terms(Q)


def _bm25_sql(source: str, key: str, extra: str = "", where: str = "true", tag: str = "") -> str:
    """CTEs ending in hits(key, extra, score) of Q over source(key, extra, text)."""
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TERMS))
    more = f", {extra}" if extra else ""
    return f"""
    toks{tag} as (select {key}{more}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) > 1) as w from {source} where {where}),
    terms{tag}(i, t) as (values {values}),
    stats{tag} as (select count(*) as n, avg(len(w)) as avgdl from toks{tag}),
    tfs{tag} as (select {key}{more}, i, len(w) as dl, len(list_filter(w, lambda x: x = t)) as tf from toks{tag}, terms{tag}),
    dfs{tag} as (select i, count(*) filter (tf > 0) as df from tfs{tag} group by i),
    hits{tag} as (
      select {key}{more}, sum(ln(1 + (n - df + 0.5) / (0.5 + df)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
      from tfs{tag} join dfs{tag} using (i), stats{tag} group by all having sum(tf) > 0)"""


@query("bm25_documents", f"with {_bm25_sql('documents', 'doc_id')} select doc_id, round(score, 6) as score from hits order by round(score, 6) desc, doc_id limit 10")
def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    hits = S.bm25(table(spark, d, "documents"), "text", Q, ["doc_id"]).withColumn("score", F.round("score", 6))
    return hits.orderBy(F.desc("score"), "doc_id").limit(10)


@query(
    "bm25_postings",
    f"with {_bm25_sql('documents', 'doc_id')} select doc_id, round(score, 6) as score from hits",
)
def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    index = S.postings(table(spark, d, "documents"), "text", "doc_id")
    size = table(spark, d, "documents").select(F.size(S.tokens("text")).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("m")).first()
    return S.bm25_postings(index, Q, "doc_id", size["n"], size["m"]).select("doc_id", F.round("score", 6).alias("score"))


@query(
    "bm25_sum_by_source",
    f"""with {_bm25_sql('documents', 'doc_id', 'source')}
    select source, count(*) as hits, round(sum(score), 6) as total, round(max(score), 6) as best from hits group by source""",
)
def bm25_sum_by_source(spark: SparkSession, d: str) -> DataFrame:
    hits = S.bm25(table(spark, d, "documents"), "text", Q, ["doc_id", "source"])
    return hits.groupBy("source").agg(F.count("*").alias("hits"), F.round(F.sum("score"), 6).alias("total"), F.round(F.max("score"), 6).alias("best"))


_LANGS = ("de", "en", "es", "fr")
_FTS_SQL = (
    "with "
    + ", ".join(_bm25_sql("documents", "doc_id", "source", f"lang = '{x}'", f"_{x}") for x in _LANGS)
    + ", merged as ("
    + " union all ".join(f"(select source, score from hits_{x} order by score desc, doc_id limit 20)" for x in _LANGS)
    + """),
  summed as (select source, round(sum(score), 6) as score from merged group by source)
  select source, score, cast(row_number() over (order by score desc, source) as int) as rank from summed order by score desc, source limit 20"""
)


@query("fts_by_label", _FTS_SQL)
def fts_by_label(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    out = S.fts(docs, "text", Q, "lang", "doc_id", "source", 20)
    return S.ranked(out.select("source", F.round("score", 6).alias("score")), ["source"], 20)


_PROBE_SQL = "(select embedding from embeddings where vec_id = 0)"


def _probe(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]


_VEC_SQL = f"select vec_id, 1 - list_cosine_similarity(embedding::double[], {_PROBE_SQL}::double[]) as distance from embeddings order by distance, vec_id limit 20"


@query("vector_topk_cosine", f"select vec_id, round(distance, 6) as distance from ({_VEC_SQL})")
def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    hits = S.vector_topk(table(spark, d, "embeddings"), _probe(spark, d), "vec_id", "embedding", 20)
    return hits.select("vec_id", F.round("distance", 6).alias("distance"))


@query("vector_topk_threshold", f"select vec_id, round(distance, 6) as distance from ({_VEC_SQL}) where distance < 0.7")
def vector_topk_threshold(spark: SparkSession, d: str) -> DataFrame:
    hits = S.vector_topk(table(spark, d, "embeddings"), _probe(spark, d), "vec_id", "embedding", 20, below=0.7)
    return hits.select("vec_id", F.round("distance", 6).alias("distance"))


_LISTS = f"""{_bm25_sql('documents', 'doc_id')},
  kw as (select doc_id as id, row_number() over (order by round(score, 9) desc, doc_id) as rank from hits qualify rank <= 30),
  sem as (select vec_id as id, row_number() over (order by distance, vec_id) as rank from ({_VEC_SQL}))"""


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    kw = S.bm25(table(spark, d, "documents"), "text", Q, ["doc_id"]).select(F.col("doc_id").alias("id"), F.round("score", 9).alias("score"))
    sem = S.vector_topk(table(spark, d, "embeddings"), _probe(spark, d), "vec_id", "embedding", 20).select(F.col("vec_id").alias("id"), (-F.col("distance")).alias("score"))
    return S.ranked(kw, ["id"], 30), S.ranked(sem, ["id"], 20)


def _rrf_sql(start: int) -> str:
    return f"""with {_LISTS},
  fused as (
    select id, sum(1.0::double / (60 + {start} + rank - 1)) as score, string_agg(src, ',' order by src) as sources
    from (select id, rank, 'bm25' as src from kw union all select id, rank, 'semantic' from sem) group by id)
  select id, round(score, 6) as score, sources from fused order by score desc, id limit 15"""


@query("rrf_hybrid", _rrf_sql(1))
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    out = S.rrf(*_lists(spark, d), "id", 15)
    return out.select("id", F.round("score", 6).alias("score"), "sources")


@query("rrf_query_variant", _rrf_sql(0))
def rrf_query_variant(spark: SparkSession, d: str) -> DataFrame:
    out = S.rrf(*_lists(spark, d), "id", 15, start=0)
    return out.select("id", F.round("score", 6).alias("score"), "sources")


@query(
    "group_rrf",
    f"""with {_bm25_sql('documents', 'doc_id', 'source')},
  ranked as (select source, doc_id, row_number() over (partition by source order by round(score, 9) desc, doc_id) as rank from hits)
  select source, doc_id, round(1.0::double / (60 + rank), 6) as score from ranked order by rank, source, doc_id limit 25""",
)
def group_rrf(spark: SparkSession, d: str) -> DataFrame:
    hits = S.bm25(table(spark, d, "documents"), "text", Q, ["doc_id", "source"]).withColumn("score", F.round("score", 9))
    r = S.ranked(hits, ["doc_id"], by="score", partition=["source"])
    return r.orderBy("rank", "source", "doc_id").limit(25).select("source", "doc_id", F.round(F.lit(1.0) / (60 + F.col("rank")), 6).alias("score"))


@query(
    "search_enriched",
    f"""{with_('flow')}, seed as (select p_partkey as id from part where p_name like 'red %' order by p_partkey limit 25)
  select id, list_slice(list_sort(list(distinct o.dst)), 1, 5)::varchar as outgoing, (select list_slice(list_sort(list(distinct i.src)), 1, 5) from flow i where i.dst = id)::varchar as incoming
  from seed join flow o on o.src = id group by id""",
)
def search_enriched(spark: SparkSession, d: str) -> DataFrame:
    seed = table(spark, d, "part").filter("p_name like 'red %'").select(F.col("p_partkey").alias("id")).orderBy("id").limit(25)
    out = S.enrich(seed, flow_edges(spark, d))
    text = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", "), F.lit("]"))
    return out.filter("outgoing is not null").select("id", text("outgoing").alias("outgoing"), F.when(F.col("incoming").isNotNull(), text("incoming")).alias("incoming"))


@query(
    "search_grouped_by_process",
    f"""{with_('proc')}, hits as (
    select symbol, round(1.0::double / (60 + row_number() over (order by n desc, symbol)), 9) as score
    from (select symbol, count(*) as n from proc group by symbol)),
  parts as (select distinct process, symbol from proc),
  sized as (select process, max(step) as steps from proc group by process)
  select process, count(*) as symbols, round(sum(score), 6) as total, round(sum(score) + 0.1 * least(1.0, count(*) / max(steps)), 6) as priority
  from parts join hits using (symbol) join sized using (process) group by process order by priority desc, process limit 20""",
)
def search_grouped_by_process(spark: SparkSession, d: str) -> DataFrame:
    steps = processes(spark, d)
    hits = S.ranked(steps.groupBy("symbol").agg(F.count("*").alias("score")), ["symbol"]).select("symbol", F.round(F.lit(1.0) / (60 + F.col("rank")), 9).alias("score"))
    sized = steps.groupBy("process").agg(F.max("step").alias("steps"))
    g = steps.select("process", "symbol").distinct().join(hits, "symbol").join(sized, "process").groupBy("process").agg(F.count("*").alias("symbols"), F.sum("score").alias("t"), F.max("steps").alias("steps"))
    cohesion = F.least(F.lit(1.0), F.col("symbols") / F.col("steps"))
    out = g.select("process", "symbols", F.round("t", 6).alias("total"), F.round(F.col("t") + 0.1 * cohesion, 6).alias("priority"))
    return out.orderBy(F.desc("priority"), "process").limit(20)


@query(
    "bm25_hit_symbols",
    f"""with {_bm25_sql('documents', 'doc_id', 'source')},
  top as (select doc_id, source, row_number() over (order by round(score, 9) desc, doc_id) as r from hits qualify r <= 40),
  ranked as (select source, doc_id, row_number() over (partition by source order by r) as n from top)
  select source, doc_id, cast(n as int) as n from ranked where n <= 3""",
)
def bm25_hit_symbols(spark: SparkSession, d: str) -> DataFrame:
    hits = S.bm25(table(spark, d, "documents"), "text", Q, ["doc_id", "source"]).withColumn("score", F.round("score", 9))
    top = S.ranked(hits, ["doc_id"], 40)
    w = W.partitionBy("source").orderBy("rank")
    return top.withColumn("n", F.row_number().over(w)).filter("n <= 3").select("source", "doc_id", "n")


@query("hash_embed_topics", None)
def hash_embed_topics(spark: SparkSession, d: str) -> DataFrame:
    e = S.embed(table(spark, d, "benchmark"), "item_id", "text", 64)
    return e.select("item_id", F.size("embedding").alias("dim"), F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 3).alias("norm"))
