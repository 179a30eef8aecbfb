"""Adapters that read the driver's tables as graphs, postings and contracts.

Each adapter has its twin in SQL (``CTE``), for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flow_edges(spark: SparkSession, sf_dir: str, least: float | None = None) -> DataFrame:
    """CALLS: part -> the next part of the same order, one edge a pair with its
    highest confidence; those of ``least`` and more, dropped before they are
    grouped, which leaves the same edges."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_discount")
    e = li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.round(1 - F.col("l_discount"), 2).alias("confidence"))
    e = e if least is None else e.filter(F.col("confidence") >= least)
    return e.filter("dst is not null and src <> dst").groupBy("src", "dst").agg(F.max("confidence").alias("confidence")).withColumn("type", F.lit("CALLS"))


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.element_at(F.array(*(F.lit(x) for x in ("Class", "Function", "Interface", "Method"))), F.col("p_size") % 4 + 1)
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        label.alias("label"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/"), F.lower("p_type"), F.lit(".py")).alias("filePath"),
        (F.col("p_size") % 3 == 0).alias("isExported"),
        F.lower("p_type").alias("module"),
    )


def flow_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph(part_nodes(spark, sf_dir), flow_edges(spark, sf_dir))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMPORTS: supplier -> part."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("IMPORTS").alias("type"), F.lit(1.0).alias("confidence"))


def inherit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXTENDS: p -> p div 2; IMPLEMENTS: p -> p div 3, where another."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src")).filter("src >= 2")
    ext = p.select("src", F.expr("src div 2").alias("dst"), F.lit("EXTENDS").alias("type"), F.lit(0).alias("ord"))
    imp = p.filter("src div 3 <> src div 2").select("src", F.expr("src div 3").alias("dst"), F.lit("IMPLEMENTS").alias("type"), F.lit(1).alias("ord"))
    return ext.unionByName(imp).withColumn("confidence", F.lit(1.0))


def processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STEP_IN_PROCESS: conversation turns as steps (process, step, symbol)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("process"), (F.col("turn") + 1).cast("int").alias("step"), F.concat_ws(":", "role", (F.col("turn") % 5).cast("string")).alias("symbol"))


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CALLS: a user's event type -> the next one, with how often."""
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).filter("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers by nation and consumers by customer, as HTTP contract ids."""
    n = table(spark, sf_dir, "nation")
    prov = n.select(
        F.concat(F.lit("repo"), F.col("n_regionkey")).alias("repo"),
        F.concat(F.lit("http::"), F.when(F.col("n_nationkey") % 2 == 0, "get").otherwise("POST"), F.lit("::/n/"), F.col("n_nationkey"), F.lit("/{id}/")).alias("contractId"),
        F.lit("provider").alias("role"),
        F.concat(F.lit("svc"), F.col("n_nationkey") % 3).alias("service"),
    )
    c = table(spark, sf_dir, "customer")
    cons = c.select(
        F.concat(F.lit("repo"), F.col("c_custkey") % 5).alias("repo"),
        F.concat(F.lit("http::"), F.when(F.col("c_custkey") % 3 == 0, "*").otherwise("GET"), F.lit("::/n/"), F.col("c_nationkey") + F.col("c_custkey") % 2 * 10, F.lit("/{id}")).alias("contractId"),
        F.lit("consumer").alias("role"),
        F.concat(F.lit("svc"), F.col("c_custkey") % 3).alias("service"),
    ).distinct()
    return prov.unionByName(cons)


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route files of nations: file, url (raw), order and response keys."""
    n = table(spark, sf_dir, "nation")
    keys = F.filter(F.array(F.lit("data"), F.lit("items"), F.when(F.col("n_nationkey") % 2 == 0, "meta"), F.when(F.col("n_nationkey") % 3 == 0, "page")), lambda x: x.isNotNull())
    dynamic = F.when(F.col("n_nationkey") % 4 == 0, F.lit("/[id]")).when(F.col("n_nationkey") % 7 == 1, F.lit("/[...rest]")).otherwise("")
    return n.select(
        F.col("n_nationkey").alias("ord"),
        F.concat(F.lit("app/(shop)/api/"), F.col("n_regionkey"), F.lit("/n"), F.col("n_nationkey"), dynamic, F.lit("/route.ts")).alias("file"),
        keys.alias("responseKeys"),
        F.when(F.col("n_nationkey") % 5 == 0, F.array(F.lit("withAuth"))).otherwise(F.array().cast("array<string>")).alias("middleware"),
    )


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch calls of customers: consumer file, fetched URL, reason."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("web/c"), k % 97, F.lit(".ts")).alias("file"),
        F.concat(F.lit("/api/"), F.col("n_regionkey"), F.lit("/n"), F.col("n_nationkey"), F.when(k % 2 == 0, F.lit("/${id}")).otherwise(""), F.when(k % 3 == 0, F.lit("?q=1")).otherwise("")).alias("url"),
        F.concat(F.lit("fetch-url-match|keys:data,"), F.when(k % 4 == 0, "page").otherwise("meta"), F.when(k % 5 == 0, F.lit("|fetches:2")).otherwise("")).alias("reason"),
    ).distinct()


CTE = {
    "flow": """flow as (
      select src, dst, max(conf) as confidence from (
        select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_discount) as dst, round(1 - l_discount, 2) as conf
        from lineitem) where dst is not null and src <> dst group by src, dst)""",
    "parts": """parts as (
      select p_partkey as id, ['Class', 'Function', 'Interface', 'Method'][p_size % 4 + 1] as label, p_name as name,
        'src/' || lower(replace(p_brand, '#', '_')) || '/' || lower(p_type) || '.py' as filePath, p_size % 3 = 0 as isExported, lower(p_type) as module
      from part)""",
    "supply": "supply as (select distinct l_suppkey as src, l_partkey as dst from lineitem)",
    "inherit": """inherit as (
      select p_partkey as src, p_partkey // 2 as dst, 'EXTENDS' as type, 0 as ord from part where p_partkey >= 2
      union all select p_partkey, p_partkey // 3, 'IMPLEMENTS', 1 from part where p_partkey >= 2 and p_partkey // 3 <> p_partkey // 2)""",
    "proc": "proc as (select conv_id as process, cast(turn + 1 as int) as step, role || ':' || (turn % 5) as symbol from conversations)",
    "users": """users as (
      select src, dst, count(*) as n from (
        select event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events) where dst is not null group by src, dst)""",
    "contracts": """contracts as (
      select 'repo' || n_regionkey as repo, 'http::' || case when n_nationkey % 2 = 0 then 'get' else 'POST' end || '::/n/' || n_nationkey || '/{id}/' as contractId,
        'provider' as role, 'svc' || (n_nationkey % 3) as service from nation
      union all
      select distinct 'repo' || (c_custkey % 5), 'http::' || case when c_custkey % 3 = 0 then '*' else 'GET' end || '::/n/' || (c_nationkey + c_custkey % 2 * 10) || '/{id}',
        'consumer', 'svc' || (c_custkey % 3) from customer)""",
    "routes": """routes as (
      select n_nationkey as ord,
        '/api/' || n_regionkey || '/n' || n_nationkey || case when n_nationkey % 4 = 0 then '/[id]' when n_nationkey % 7 = 1 then '/[...rest]' else '' end as url,
        list_filter(['data', 'items', case when n_nationkey % 2 = 0 then 'meta' end, case when n_nationkey % 3 = 0 then 'page' end], lambda x: x is not null) as keys,
        case when n_nationkey % 5 = 0 then 'withAuth' else '' end as middleware
      from nation)""",
    "fetches": """fetches as (
      select distinct 'web/c' || (c_custkey % 97) || '.ts' as file,
        '/api/' || n_regionkey || '/n' || n_nationkey || case when c_custkey % 2 = 0 then '/[param]' else '' end as url,
        'fetch-url-match|keys:data,' || case when c_custkey % 4 = 0 then 'page' else 'meta' end || case when c_custkey % 5 = 0 then '|fetches:2' else '' end as reason
      from customer join nation on c_nationkey = n_nationkey)""",
}


def with_(*names: str) -> str:
    return "with recursive " + ", ".join(CTE[n] for n in names)
