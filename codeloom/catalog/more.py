"""Further resolution, traversal and tool queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import community, resolve as R, search as S, tools as O, traverse as T
from ..session import checkpoint
from ..sources.tables import flow_edges, flow_graph, part_nodes, processes, supply_edges, table, with_
from .registry import query
from .search import Q, _bm25_sql, _probe

_FP = with_("flow", "parts")


@query("entry_flags", f"{_FP} select id, case when id not in (select dst from flow where confidence >= 0.99) or name = 'main' then 1.0 else 0.0 end::double as entry from parts where label = 'Function'")
def entry_flags(spark: SparkSession, d: str) -> DataFrame:
    return T.entry_flags(part_nodes(spark, d), flow_edges(spark, d, 0.99))


@query(
    "flow_reach",
    f"""{_FP}, f as (select src, dst from flow where confidence >= 0.99), r as (select id from parts where label = 'Function' and id not in (select dst from f)),
    w(root, id, depth) as (select id, id, 0 from r union select root, dst, depth + 1 from w join f on src = w.id where depth < 3)
    select root, id, min(depth) as depth from w group by all""",
)
def flow_reach(spark: SparkSession, d: str) -> DataFrame:
    e = checkpoint(flow_edges(spark, d, 0.99))
    roots = T.entry_flags(part_nodes(spark, d), e).filter("entry = 1.0").select("id")
    return T.reach(e, roots, 3)


@query(
    "hop_impact",
    f"""{with_('flow')}, f as (select * from flow where confidence >= 0.95), h1 as (select src as id, max(confidence) as c from f where dst = 13 group by 1),
    h2 as (select src as id, max(least(c, confidence)) as c from h1 join f on dst = id group by 1), h3 as (select src as id, max(least(c, confidence)) as c from h2 join f on dst = id group by 1)
    select 1 as hop, id, c as confidence from (select * from h1 where id <> 13 order by c desc, id limit 300) union all
    select 2, id, c from (select * from h2 where id <> 13 order by c desc, id limit 200) union all select 3, id, c from (select * from h3 where id <> 13 order by c desc, id limit 100)""",
)
def hop_impact(spark: SparkSession, d: str) -> DataFrame:
    return T.hop_impact(flow_edges(spark, d, 0.95), spark.createDataFrame([(13,)], "id long"))


@query("component_cohesion")
def component_cohesion(spark: SparkSession, d: str) -> DataFrame:
    """Over every qualifying edge, for which recursive SQL is too slow."""
    e = checkpoint(flow_edges(spark, d, 1.0))
    return community.component_communities(T.components(e, part_nodes(spark, d).select("id")), e)


@query("import_confidence", "select l_suppkey as src, l_partkey as dst, max(case when l_returnflag = 'R' then 0.5 else 1.0 end)::double as confidence from lineitem where l_suppkey <> l_partkey group by all")
def import_confidence(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return R.import_edges(li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_returnflag") == "R").alias("glob")))


@query(
    "wildcard_synthesis",
    f"""{with_('supply', 'parts')}, e as (select distinct src % 20 as file, dst % 25 as source from supply), s as (select distinct id % 25 as source, name from parts where isExported),
    b as (select 3 as file, 'red ring' as name), x as (select e.file, name, source, row_number() over (partition by e.file order by source, name) as r from e join s using (source) where (e.file, name) not in (select file, name from b))
    select file, source, count(*) as n from x where r <= 100 group by all""",
)
def wildcard_synthesis(spark: SparkSession, d: str) -> DataFrame:
    e = supply_edges(spark, d).select((F.col("src") % 20).alias("file"), (F.col("dst") % 25).alias("target"))
    s = part_nodes(spark, d).select((F.col("id") % 25).alias("file"), "name", F.col("isExported").alias("exported"))
    named = spark.createDataFrame([(3, "red ring")], "file long, local string")
    return R.synthesize_wildcards(e, s, named, 100).groupBy("file", "source").agg(F.count("*").alias("n"))


@query(
    "interface_dispatch",
    """with m as (select p_partkey as method, p_partkey % 50 as owner, p_name as name from part), i as (select distinct l_suppkey % 50 as iface, l_linenumber + 10 as cls from lineitem),
    c as (select distinct l_orderkey % 500 as src, l_partkey as dst from lineitem)
    select distinct c.src, t.method as dst, 0.7::double as confidence from c join m on m.method = c.dst join i on i.iface = m.owner join m t on t.owner = i.cls and t.name = m.name where c.src <> t.method""",
)
def interface_dispatch(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").select(F.col("p_partkey").alias("method"), (F.col("p_partkey") % 50).alias("owner"), F.col("p_name").alias("name"))
    li = table(spark, d, "lineitem")
    i = li.select((F.col("l_suppkey") % 50).alias("iface"), (F.col("l_linenumber") + 10).cast("long").alias("cls")).distinct()
    c = li.select((F.col("l_orderkey") % 500).alias("src"), F.col("l_partkey").alias("dst"))
    return R.dispatch(c, m, i)


@query("write_access", "select distinct o_custkey % 100 as src, p_partkey as dst, 'write' as reason from orders join lineitem on l_orderkey = o_orderkey join part on p_brand = 'Brand#' || (l_suppkey % 25 + 1) and p_name = 'red ring'")
def write_access(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    a = a.select((F.col("o_custkey") % 100).alias("src"), F.concat(F.lit("Brand#"), F.col("l_suppkey") % 25 + 1).alias("owner"), F.lit("red ring").alias("field")).distinct()
    f = table(spark, d, "part").select(F.col("p_brand").alias("owner"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    return R.writes(a, f)


@query(
    "type_fixpoint",
    """with recursive k as (select distinct o_custkey as v, 'T' || (o_custkey % 7) as t from orders where o_orderstatus = 'F'),
    p as (select c_custkey as v, c_custkey // 2 as base from customer where c_custkey > 0 and c_custkey not in (select v from k)),
    w(v, t, r) as (select v, t, 0 from k union all select p.v, w.t, r + 1 from w join p on p.base = w.v)
    select v as var, t as type from w""",
)
def type_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """Seeded from every customer with a finished order."""
    k = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.lit("s").alias("scope"), F.col("o_custkey").cast("string").alias("var"), F.concat(F.lit("T"), F.col("o_custkey") % 7).alias("type")).distinct()
    p = table(spark, d, "customer").filter("c_custkey > 0").select(F.lit("s").alias("scope"), F.col("c_custkey").cast("string").alias("var"), F.lit("copy").alias("kind"), F.expr("cast(c_custkey div 2 as string)").alias("base"), F.lit(None).cast("string").alias("member"), F.lit(1).alias("seq"))
    none = spark.createDataFrame([], "owner string, name string, type string")
    return R.propagate_types(k, p, none, none, rounds=64).select(F.col("var").cast("long").alias("var"), "type")


@query(
    "hybrid_modes",
    f"""with {_bm25_sql('documents', 'doc_id')}, k as (select doc_id as id, row_number() over (order by score desc, doc_id) as rank from hits qualify rank <= 10),
    v as (select vec_id as id, row_number() over (order by dist, vec_id) as rank from (select vec_id, 1 - list_cosine_similarity(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[]) as dist from embeddings) qualify rank <= 10),
    f as (select id, sum(1.0::double / (60 + rank)) as s from (select * from k union all select * from v) group by id order by s desc, id limit 5)
    select 'bm25' as mode, id, cast(rank as int) as rank from k where rank <= 5 union all select 'semantic', id, cast(rank as int) from v where rank <= 5
    union all select 'hybrid', id, cast(row_number() over (order by s desc, id) as int) from f""",
)
def hybrid_modes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    out = None
    for mode in ("bm25", "semantic", "hybrid"):
        part = S.hybrid(docs, vec, Q, _probe(spark, d), mode, 5).select(F.lit(mode).alias("mode"), "id", "rank")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "augment_symbols",
    f"""{_FP}, h as (select filePath, count(*) as score from parts group by filePath order by score desc, filePath limit 5), s as (select id, module from parts where filePath in (select filePath from h) and contains(lower(name), 'ring'))
    select id, (select array_to_string(list_slice(list_sort(list(distinct src)), 1, 3), ',') from flow where dst = id) as callers, (select array_to_string(list_slice(list_sort(list(distinct dst)), 1, 3), ',') from flow where src = id) as callees from s""",
)
def augment_symbols(spark: SparkSession, d: str) -> DataFrame:
    g = flow_graph(spark, d)
    hits = g.nodes.groupBy("filePath").agg(F.count("*").alias("score"))
    out = S.augment(hits, g.nodes, g.edges, g.nodes.select("id", F.lit(0.5).alias("cohesion")), "ring")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("id", text("callers").alias("callers"), text("callees").alias("callees"))


@query("cluster_overview", f"{with_('parts')}, m as (select module as label, isExported as community, count(*) as n from parts group by all) select label, cast(sum(n) as bigint) as symbols, round(sum(n * case when community then 0.8 else 0.4 end) / sum(n), 4) as cohesion from m group by label having sum(n) >= 5")
def cluster_overview(spark: SparkSession, d: str) -> DataFrame:
    n = part_nodes(spark, d).select("id", F.concat_ws("/", "module", F.col("isExported").cast("string")).alias("community"), "module", "isExported")
    labels = n.select("community", F.col("module").alias("label"), F.when(F.col("isExported"), 0.8).otherwise(0.4).alias("cohesion")).distinct()
    return O.clusters(n.select("id", "community"), labels).select("label", "symbols", F.round("cohesion", 4).alias("cohesion"))


@query("affected_processes", f"{with_('proc')} select process, count(distinct symbol) as hits, min(step) as first_step from proc where symbol in ('user:0', 'system:0', 'assistant:3') group by process")
def affected_processes(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([("user:0",), ("system:0",), ("assistant:3",)], "id string")
    return O.affected_processes(ids, processes(spark, d).withColumnRenamed("symbol", "id"))
