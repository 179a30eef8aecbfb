"""Graph pattern, aggregate and traversal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traverse as T
from ..operators.graph import PropertyGraph, first_by, top_per
from ..sources.tables import flow_edges, flow_graph, inherit_edges, part_nodes, processes, supply_edges, table, user_edges, with_
from .registry import query

FLOW, PARTS = with_("flow"), with_("flow", "parts")


def _ids(df: DataFrame, c: str = "other") -> DataFrame:
    return df.select("id", F.col(c).alias("other"))


def _seed(spark: SparkSession, n: int = 7) -> DataFrame:
    return spark.createDataFrame([(i * 13,) for i in range(1, n + 1)], "id long")


_SEED = "seed(id) as (values " + ", ".join(f"({i * 13})" for i in range(1, 8)) + ")"


@query("label_scan", f"{with_('parts')} select id, name from parts where label = 'Class' and isExported")
def label_scan(spark: SparkSession, d: str) -> DataFrame:
    return PropertyGraph(part_nodes(spark, d), flow_edges(spark, d)).label("Class").filter("isExported").select("id", "name")


@query("label_counts", f"{with_('parts')} select label, count(*) as n from parts group by label")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return flow_graph(spark, d).label_counts()


@query(
    "predicate_mix",
    f"""{with_('parts')} select id, label, name from parts
    where (name like 'red %' or contains(name, 'ring')) and not isExported and label in ('Class', 'Method') and id not in (1, 2, 3)""",
)
def predicate_mix(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return part_nodes(spark, d).filter((n.startswith("red ") | n.contains("ring")) & ~F.col("isExported") & F.col("label").isin("Class", "Method") & ~F.col("id").isin(1, 2, 3)).select("id", "label", "name")


@query("null_tolerant_threshold", f"{FLOW} select src, dst from (select src, dst, case when src % 5 = 0 then null else confidence end as c from flow) where c is null or c >= 0.98")
def null_tolerant_threshold(spark: SparkSession, d: str) -> DataFrame:
    e = flow_edges(spark, d).withColumn("confidence", F.when(F.col("src") % 5 != 0, F.col("confidence")))
    return PropertyGraph(part_nodes(spark, d), e).typed(["CALLS"], 0.98).select("src", "dst")


@query("one_hop_out", f"{FLOW}, {_SEED} select id, dst as other, confidence from seed join flow on src = id")
def one_hop_out(spark: SparkSession, d: str) -> DataFrame:
    return flow_graph(spark, d).expand(_seed(spark)).select("id", "other", "confidence")


@query("one_hop_in", f"{FLOW}, {_SEED} select id, src as other, confidence from seed join flow on dst = id")
def one_hop_in(spark: SparkSession, d: str) -> DataFrame:
    return flow_graph(spark, d).expand(_seed(spark), "in").select("id", "other", "confidence")


@query(
    "undirected_neighbors",
    f"{FLOW}, {_SEED}, both_ways as (select src, dst from flow union all select dst, src from flow) select id, count(*) as links, count(distinct dst) as others from seed join both_ways on src = id group by id",
)
def undirected_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return flow_graph(spark, d).expand(_seed(spark), "both").groupBy("id").agg(F.count("*").alias("links"), F.countDistinct("other").alias("others"))


@query(
    "two_hop",
    f"{FLOW}, {_SEED} select id as n0, count(*) as paths, count(distinct b.dst) as ends from seed join flow a on a.src = id join flow b on b.src = a.dst group by id",
)
def two_hop(spark: SparkSession, d: str) -> DataFrame:
    return flow_graph(spark, d).hops(_seed(spark), 2).groupBy("n0").agg(F.count("*").alias("paths"), F.countDistinct("n2").alias("ends"))


@query(
    "three_hop",
    f"""{FLOW}, f as (select src, dst from flow where confidence >= 0.97), {_SEED}
    select id as n0, count(*) as paths, count(distinct c.dst) as ends from seed join f a on a.src = id join f b on b.src = a.dst join f c on c.src = b.dst group by id""",
)
def three_hop(spark: SparkSession, d: str) -> DataFrame:
    return flow_graph(spark, d).hops(_seed(spark), 3, min_confidence=0.97).groupBy("n0").agg(F.count("*").alias("paths"), F.countDistinct("n3").alias("ends"))


@query(
    "diamond",
    f"""{FLOW}, f as (select src, dst from flow where confidence >= 0.99)
    select x.src as a, count(*) as n from f x join f y on y.src = x.dst join f u on u.src = x.src and u.dst > x.dst join f v on v.src = u.dst and v.dst = y.dst
    where y.dst <> x.src group by x.src""",
)
def diamond(spark: SparkSession, d: str) -> DataFrame:
    g = PropertyGraph(part_nodes(spark, d), flow_edges(spark, d, 0.99))
    return g.diamonds().groupBy("a").agg(F.count("*").alias("n"))


@query(
    "star_membership",
    f"""{PARTS} select a.module as from_module, b.module as to_module, count(*) as calls
    from flow join parts a on a.id = src join parts b on b.id = dst where a.module <> b.module group by all""",
)
def star_membership(spark: SparkSession, d: str) -> DataFrame:
    g = flow_graph(spark, d)
    m = g.nodes.select("id", "module")
    e = g.edges.join(m.select(F.col("id").alias("src"), F.col("module").alias("from_module")), "src").join(m.select(F.col("id").alias("dst"), F.col("module").alias("to_module")), "dst")
    return e.filter("from_module <> to_module").groupBy("from_module", "to_module").agg(F.count("*").alias("calls"))


@query(
    "optional_match_null",
    f"{PARTS} select id, count(dst) as strong from parts left join flow on src = id and confidence >= 1.0 group by id",
)
def optional_match_null(spark: SparkSession, d: str) -> DataFrame:
    g = flow_graph(spark, d)
    return g.optional(g.nodes.select("id"), F.col("confidence") >= 1.0).groupBy("id").agg(F.count("other").alias("strong"))


@query(
    "collect_neighbors",
    f"{FLOW}, {_SEED} select id, string_agg(distinct cast(dst as varchar), ',' order by cast(dst as varchar)) as items from seed join flow on src = id group by id",
)
def collect_neighbors(spark: SparkSession, d: str) -> DataFrame:
    items = flow_graph(spark, d).neighbors(_seed(spark))
    return items.select("id", F.array_join(F.array_sort(F.transform("items", lambda x: x["other"].cast("string"))), ",").alias("items"))


@query(
    "union_priority_lookup",
    f"""{with_('parts')} select name, id, label from (
      select *, row_number() over (partition by name order by case label when 'Class' then 0 when 'Interface' then 1 when 'Function' then 2 when 'Method' then 3 else 4 end, id) as r
      from parts where name like '%widget') where r = 1""",
)
def union_priority_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = flow_graph(spark, d).lookup(F.col("name").endswith("widget"), ["Class", "Interface", "Function", "Method"])
    return first_by(found, ["name"], "priority", "id").select("name", "id", "label")


@query("unmatched_anti", f"{with_('supply', 'parts')} select id from parts where id not in (select dst from supply)")
def unmatched_anti(spark: SparkSession, d: str) -> DataFrame:
    return part_nodes(spark, d).select("id").join(supply_edges(spark, d).select(F.col("dst").alias("id")), "id", "left_anti")


@query("semi_join_ids", f"{FLOW} select distinct src from flow where dst in (select p_partkey from part where p_size = 7)")
def semi_join_ids(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("dst"))
    return flow_edges(spark, d).join(wanted, "dst", "left_semi").select("src").distinct()


@query(
    "hotspots",
    f"{FLOW} select id, sum(n) as degree from (select src as id, count(*) as n from flow group by 1 union all select dst, count(*) from flow group by 1) group by id order by degree desc, id limit 20".replace("sum(n)", "cast(sum(n) as bigint)"),
)
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return flow_graph(spark, d).hubs(20)


@query("confidence_buckets", f"{FLOW} select count(*) filter (confidence >= 0.97) as high, count(*) filter (confidence >= 0.94 and confidence < 0.97) as medium, count(*) filter (confidence < 0.94) as low from flow")
def confidence_buckets(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence")
    return flow_edges(spark, d).agg(F.count(F.when(c >= 0.97, 1)).alias("high"), F.count(F.when((c >= 0.94) & (c < 0.97), 1)).alias("medium"), F.count(F.when(c < 0.94, 1)).alias("low"))


@query(
    "process_hits",
    f"{with_('proc')} select process, count(distinct symbol) as symbols, min(step) as first_step, max(step) as steps from proc group by process",
)
def process_hits(spark: SparkSession, d: str) -> DataFrame:
    return processes(spark, d).groupBy("process").agg(F.countDistinct("symbol").alias("symbols"), F.min("step").alias("first_step"), F.max("step").alias("steps"))


@query(
    "cluster_aggregate",
    f"""{PARTS}, c as (
      select b.module, a.filePath, count(*) as n, round(avg(confidence), 6) as coh from flow join parts a on a.id = src join parts b on b.id = dst group by all)
    select module, cast(sum(n) as bigint) as symbols, round(sum(coh * n) / sum(n), 4) as cohesion, arg_max(filePath, n * 1000000 - ascii(filePath)) is not null as has_top from c group by module having sum(n) >= 5""",
)
def cluster_aggregate(spark: SparkSession, d: str) -> DataFrame:
    g = flow_graph(spark, d)
    n = g.nodes.select("id", "module", "filePath")
    e = g.edges.join(n.select(F.col("id").alias("src"), "filePath"), "src").join(n.select(F.col("id").alias("dst"), "module"), "dst")
    c = e.groupBy("module", "filePath").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("coh"))
    out = c.groupBy("module").agg(F.sum("n").alias("symbols"), F.round(F.sum(F.col("coh") * F.col("n")) / F.sum("n"), 4).alias("cohesion"), F.max_by("filePath", "n").isNotNull().alias("has_top"))
    return out.filter("symbols >= 5")


@query("module_edges", f"{PARTS} select a.filePath as from_file, b.module as to_module, count(*) as n from flow join parts a on a.id = src join parts b on b.id = dst group by all")
def module_edges(spark: SparkSession, d: str) -> DataFrame:
    g = flow_graph(spark, d)
    n = g.nodes.select("id", "module", "filePath")
    e = g.edges.join(n.select(F.col("id").alias("src"), F.col("filePath").alias("from_file")), "src").join(n.select(F.col("id").alias("dst"), F.col("module").alias("to_module")), "dst")
    return e.groupBy("from_file", "to_module").agg(F.count("*").alias("n"))


@query(
    "mode_per_group",
    "select c_nationkey, c_mktsegment as mode, n from (select c_nationkey, c_mktsegment, count(*) as n, row_number() over (partition by c_nationkey order by count(*) desc, min(c_custkey)) as r from customer group by c_nationkey, c_mktsegment) where r = 1",
)
def mode_per_group(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))
    return first_by(g, ["c_nationkey"], F.desc("n"), "first").select("c_nationkey", F.col("c_mktsegment").alias("mode"), "n")


@query(
    "limit_per_parent",
    f"{FLOW} select src, dst, cast(r as int) as r from (select src, dst, row_number() over (partition by src order by confidence desc, dst) as r from flow) where r <= 4",
)
def limit_per_parent(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = top_per(flow_edges(spark, d), ["src"], 4, F.desc("confidence"), "dst")
    return e.select("src", "dst", F.row_number().over(W.partitionBy("src").orderBy(F.desc("confidence"), "dst")).alias("r"))


@query("run_stats", f"{with_('proc')} select count(*) as processes, round(avg(steps), 1) as mean_steps from (select process, count(*) as steps from proc group by process)")
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return processes(spark, d).groupBy("process").agg(F.count("*").alias("steps")).agg(F.count("*").alias("processes"), F.round(F.avg("steps"), 1).alias("mean_steps"))


@query("event_transitions", f"{with_('users')} select src, dst, n, cast(row_number() over (partition by src order by n desc, dst) as int) as rank from users")
def event_transitions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    return user_edges(spark, d).withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy(F.desc("n"), "dst")))


# traversals

_STRONG = f"{FLOW}, f as (select src, dst from flow where confidence >= 0.98)"


def _strong(spark: SparkSession, d: str) -> DataFrame:
    return flow_edges(spark, d, 0.98)


def _bfs_sql(a: str, b: str, depth: int, stop: str = "") -> str:
    return f"""{_STRONG}, walk(id, depth) as (
      select 13, 0 union select {b}, depth + 1 from walk join f on {a} = id where depth < {depth}{stop}),
    reached as (select id, min(depth) as depth from walk group by id)"""


@query("impact_downstream", f"{_bfs_sql('src', 'dst', 3)} select cast(id as bigint) as id, depth from reached where depth > 0")
def impact_downstream(spark: SparkSession, d: str) -> DataFrame:
    return T.bfs(_strong(spark, d), spark.createDataFrame([(13,)], "id long"), 3).filter("depth > 0")


@query("impact_upstream", f"{_bfs_sql('dst', 'src', 3)} select cast(id as bigint) as id, depth from reached where depth > 0")
def impact_upstream(spark: SparkSession, d: str) -> DataFrame:
    return T.bfs(_strong(spark, d), spark.createDataFrame([(13,)], "id long"), 3, "in").filter("depth > 0")


@query(
    "impact_by_depth",
    f"{_bfs_sql('dst', 'src', 3)} select depth, count(*) as n, min(id)::bigint as first_id from reached where depth > 0 group by depth",
)
def impact_by_depth(spark: SparkSession, d: str) -> DataFrame:
    r = T.bfs(_strong(spark, d), spark.createDataFrame([(13,)], "id long"), 3, "in").filter("depth > 0")
    return r.groupBy("depth").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(
    "impact_stop_nodes",
    f"{_bfs_sql('src', 'dst', 3, " and dst not in (select p_partkey from part where p_name like 'red %')")} select cast(id as bigint) as id, depth from reached where depth > 0",
)
def impact_stop_nodes(spark: SparkSession, d: str) -> DataFrame:
    stop = part_nodes(spark, d).filter("name like 'red %'").select("id")
    return T.bfs(_strong(spark, d), spark.createDataFrame([(13,)], "id long"), 3, stop=stop).filter("depth > 0")


_INH = with_("inherit")


@query(
    "ancestors_bfs",
    f"""{_INH}, walk(root, id, depth) as (
      select src, dst, 1 from inherit union select root, i.dst, depth + 1 from walk join inherit i on i.src = walk.id)
    select root, id, min(depth) as depth from walk where id <> root group by all""",
)
def ancestors_bfs(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.mro import ancestors

    e = inherit_edges(spark, d)
    roots = e.select(F.col("src").alias("id")).distinct()
    return ancestors(e, roots, order=False).select("root", "id", "depth")


@query(
    "transitive_edge_type",
    f"""{_INH}, walk(id, root, depth) as (
      select dst, type, 1 from inherit where src = 1999 or src = 1500 union select i.dst, walk.root, depth + 1 from walk join inherit i on i.src = walk.id)
    select id, min(root) as root, depth from walk where (id, depth) in (select id, min(depth) from walk group by id) and id not in (1999, 1500) group by id, depth""",
)
def transitive_edge_type(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.createDataFrame([(1999,), (1500,)], "id long")
    return T.bfs(inherit_edges(spark, d), seeds, 64, carry="type").filter("depth > 0").select("id", "root", "depth")


@query(
    "toposort_levels",
    f"""{_INH}, walk(id, level) as (
      select p_partkey, 0 from part where p_partkey not in (select src from inherit)
      union select src, level + 1 from walk join inherit on dst = id)
    select id, max(level) as level from walk group by id""",
)
def toposort_levels(spark: SparkSession, d: str) -> DataFrame:
    return T.levels(inherit_edges(spark, d), part_nodes(spark, d).select("id"))


_WEAK = f"{FLOW}, f as (select src, dst from flow where confidence >= 1.0)"


def _weak(spark: SparkSession, d: str) -> DataFrame:
    return flow_edges(spark, d, 1.0)


@query(
    "connected_components",
    f"""{_WEAK}, both_ways as (select src, dst from f union select dst, src from f), walk(id, c) as (
      select p_partkey, p_partkey from part union select dst, c from walk join both_ways on src = id)
    select id, min(c) as component from walk group by id""",
)
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return T.components(_weak(spark, d), part_nodes(spark, d).select("id"))


@query(
    "process_traces",
    f"""{FLOW}, few as (select src, dst from (select src, dst, row_number() over (partition by src order by confidence desc, dst) as r from flow) where r <= 2),
    entries as (select p_partkey as id from part),
    walk(entry, path) as (
      select id, [id] from entries
      union all select entry, list_append(path, dst) from walk join few on src = path[-1] where len(path) < 4 and not list_contains(path, dst)),
    ended as (
      select entry, path from walk where len(path) = 4 or not exists (select 1 from few where src = path[-1] and not list_contains(path, dst)))
    select entry, array_to_string(path, '>') as path from ended where len(path) >= 3""",
)
def process_traces(spark: SparkSession, d: str) -> DataFrame:
    e = flow_edges(spark, d).select("src", "dst", (-F.col("confidence")).alias("rank"))
    entries = part_nodes(spark, d).select("id")
    t = T.traces(e, entries, branch=2, depth=4, per_entry=None)
    return t.select("entry", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))
