"""Ad-hoc queries through the Cypher front end, and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import PropertyGraph
from ..plans.cypher import run
from ..sources.tables import flow_graph, inherit_edges, part_nodes, supply_edges, table, with_
from ..streaming.incremental import window_counts
from .registry import query

_FP = with_("flow", "parts")


@query(
    "cypher_two_hop",
    f"""{_FP} select a.name as name, count(*) as n, count(distinct c.module) as modules from flow r join flow s on s.src = r.dst join parts a on a.id = r.src join parts c on c.id = s.dst
    where a.label = 'Class' and r.confidence >= 0.99 and s.confidence >= 0.99 group by a.name""",
)
def cypher_two_hop(spark: SparkSession, d: str) -> DataFrame:
    return run(
        flow_graph(spark, d),
        "MATCH (a:Class)-[r:CALLS]->(b)-[s:CALLS]->(c) WHERE r.confidence >= $c AND s.confidence >= $c RETURN a.name AS name, count(*) AS n, count(DISTINCT c.module) AS modules",
        c=0.99,
    )


@query(
    "cypher_optional",
    f"""{_FP} select p.id, count(r.dst) as n from parts p left join flow r on r.src = p.id and r.confidence >= 1.0 where p.label = 'Method' and contains(p.name, 'ring') group by p.id""",
)
def cypher_optional(spark: SparkSession, d: str) -> DataFrame:
    return run(
        flow_graph(spark, d),
        "MATCH (p:Method) WHERE p.name CONTAINS 'ring' OPTIONAL MATCH (p)-[r:CALLS]->(q) WHERE r.confidence >= 1.0 RETURN p.id AS id, count(q) AS n",
    )


@query(
    "cypher_with_top",
    f"{_FP} select name, n from (select p.name, count(*) as n from flow join parts p on p.id = src group by p.name) where n >= 100 order by n desc, name limit 10",
)
def cypher_with_top(spark: SparkSession, d: str) -> DataFrame:
    return run(flow_graph(spark, d), "MATCH (p)-[:CALLS]->(q) WITH p.name AS name, count(*) AS n WHERE n >= 100 RETURN name, n ORDER BY n DESC, name LIMIT 10")


@query(
    "cypher_union",
    f"{_FP} select id, 'Class' as kind from parts where label = 'Class' and name like 'red%' union all select id, 'Method' from parts where label = 'Method' and ends_with(name, 'ring')",
)
def cypher_union(spark: SparkSession, d: str) -> DataFrame:
    return run(
        flow_graph(spark, d),
        "MATCH (n:Class) WHERE n.name STARTS WITH 'red' RETURN n.id AS id, 'Class' AS kind UNION ALL MATCH (n:Method) WHERE n.name ENDS WITH 'ring' RETURN n.id AS id, labels(n)[0] AS kind",
    )


@query(
    "cypher_variable_length",
    f"""{with_('inherit')}, w(id, anc, k) as (select src, dst, 1 from inherit union select id, dst, k + 1 from w join inherit on src = anc where k < 3) select id, count(distinct anc) as n from w group by id""",
)
def cypher_variable_length(spark: SparkSession, d: str) -> DataFrame:
    g = PropertyGraph(part_nodes(spark, d), inherit_edges(spark, d))
    return run(g, "MATCH (a)-[:EXTENDS|IMPLEMENTS*1..3]->(b) RETURN a.id AS id, count(DISTINCT b.id) AS n")


@query(
    "cypher_reverse_collect",
    f"""{with_('supply', 'parts')} select p.module as module, p.label as label, count(distinct s.src) as suppliers from supply s join parts p on p.id = s.dst where s.src in (1, 2, 3, 5, 8, 13) group by all""",
)
def cypher_reverse_collect(spark: SparkSession, d: str) -> DataFrame:
    parts = part_nodes(spark, d)
    sup = table(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("id"), F.lit("Supplier").alias("label"), F.col("s_name").alias("name"), F.lit("").alias("filePath"), F.lit(True).alias("isExported"), F.lit("").alias("module"))
    e = supply_edges(spark, d).withColumn("src", F.col("src") + 1_000_000_000)
    ids = [1_000_000_000 + i for i in (1, 2, 3, 5, 8, 13)]
    return run(PropertyGraph(parts.unionByName(sup), e), "MATCH (p)<-[r:IMPORTS]-(s:Supplier) WHERE s.id IN $ids RETURN p.module AS module, p.label AS label, count(DISTINCT s) AS suppliers", ids=ids)


@query("window_counts", "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all")
def window_count_query(spark: SparkSession, d: str) -> DataFrame:
    return window_counts(table(spark, d, "events"))


@query("cypher_flow_degree", f"{_FP} select p.label, count(*) as links from (select src as id from flow union all select dst from flow) join parts p using (id) group by p.label")
def cypher_flow_degree(spark: SparkSession, d: str) -> DataFrame:
    return run(flow_graph(spark, d), "MATCH (p)-[r:CALLS]-(q) RETURN p.label AS label, count(*) AS links")
