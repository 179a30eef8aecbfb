"""Analytical tools: context, impact, changes, rename, overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_test_path, lines
from ..schema import IMPACT_TYPES
from .graph import PropertyGraph, first_by, top_per
from .traverse import bfs

TARGET_ORDER = ("Class", "Interface", "Function", "Method", "Constructor")


def resolve_target(graph: PropertyGraph, name: str) -> DataFrame:
    """The node of a name: Class before Interface, Function, Method,
    Constructor and others; then the least id."""
    return graph.lookup(F.col("name") == name, list(TARGET_ORDER)).orderBy("priority", "id").limit(1)


def risk(direct: Column, processes: Column, modules: Column, total: Column) -> Column:
    return (
        F.when((direct >= 30) | (processes >= 5) | (modules >= 5) | (total >= 200), "CRITICAL")
        .when((direct >= 15) | (processes >= 3) | (modules >= 3) | (total >= 100), "HIGH")
        .when((direct >= 5) | (total >= 30), "MEDIUM")
        .otherwise("LOW")
    )


def impact(graph: PropertyGraph, target: DataFrame, direction: str = "in", depth: int = 3, types=IMPACT_TYPES, min_confidence: float = 0.0, tests: bool = False) -> DataFrame:
    """(id, depth) of what depends on the target ("in") or what it uses."""
    stop = None if tests else graph.nodes.filter(is_test_path("filePath")).select("id")
    return bfs(graph.typed(types, min_confidence), target, depth, direction, stop=stop).filter("depth > 0")


def impact_summary(reached: DataFrame, steps: DataFrame, members: DataFrame) -> DataFrame:
    """One row: total, direct, processes, modules and risk of reached (id,
    depth); steps: id, process; members: id, module."""
    one = lambda df, c, n: df.join(reached.select("id"), "id", "left_semi").agg(F.countDistinct(c).alias(n))
    base = reached.agg(F.count("*").alias("total"), F.count(F.when(F.col("depth") == 1, 1)).alias("direct"))
    row = base.withColumn("_k", F.lit(1)).join(one(steps, "process", "processes").withColumn("_k", F.lit(1)), "_k").join(one(members, "module", "modules").withColumn("_k", F.lit(1)), "_k")
    return row.select("total", "direct", "processes", "modules", risk(F.col("direct"), F.col("processes"), F.col("modules"), F.col("total")).alias("risk"))


def affected_processes(ids: DataFrame, steps: DataFrame, most: int | None = None) -> DataFrame:
    """(process, hits, first_step) of processes with a step in ids."""
    g = steps.join(ids.select("id").distinct(), "id", "left_semi").groupBy("process").agg(F.countDistinct("id").alias("hits"), F.min("step").alias("first_step"))
    return g if most is None else g.orderBy(F.desc("hits"), "process").limit(most)


def context(graph: PropertyGraph, ids: DataFrame, limit: int = 30) -> DataFrame:
    """(id, direction, type, items): the neighbours of each node by direction
    and edge type, at most ``limit`` a side, by id."""
    parts = []
    for name, d in (("incoming", "in"), ("outgoing", "out")):
        x = top_per(graph.expand(ids, d), ["id"], limit, "type", "other")
        parts.append(x.groupBy("id", "type").agg(F.sort_array(F.collect_set("other")).alias("items")).withColumn("direction", F.lit(name)))
    return parts[0].unionByName(parts[1]).select("id", "direction", "type", "items")


def changed_symbols(nodes: DataFrame, files: DataFrame, most: int = 20) -> DataFrame:
    """(file, id): nodes whose path holds a changed file's path, at most so
    many a file. Changed paths join on the equal trailing path first."""
    from ..functions.paths import suffixes

    ends = nodes.select("id", "filePath", F.explode(suffixes("filePath")).alias("file"))
    return top_per(ends.join(files.select("file").distinct(), "file"), ["file"], most, "id").select("file", "id")


def change_risk(processes: Column) -> Column:
    return F.when(processes == 0, "low").when(processes <= 5, "medium").when(processes <= 15, "high").otherwise("critical")


def rename_preview(files: DataFrame, old: str, new: str, defs: DataFrame | None = None) -> DataFrame:
    """(file, line, before, after, source): lines with the old name as a word;
    the first of a file known to the graph is its edit, others are text."""
    import re

    word = rf"\b{re.escape(old)}\b"
    x = files.select("file", F.posexplode(lines("content")).alias("line", "before")).filter(F.col("before").rlike(word))
    x = x.withColumn("after", F.regexp_replace("before", word, new.replace("\\", "\\\\").replace("$", "\\$"))).withColumn("line", F.col("line") + 1)
    if defs is None:
        return x.withColumn("source", F.lit("text"))
    first = first_by(x.join(defs.select("file").distinct(), "file", "left_semi"), ["file"], "line").select("file", "line", F.lit("graph").alias("_g"))
    return x.join(first, ["file", "line"], "left").select("file", "line", "before", "after", F.coalesce("_g", F.lit("text")).alias("source"))


def grep(files: DataFrame, pattern: str, limit: int = 50) -> DataFrame:
    """(file, line, text): lines that match, any case, 200 characters each."""
    if len(pattern) > 200:
        raise ValueError("a pattern has at most 200 characters")
    x = files.select("file", F.posexplode(lines("content")).alias("line", "text")).filter(F.col("text").rlike(f"(?i){pattern}"))
    x = x.select("file", (F.col("line") + 1).alias("line"), F.left(F.trim("text"), F.lit(200)).alias("text"))
    return x.orderBy("file", "line").limit(max(1, min(200, limit)))


def clusters(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, symbols, cohesion, top): clusters of one label together."""
    m = members.join(labels, "community").groupBy("label", "community").agg(F.count("*").alias("n"), F.first("cohesion").alias("c"))
    g = m.groupBy("label").agg(F.sum("n").alias("symbols"), (F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("cohesion"), F.max_by("community", F.struct("n", "community")).alias("top"))
    return g.filter("symbols >= 5")


def resolve_repo(repos: DataFrame, wanted: str | None) -> DataFrame:
    """The repository (id, name, path) of an id, name, path or part of a name;
    the only one, where nothing is asked."""
    if wanted is None:
        return repos.withColumn("_n", F.expr("count(*) over ()")).filter("_n = 1").drop("_n")
    w, low = F.lit(wanted), F.lit(wanted.lower())
    rank = F.when(F.col("id") == w, 0).when(F.lower("name") == low, 1).when(F.col("path") == w, 2).when(F.contains(F.lower("name"), low), 3)
    return repos.withColumn("_r", rank).filter("_r is not null").orderBy("_r", "id").limit(1).drop("_r")
