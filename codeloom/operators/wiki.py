"""Aggregates for documentation: exports, call edges, modules, skills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import PropertyGraph, top_per


def exports(nodes: DataFrame) -> DataFrame:
    """(filePath, n, names) of the exported symbols of each file."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "id"))), lambda x: x["name"]), ",")
    return nodes.filter("isExported").groupBy("filePath").agg(F.count("*").alias("n"), names.alias("names"))


def _ends(graph: PropertyGraph, column: str) -> DataFrame:
    n = graph.nodes.select("id", column)
    a, b = n.select(F.col("id").alias("src"), F.col(column).alias("a")), n.select(F.col("id").alias("dst"), F.col(column).alias("b"))
    return graph.typed(["CALLS"]).join(a, "src").join(b, "dst")


def file_calls(graph: PropertyGraph) -> DataFrame:
    """(from_file, to_file, n) of calls between different files."""
    return _ends(graph, "filePath").filter("a <> b").groupBy(F.col("a").alias("from_file"), F.col("b").alias("to_file")).agg(F.count("*").alias("n"))


def boundary_calls(graph: PropertyGraph) -> DataFrame:
    """(module, inside, leaving) calls of each module."""
    return _ends(graph, "module").groupBy(F.col("a").alias("module")).agg(F.count(F.when(F.col("a") == F.col("b"), 1)).alias("inside"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("leaving"))


def module_calls(graph: PropertyGraph, files: DataFrame, most: int = 30) -> DataFrame:
    """(direction, src, dst): calls into and out of a set of files (filePath)."""
    inside = graph.nodes.join(files.select("filePath").distinct(), "filePath", "left_semi").select("id")
    e = graph.typed(["CALLS"]).select("src", "dst")
    a, b = inside.withColumnRenamed("id", "src"), inside.withColumnRenamed("id", "dst")
    out = e.join(a, "src", "left_semi").join(b, "dst", "left_anti").withColumn("direction", F.lit("out"))
    into = e.join(b, "dst", "left_semi").join(a, "src", "left_anti").withColumn("direction", F.lit("in"))
    return top_per(out.unionByName(into), ["direction"], most, "src", "dst").select("direction", "src", "dst")


def process_steps(steps: DataFrame) -> DataFrame:
    """(process, steps, n): the symbols of each process in order."""
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "symbol"))), lambda x: x["symbol"]), ">")
    return steps.groupBy("process").agg(path.alias("steps"), F.count("*").alias("n"))


def module_tree(nodes: DataFrame, depth: int = 1) -> DataFrame:
    """(module, files, symbols) by the first parts of the path."""
    module = F.array_join(F.slice(F.split("filePath", "/"), 1, depth), "/")
    return nodes.groupBy(module.alias("module")).agg(F.countDistinct("filePath").alias("files"), F.count("*").alias("symbols"))


def skills(graph: PropertyGraph, member: DataFrame, most: int = 10) -> DataFrame:
    """(community, members, files, top, links): what a skill file shows."""
    m = member.join(graph.nodes.select("id", "name", "filePath"), "id")
    base = m.groupBy("community").agg(F.count("*").alias("members"), F.countDistinct("filePath").alias("files"))
    deg = graph.degrees(["CALLS"]).select("id", (F.col("fan_in") + F.col("fan_out")).alias("d"))
    top = top_per(m.join(deg, "id", "left").na.fill(0, ["d"]), ["community"], most, F.desc("d"), "id")
    top = top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("d"), "id", "name"))), lambda x: x["name"]), ",").alias("top"))
    c = lambda k: member.select(F.col("id").alias(k), F.col("community").alias(f"c{k}"))
    cross = graph.typed(["CALLS"]).join(c("src"), "src").join(c("dst"), "dst").filter("csrc <> cdst").groupBy(F.col("csrc").alias("community")).agg(F.count("*").alias("links"))
    return base.join(top, "community", "left").join(cross, "community", "left").na.fill(0, ["links"])
