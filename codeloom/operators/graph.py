"""A property graph as two DataFrames, and the pattern operators over it.

nodes: id, label, name, filePath and more; edges: src, dst, type, confidence
and more. Every operator is a plan of joins and aggregates; nothing is
collected, so Catalyst chooses the join by size and adaptive execution splits
hot keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import IMPACT_FLOOR


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order (which must be total)."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def top_per(df: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each key."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).filter(F.col("_n") <= k).drop("_n")


def confidence_floor(type: Column) -> Column:
    out = F.lit(0.5)
    for t, v in IMPACT_FLOOR.items():
        out = F.when(type == t, v).otherwise(out)
    return out


@dataclass(frozen=True)
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame

    def label(self, *labels: str) -> DataFrame:
        return self.nodes.filter(F.col("label").isin(*labels))

    def typed(self, types: list[str] | tuple[str, ...] | None = None, min_confidence: float | None = None) -> DataFrame:
        """Edges of these types; a missing confidence passes any threshold."""
        e = self.edges if types is None else self.edges.filter(F.col("type").isin(*types))
        if min_confidence is not None:
            e = e.filter(F.col("confidence").isNull() | (F.col("confidence") >= min_confidence))
        return e

    def both_ways(self, types=None) -> DataFrame:
        e = self.typed(types)
        return e.select("src", "dst", "type", "confidence").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "confidence"))

    def expand(self, from_nodes: DataFrame, direction: str = "out", types=None, min_confidence: float | None = None) -> DataFrame:
        """(id, other, type, confidence) for each edge at the given nodes (id)."""
        e = self.both_ways(types) if direction == "both" else self.typed(types, min_confidence)
        a, b = ("dst", "src") if direction == "in" else ("src", "dst")
        return from_nodes.select("id").join(e.select(F.col(a).alias("id"), F.col(b).alias("other"), "type", "confidence"), "id")

    def optional(self, from_nodes: DataFrame, condition: Column | None = None, types=None) -> DataFrame:
        """Left outer expand; the condition belongs to the edge, so nodes
        without a fitting edge stay, with nulls."""
        e = self.typed(types)
        e = e if condition is None else e.filter(condition)
        return from_nodes.join(e.select(F.col("src").alias("id"), F.col("dst").alias("other"), "type", "confidence"), "id", "left")

    def hops(self, from_nodes: DataFrame, k: int, types=None, min_confidence: float | None = None) -> DataFrame:
        """Paths of exactly k edges as columns n0 .. nk."""
        e = self.typed(types, min_confidence).select("src", "dst")
        out = from_nodes.select(F.col("id").alias("n0"))
        for i in range(k):
            out = out.join(e.select(F.col("src").alias(f"n{i}"), F.col("dst").alias(f"n{i + 1}")), f"n{i}")
        return out.select(*(f"n{i}" for i in range(k + 1)))

    def diamonds(self, types=None) -> DataFrame:
        """(a, b1, b2, c) with a->b1->c, a->b2->c and b1 < b2."""
        e = self.typed(types).select("src", "dst").distinct()
        two = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b")
        left, right = two.select("a", "c", F.col("b").alias("b1")), two.select("a", "c", F.col("b").alias("b2"))
        return left.join(right, ["a", "c"]).filter("b1 < b2 and a <> c").select("a", "b1", "b2", "c")

    def neighbors(self, from_nodes: DataFrame, direction: str = "out", types=None) -> DataFrame:
        """(id, items): the distinct neighbours as sorted structs."""
        x = self.expand(from_nodes, direction, types)
        return x.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("type", "other", "confidence"))).alias("items"))

    def lookup(self, condition: Column, priority: list[str]) -> DataFrame:
        """Nodes that fit, best label first: one scan instead of a union of
        scans by label. Columns of the nodes and ``priority``."""
        rank = F.lit(len(priority))
        for i, label in reversed(list(enumerate(priority))):
            rank = F.when(F.col("label") == label, i).otherwise(rank)
        return self.nodes.filter(condition).withColumn("priority", rank)

    def degrees(self, types=None) -> DataFrame:
        """(id, fan_in, fan_out) of every node with an edge, in one shuffle."""
        e = self.typed(types)
        ends = e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
        return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))

    def hubs(self, k: int, types=None) -> DataFrame:
        d = self.degrees(types).select("id", (F.col("fan_in") + F.col("fan_out")).alias("degree"))
        return d.orderBy(F.desc("degree"), "id").limit(k)

    def label_counts(self) -> DataFrame:
        return self.nodes.groupBy("label").agg(F.count("*").alias("n"))

    def confidence_buckets(self, types=None) -> DataFrame:
        c = F.col("confidence")
        return self.typed(types).agg(
            F.count(F.when(c >= 0.9, 1)).alias("high"),
            F.count(F.when((c >= 0.8) & (c < 0.9), 1)).alias("medium"),
            F.count(F.when(c < 0.8, 1)).alias("low"),
        )

    def orphans(self) -> DataFrame:
        """Edges with an end that isn't a node."""
        ids = self.nodes.select("id")
        e = self.edges
        no_src = e.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
        no_dst = e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return no_src.unionByName(no_dst).distinct()

    def without_files(self, paths: DataFrame) -> PropertyGraph:
        """The graph without the nodes of these files (filePath) and their edges."""
        nodes = self.nodes.join(paths.select("filePath").distinct(), "filePath", "left_anti")
        gone = self.nodes.join(paths.select("filePath").distinct(), "filePath", "left_semi").select("id").distinct()
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return PropertyGraph(nodes.select(*self.nodes.columns), edges.select(*self.edges.columns))

    def export(self, content: bool = False) -> tuple[DataFrame, DataFrame]:
        return (self.nodes if content else self.nodes.drop("content")), self.edges
