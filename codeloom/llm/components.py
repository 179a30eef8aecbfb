"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b); component = smallest node.

    Each round every node moves to the neighbour of highest degree (ties by a
    hash that changes with the round) or stays, and edges are rewritten to the
    places moved to. Stars vanish in one round, chains lose a constant share,
    so rounds are logarithmic. No edges leave the executors and each round's
    tables are written, which cuts the lineage. Loops and nulls are ignored.
    """
    e = edges.select("a", "b").filter("a <> b").distinct()
    e = scratch.write(e, f"{name}-edges0")
    nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    where = nodes.withColumn("at", F.col("node"))
    r = 0
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        deg = both.groupBy("a").agg(F.count("*").alias("deg"))
        rank = lambda d, n: F.struct(-F.col(d), F.xxhash64(F.lit(r), F.col(n)), F.col(n).alias("id"))  # noqa: B023, E731
        best = both.join(deg.select(F.col("a").alias("b"), "deg"), "b").groupBy("a").agg(F.min(rank("deg", "b")).alias("best"))
        to = best.join(deg, "a").select("a", F.least("best", rank("deg", "a"))["id"].alias("to"))
        to = scratch.write(to, f"{name}-to{r}")
        where = where.join(to.select(F.col("a").alias("at"), F.col("to")), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
        where = scratch.write(where, f"{name}-at{r}")
        e = (
            e.join(to.select("a", F.col("to").alias("x")), "a")
            .join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        e = scratch.write(e, f"{name}-edges{r + 1}")
        scratch.drop(f"{name}-edges{r}")
        scratch.drop(f"{name}-to{r}")
        if r:
            scratch.drop(f"{name}-at{r - 1}")
        r += 1
    least = where.groupBy("at").agg(F.min("node").alias("component"))
    return where.join(least, "at").select("node", "component")
