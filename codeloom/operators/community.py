"""Communities: clustering graph, local moving, labels, cohesion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import base_name, common_prefix, dir_name
from ..schema import CLUSTER_EDGES, LARGE_GRAPH, SYMBOL_LABELS
from ..session import checkpoint, partitions
from .graph import first_by

GENERIC_DIRS = ("app", "common", "core", "lib", "shared", "src", "utils")


def clustering_graph(nodes: DataFrame, edges: DataFrame, large: bool | None = None) -> DataFrame:
    """(a, b) undirected pairs a < b between symbols. In a large graph only
    edges of confidence 0.5 and nodes of two such edges count."""
    ids = nodes.filter(F.col("label").isin(*SYMBOL_LABELS)).select("id")
    if large is None:
        large = ids.count() > LARGE_GRAPH
    e = edges.filter(F.col("type").isin(*CLUSTER_EDGES) & (F.col("src") != F.col("dst")))
    if large:
        e = e.filter(F.coalesce("confidence", F.lit(1.0)) >= 0.5)
    ids = ids.hint("merge")
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if large:
        ends = e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id")))
        strong = ends.groupBy("id").agg(F.count("*").alias("n")).filter("n >= 2").select("id")
        e = e.join(strong.withColumnRenamed("id", "src"), "src", "left_semi").join(strong.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def modularity(pairs: DataFrame, member: DataFrame, resolution: float = 1.0) -> float:
    """Of a partition (id, community) of an undirected graph of pairs (a, b)."""
    c = lambda k: member.select(F.col("id").alias(k), F.col("community").alias(f"c{k}"))
    j = pairs.join(c("a"), "a").join(c("b"), "b")
    m = pairs.count()
    if not m:
        return 0.0
    inside = j.filter("ca = cb").count()
    ends = j.select(F.col("ca").alias("c")).union(j.select(F.col("cb").alias("c"))).groupBy("c").agg(F.count("*").alias("d"))
    square = ends.agg(F.sum(F.col("d") * F.col("d"))).first()[0]
    return inside / m - resolution * square / (4.0 * m * m)


def communities(pairs: DataFrame, resolution: float = 1.0, rounds: int = 12) -> DataFrame:
    """(id, community) by local moving: in every round a node goes to the
    neighbouring community of the greatest gain in modularity.

    Half of the nodes, chosen by a hash that changes with the round, may move
    at a time, so that neighbours don't swap for ever; ties go to the least
    community. The best partition of all rounds counts, by modularity.
    """
    n = partitions(pairs.sparkSession)
    pairs = checkpoint(pairs.select("a", "b"))
    both = checkpoint(pairs.union(pairs.select("b", "a")).repartition(n, "b").sortWithinPartitions("b"))
    two_m = both.count()
    member = checkpoint(both.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("k")).select("id", F.col("id").alias("community"), "k"))
    if not two_m:
        return member.select("id", "community")
    best = best_q = None
    count = lambda v: F.lit(v).cast("long")
    for r in range(rounds + 1):  # each looks once at all links, for the modularity of what is and for the moves
        total = member.groupBy("community").agg(F.sum("k").alias("tot"))
        at = checkpoint(member.join(total.hint("merge"), "community").select("id", "community", "k", "tot"))
        links = both.join(at.select(F.col("id").alias("b"), "community", "tot").hint("merge"), "b").select(F.col("a").alias("id"), "community", "tot", count(1).alias("w"), count(0).alias("k"), F.lit(False).alias("own"))
        own = at.select("id", "community", "tot", count(0).alias("w"), "k", F.lit(True).alias("own"))
        options = links.unionByName(own).repartition(n, "id").groupBy("id", "community").agg(F.sum("w").alias("w"), F.max("tot").alias("tot"), F.max("k").alias("k"), F.max("own").alias("own"))
        options = options.withColumn("k", F.max("k").over(W.partitionBy("id")))
        rest = F.col("tot") - F.when(F.col("own"), F.col("k")).otherwise(0)
        gain = F.round(F.col("w") - F.lit(resolution) * F.col("k") * rest / two_m, 9)
        mine = lambda c: F.max(F.when(F.col("own"), F.col(c))).alias(c)
        pick = checkpoint(options.groupBy("id").agg(F.min(F.struct((-gain).alias("loss"), "community")).alias("to"), mine("community"), mine("k"), mine("tot"), mine("w")))
        inside, square = pick.agg(F.sum("w"), F.sum(F.col("k") * F.col("tot"))).first()
        m = two_m // 2
        q = inside // 2 / m - resolution * square / (4.0 * m * m)
        if best is None or q > best_q + 1e-9:
            best, best_q = member, q
        elif r > 1 and r % 2 == 0:
            break
        moves = F.pmod(F.xxhash64(F.col("id"), F.lit(r)), F.lit(2)) == 0
        member = pick.select("id", F.when(moves, F.col("to.community")).otherwise(F.col("community")).alias("community"), "k")
    return best.select("id", "community")


def labels(member: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, label, size) of communities of two or more, largest first:
    the most common parent folder that isn't generic, else a common name prefix
    of three or more, else Cluster_n."""
    m = member.join(nodes.select("id", "name", "filePath"), "id").withColumn("dir", base_name(dir_name("filePath")))
    size = m.groupBy("community").agg(F.count("*").alias("size"), F.min("name").alias("lo"), F.max("name").alias("hi")).filter("size >= 2")
    dirs = m.filter((F.col("dir") != "") & ~F.lower("dir").isin(*GENERIC_DIRS)).groupBy("community", "dir").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    top = first_by(dirs, ["community"], F.desc("n"), "first").select("community", "dir")
    prefix = common_prefix("lo", "hi")
    number = F.row_number().over(W.orderBy(F.desc("size"), "community")) - 1
    out = size.join(top, "community", "left").withColumn("_n", number)
    label = F.coalesce(F.initcap("dir"), F.when(F.char_length(prefix) > 2, prefix), F.concat(F.lit("Cluster_"), F.col("_n").cast("string")))
    return out.select("community", label.alias("label"), "size")


def cohesion(pairs: DataFrame, member: DataFrame, most: int = 50) -> DataFrame:
    """(community, cohesion): of the links of its first ``most`` members by id,
    the share that stays inside; 1 without links."""
    first = member.withColumn("_n", F.row_number().over(W.partitionBy("community").orderBy("id"))).filter(F.col("_n") <= most).select("id", "community")
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    j = first.join(both.select(F.col("a").alias("id"), "b"), "id").join(member.select(F.col("id").alias("b"), F.col("community").alias("other")), "b", "left")
    c = j.groupBy("community").agg(F.count("*").alias("n"), F.count(F.when(F.col("other") == F.col("community"), 1)).alias("inside"))
    return member.select("community").distinct().join(c, "community", "left").select("community", F.coalesce(F.col("inside") / F.col("n"), F.lit(1.0)).alias("cohesion"))


def component_communities(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size, cohesion): the share of all edges that lie inside."""
    total = edges.count()
    c = components.select(F.col("id").alias("src"), "component")
    inside = edges.join(c, "src").groupBy("component").agg(F.count("*").alias("n"))
    size = components.groupBy("component").agg(F.count("*").alias("size"))
    return size.join(inside, "component", "left").select("component", "size", F.round(F.coalesce("n", F.lit(0)) / F.lit(max(1, total)), 6).alias("cohesion"))
