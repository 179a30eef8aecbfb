"""Traversals: breadth-first search, impact, levels, components, traces.

Loops run on the driver, but only counts come to it; each round's frontier is
checkpointed, so plans don't grow and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import TRACE_BRANCH, TRACE_DEPTH, TRACE_MIN_STEPS, TRACES_PER_ENTRY
from ..session import SMALL, checkpoint, partitions, sized


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, direction: str = "out", stop: DataFrame | None = None, carry: str | None = None) -> DataFrame:
    """(id, depth) of all nodes reached, seeds at depth 0.

    stop: nodes (id) that are neither reported nor expanded. carry: an edge
    column whose value at the first step (of several, the least) is passed on.
    """
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    e = checkpoint(edges.select(F.col(a).alias("id"), F.col(b).alias("next"), *([carry] if carry else [])).repartition(partitions(edges.sparkSession), "id").sortWithinPartitions("id"))
    keep = ["root"] if carry else []
    front = seeds.select("id").distinct()
    front = front.withColumn("root", F.lit(None).cast("string")) if carry else front
    front = checkpoint(front)
    seen = front.withColumn("depth", F.lit(0))
    rows = total = front.count()
    for depth in range(1, max_depth + 1):
        step = sized(front, rows).join(e if rows <= SMALL else e.hint("merge"), "id")
        if carry:
            step = step.select(F.col("next").alias("id"), F.coalesce("root", carry).alias("root")).groupBy("id").agg(F.min("root").alias("root"))
        else:
            step = step.select(F.col("next").alias("id")).distinct()
        step = step.join(sized(seen.select("id"), total), "id", "left_anti")
        if stop is not None:
            step = step.join(stop.select("id").hint("merge"), "id", "left_anti")
        front = checkpoint(step)
        rows = front.count()
        total += rows
        if not rows:
            break
        seen = seen.unionByName(front.select("id", *keep, F.lit(depth).alias("depth")))
    return seen


def levels(edges: DataFrame, nodes: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, level): Kahn's rounds over src -> dst (src needs dst first).

    Nodes without an open dependency form a level; nodes of cycles, and those
    that depend on them, form the last level together.
    """
    n = partitions(edges.sparkSession)
    ids = nodes.select("id").filter("id is not null").distinct()
    loops = edges.filter("src = dst").select(F.col("src").alias("id")).distinct()
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    need = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("need"))
    todo = checkpoint(ids.join(loops.hint("merge"), "id", "left_anti").join(need.hint("merge"), "id", "left"))
    e = e.join(todo.withColumnRenamed("id", "src").hint("merge"), "src")
    e = checkpoint(e.repartition(n, "dst").sortWithinPartitions("dst"))
    front, met = checkpoint(todo.filter("need is null").select("id")), None
    out = None
    level = 0
    while level < max_rounds:  # a round looks at those that depend on the last one's nodes
        rows = front.count()
        if not rows:
            break
        ready = front.withColumn("level", F.lit(level))
        out = ready if out is None else out.unionByName(ready)
        more = sized(front.withColumnRenamed("id", "dst"), rows).join(e if rows <= SMALL else e.hint("merge"), "dst").groupBy(F.col("src").alias("id"), "need").agg(F.count("*").alias("met"))
        more = more if met is None else met.unionByName(more).groupBy("id", "need").agg(F.sum("met").alias("met"))
        more = checkpoint(more)
        front, met = more.filter("met = need").select("id"), more.filter("met < need")
        level += 1
    if out is None:
        return ids.withColumn("level", F.lit(level))
    return out.unionByName(ids.join(out.select("id").hint("merge"), "id", "left_anti").withColumn("level", F.lit(level)))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component), the smallest id of each connected component.

    Min-label propagation with pointer jumping: every round takes the least
    label of the neighbours, then the label of that label.
    """
    both = checkpoint(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct().repartition(partitions(edges.sparkSession), "dst").sortWithinPartitions("dst"))
    label = checkpoint(nodes.select("id").distinct().withColumn("label", F.col("id")))
    while True:
        near = both.join(label.select(F.col("id").alias("dst"), "label").hint("merge"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        new = label.join(near.hint("merge"), "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = new.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = checkpoint(new.join(jump.hint("merge"), "label", "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        label = new.select("id", "label")
        if new.filter("old <> label").isEmpty():
            return label.select("id", F.col("label").alias("component"))


def traces(edges: DataFrame, entries: DataFrame, branch: int = TRACE_BRANCH, depth: int = TRACE_DEPTH, min_steps: int = TRACE_MIN_STEPS, per_entry: int | None = TRACES_PER_ENTRY) -> DataFrame:
    """(entry, path): call paths from entries (id) through edges (src, dst, rank).

    At each node the first ``branch`` callees by rank are followed, then those
    already on the path are dropped. A path ends at a node without callees, at
    ``depth`` nodes, or where all callees were on it. Paths of fewer than
    ``min_steps`` nodes are dropped; an entry keeps its first ``per_entry`` by
    length and path.
    """
    order = F.row_number().over(W.partitionBy("src").orderBy("rank", "dst"))
    few = checkpoint(edges.withColumn("_n", order).filter(F.col("_n") <= branch).select("src", "dst"))
    paths = entries.select(F.col("id").alias("entry"), F.col("id").alias("at"), F.array("id").alias("path"))
    done = None
    for n in range(1, depth + 1):
        if n == depth:
            ended = paths
            paths = None
        else:
            step = paths.join(few.withColumnRenamed("src", "at"), "at", "left")
            step = step.withColumn("fresh", F.col("dst").isNotNull() & ~F.array_contains("path", F.coalesce("dst", "at")))
            step = checkpoint(step)
            moved = step.filter("fresh").select("entry", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
            stuck = step.groupBy("entry", "path").agg(F.max("fresh").alias("any")).filter("not any")
            ended = stuck.select("entry", "path")
            paths = moved
        part = ended.select("entry", "path").filter(F.size("path") >= min_steps)
        done = part if done is None else done.unionByName(part)
    if per_entry is not None:
        n = F.row_number().over(W.partitionBy("entry").orderBy(F.size("path"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">")))
        done = done.withColumn("_n", n).filter(F.col("_n") <= per_entry).drop("_n")
    return done


def reach(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root, id, depth): breadth-first search from every root at once."""
    e = checkpoint(edges.select(F.col("src").alias("at"), F.col("dst").alias("id")).distinct().repartition(partitions(edges.sparkSession), "at").sortWithinPartitions("at"))
    front = checkpoint(roots.select(F.col("id").alias("root"), "id").distinct())
    seen = front.withColumn("depth", F.lit(0))
    rows = total = front.count()
    for depth in range(1, max_depth + 1):
        step = sized(front.withColumnRenamed("id", "at"), rows).join(e if rows <= SMALL else e.hint("merge"), "at").select("root", "id").distinct()
        front = checkpoint(step.join(sized(seen.select("root", "id"), total), ["root", "id"], "left_anti"))
        rows = front.count()
        total += rows
        if not rows:
            break
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen


def entry_flags(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, entry) of functions: 1.0 without a caller or named main, else 0.0."""
    called = calls.select(F.col("dst").alias("id")).distinct().withColumn("_c", F.lit(True))
    n = nodes.filter("label = 'Function'").join(called.hint("merge"), "id", "left")
    return n.select("id", F.when(F.col("_c").isNull() | (F.col("name") == "main"), 1.0).otherwise(0.0).alias("entry"))


def hop_impact(edges: DataFrame, target: DataFrame, direction: str = "in", depth: int = 3, limits: tuple[int, ...] = (300, 200, 100)) -> DataFrame:
    """(hop, id, confidence): ends of paths of 1 to 3 edges, each hop limited
    by confidence (the least on a path; the best path of an end counts)."""
    a, b = ("dst", "src") if direction == "in" else ("src", "dst")
    e = edges.select(F.col(a).alias("at"), F.col(b).alias("to"), "confidence")
    paths = target.select(F.col("id").alias("at"), F.lit(1.0).alias("c"))
    out = None
    for hop in range(1, min(depth, len(limits)) + 1):
        paths = paths.join(e, "at").select(F.col("to").alias("at"), F.least("c", "confidence").alias("c")).groupBy("at").agg(F.max("c").alias("c"))
        part = paths.join(target.select(F.col("id").alias("at")), "at", "left_anti").orderBy(F.desc("c"), "at").limit(limits[hop - 1])
        part = part.select(F.lit(hop).alias("hop"), F.col("at").alias("id"), F.col("c").alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out
