"""Execution flows: entry points, selection of traces, process rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import capitalize, is_test_path, sanitize_id
from ..schema import ENTRY_POINTS, PROCESSES_MAX, PROCESSES_MIN
from .graph import first_by

#: Names of helpers, and of entry points in any language.
HELPER_NAMES = (
    r"^(?:_|utils?$|helpers?$)|(?:Utils?|Helper)$|^(?:can|did|from|get|has|is|set|should|to|will)[A-Z]"
    r"|^(?i:assign|clone|convert|copy|decode|deep|deserialize|encode|extend|filter|find|format|map|merge|parse|reduce|serialize|sort|transform|validate)"
    r"|^(?i:debug|error|info|log|warn)$"
)
ENTRY_NAMES = r"^(?i:bootstrap|init|initialize|main|process|run|setup|start)$|^(?:handle|on|execute|perform|dispatch|trigger|fire|emit)[A-Z]|(?:Controller|Handler)$"
#: Path rules for frameworks: pattern, factor; the first that fits.
FRAMEWORK_PATHS = (
    (r"/app/.*/route\.[jt]s$|/pages/api/", 3.0),
    (r"/(?:controllers?|handlers?|routes?)/", 2.5),
    (r"/views?\.py$|/urls\.py$", 2.5),
    (r"(?:^|/)(?:main|index|server|app)\.[a-z]+$", 2.0),
    (r"/(?:cmd|cli|commands?)/", 2.0),
    (r"/(?:services?|api)/", 1.8),
)


def framework_factor(path: Column) -> Column:
    out = F.lit(1.0)
    for pattern, factor in reversed(FRAMEWORK_PATHS):
        out = F.when(F.lower(path).rlike(pattern), factor).otherwise(out)
    return out


def entry_scores(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, score, callers, callees): callees / (callers + 1), doubled for
    exported nodes, times name and framework factors; 0 without callees."""
    ends = calls.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(calls.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    deg = ends.groupBy("id").agg(F.sum("o").alias("callees"), F.sum("i").alias("callers"))
    n = nodes.join(deg, "id", "left").na.fill(0, ["callees", "callers"])
    name = F.when(F.col("name").rlike(HELPER_NAMES), 0.3).when(F.col("name").rlike(ENTRY_NAMES), 1.5).otherwise(1.0)
    score = F.col("callees") / (F.col("callers") + 1) * F.when(F.col("isExported"), 2.0).otherwise(1.0) * name * framework_factor(F.col("filePath"))
    return n.select("id", F.when(F.col("callees") == 0, 0.0).otherwise(score).alias("score"), "callers", "callees")


def entry_points(nodes: DataFrame, calls: DataFrame, most: int = ENTRY_POINTS) -> DataFrame:
    """The best scored nodes outside tests."""
    code = nodes.filter(~is_test_path("filePath", "entry"))
    return entry_scores(code, calls).filter("score > 0").orderBy(F.desc("score"), "id").limit(most)


def drop_contained(traces: DataFrame) -> DataFrame:
    """Traces (entry, path array) that aren't a run of nodes in a longer one.

    Every longer trace gives its runs, so the test is an equi-join.
    """
    key = lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), ">")
    t = traces.select("entry", "path").distinct().withColumn("key", key(F.col("path")))
    n = F.size("path")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.slice("path", i, k))))
    inner = t.select(F.explode(runs).alias("run"), n.alias("of")).filter(F.size("run") < F.col("of")).select(key(F.col("run")).alias("key")).distinct()
    return t.join(inner, "key", "left_anti").select("entry", "path")


def select_traces(traces: DataFrame, symbols: int) -> DataFrame:
    """Longest trace of each (entry, end), longest first, as many as fit."""
    most = max(PROCESSES_MIN, min(PROCESSES_MAX, round(symbols / 10)))
    key = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    t = drop_contained(traces).withColumn("end", F.element_at("path", -1)).withColumn("key", key)
    t = first_by(t, ["entry", "end"], F.desc(F.size("path")), "key")
    return t.orderBy(F.desc(F.size("path")), "key").limit(most).select("entry", "end", "path")


def process_rows(traces: DataFrame, nodes: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Process rows (process, label, type, steps) and their steps (process, id,
    step from 1); cross_community where steps lie in several communities."""
    key = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    t = traces.withColumn("_i", F.row_number().over(W.orderBy(F.desc(F.size("path")), key)) - 1)  # at most PROCESSES_MAX rows
    names = nodes.select("id", "name")
    t = t.join(names.select(F.col("id").alias("entry"), F.col("name").alias("a")), "entry").join(names.select(F.col("id").alias("end"), F.col("name").alias("b")), "end")
    pid = F.concat(F.lit("proc_"), F.col("_i").cast("string"), F.lit("_"), sanitize_id("a"))
    t = t.withColumn("process", pid).withColumn("label", F.concat(capitalize("a"), F.lit(" → "), capitalize("b")))
    steps = t.select("process", F.posexplode("path").alias("step", "id")).select("process", "id", (F.col("step") + 1).alias("step"))
    m = steps.join(membership.select("id", "community"), "id", "left").groupBy("process").agg(F.countDistinct("community").alias("n"))
    rows = t.select("process", "label", F.size("path").alias("steps")).join(m, "process")
    return rows.select("process", "label", F.when(F.col("n") > 1, "cross_community").otherwise("intra_community").alias("type"), "steps"), steps
