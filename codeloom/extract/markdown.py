"""Markdown sections and links, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import join_relative
from ..functions.text import dir_name

LEVELS = 6


def sections(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, line, level, title, end_line, parent_line) of every heading.

    A section ends before the next heading of its own level or above, else
    with the file; its parent is the last heading before it of a lower level.
    Both come from one window over a file's headings: for each level, the
    nearest heading of at most that level.
    """
    lines = F.split(content, "\n")
    x = files.select(key, F.size(lines).alias("n"), F.posexplode(lines).alias("line", "s")).filter(F.col("s").rlike(r"^#{1,6}\s+\S"))
    h = x.select(key, "n", (F.col("line") + 1).alias("line"), F.char_length(F.regexp_extract("s", r"^(#{1,6})\s+", 1)).alias("level"), F.trim(F.regexp_replace("s", r"^#{1,6}\s+", "")).alias("title"))
    w = W.partitionBy(key).orderBy("line")
    after, before = w.rowsBetween(1, W.unboundedFollowing), w.rowsBetween(W.unboundedPreceding, -1)
    ends = F.array(*(F.min(F.when(F.col("level") <= k, F.col("line"))).over(after) for k in range(1, LEVELS + 1)))
    ups = F.array(*(F.max(F.when(F.col("level") < k, F.col("line"))).over(before) for k in range(1, LEVELS + 1)))
    out = h.withColumn("_e", ends).withColumn("_u", ups)
    return out.select(key, "line", "level", "title", F.coalesce(F.element_at("_e", F.col("level")) - 1, F.col("n")).alias("end_line"), F.element_at("_u", F.col("level")).alias("parent_line"))


def links(files: DataFrame, path: str, content: str = "content") -> DataFrame:
    """(path, target) of relative links; no URLs, anchors or mail addresses."""
    found = files.select(path, F.explode(F.regexp_extract_all(content, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))).alias("to"))
    kept = found.filter(~F.col("to").rlike(r"^(?:https?:|#|mailto:)"))
    return kept.select(path, join_relative(dir_name(path), F.element_at(F.split("to", "#"), 1)).alias("target")).distinct()
