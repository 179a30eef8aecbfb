"""API routes: registry, linking of fetches, shapes, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import expo_route, fetch_url, next_route, php_route, reason_fetches, reason_keys, route_matches, segments
from .graph import first_by


def file_routes(files: DataFrame, expo: bool = False) -> DataFrame:
    """(url, file, source): routes by the place of a file (file, ord); Expo
    before Next.js before PHP, the first file of a URL wins."""
    kinds = ([("expo", expo_route)] if expo else []) + [("nextjs", next_route), ("php", php_route)]
    found = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(n).alias("source"), f("file").alias("url")) for i, (n, f) in enumerate(kinds)))
    some = files.select("file", "ord", F.explode(found).alias("r")).select("file", "ord", "r.*").filter("url is not null")
    some = first_by(some, ["file"], "rank")
    return first_by(some, ["url"], "rank", "ord", "file").select("url", "file", "source")


def registry(*sources: DataFrame) -> DataFrame:
    """(url, file, source) of sources of routes in order of priority; the first
    URL wins, and URLs begin with a slash."""
    all_ = None
    for i, s in enumerate(sources):
        part = s.select(F.when(F.col("url").startswith("/"), F.col("url")).otherwise(F.concat(F.lit("/"), "url")).alias("url"), "file", "source", F.lit(i).alias("rank"))
        all_ = part if all_ is None else all_.unionByName(part)
    return first_by(all_, ["url"], "rank", "file").select("url", "file", "source")


def link_fetches(fetches: DataFrame, routes: DataFrame) -> DataFrame:
    """(file, url, route, reason): each fetched URL with the first route (ord)
    that it fits.

    Routes of a fixed length join on the number of segments; only catch-all
    routes, which are few, join on a lower bound of it.
    """
    f = fetches.withColumn("url", fetch_url("url")).filter("url is not null").withColumn("_n", F.size(segments("url")))
    urls = f.select("url", "_n").distinct()
    r = routes.select(F.col("url").alias("route"), "ord").withColumn("_parts", segments("route")).withColumn("_n", F.size("_parts"))
    rest = F.coalesce(F.try_element_at("_parts", F.col("_n")), F.lit("")).rlike(r"^\[{1,2}\.\.\.")
    fixed = urls.join(r.filter(~rest).select("route", "ord", "_n"), "_n").filter(route_matches("url", "route")).select("url", "route", "ord")
    catch = r.filter(rest).select("route", "ord", (F.col("_n") - 1).alias("least"))
    any_ = urls.join(catch, F.col("_n") >= F.col("least")).filter(route_matches("url", "route")).select("url", "route", "ord")
    best = first_by(fixed.unionByName(any_), ["url"], "ord")
    return f.join(best.select("url", "route"), "url").select("file", "url", "route", "reason")


def consumers(links: DataFrame) -> DataFrame:
    """(route, file, keys, multi): what each consumer reads of each route."""
    return links.select("route", "file", reason_keys("reason").alias("keys"), (reason_fetches("reason") > 1).alias("multi")).distinct()


def route_map(routes: DataFrame, links: DataFrame) -> DataFrame:
    """(url, middleware, consumers, files) of every route."""
    c = links.groupBy(F.col("route").alias("url")).agg(F.countDistinct("file").alias("consumers"), F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))
    return routes.select("url", "middleware").join(c, "url", "left").withColumn("consumers", F.coalesce("consumers", F.lit(0)))


def shape_mismatches(routes: DataFrame, links: DataFrame) -> DataFrame:
    """(route, file, field, confidence): keys a consumer reads that a route
    never sends; low where the file fetches several routes."""
    known = routes.select(F.col("url").alias("route"), F.concat("responseKeys", F.coalesce("errorKeys", F.array().cast("array<string>"))).alias("known"))
    x = consumers(links).join(known, "route").filter(F.size("known") > 0)
    x = x.select("route", "file", F.explode(F.array_except("keys", "known")).alias("field"), F.when(F.col("multi"), "low").otherwise("high").alias("confidence"))
    return x.groupBy("route", "file", "field").agg(F.min("confidence").alias("confidence"))


def api_impact(routes: DataFrame, links: DataFrame) -> DataFrame:
    """(url, consumers, mismatches, risk): HIGH from 10 consumers, MEDIUM from
    4, one level more with a mismatch."""
    n = links.groupBy(F.col("route").alias("url")).agg(F.countDistinct("file").alias("consumers"))
    m = shape_mismatches(routes, links).groupBy(F.col("route").alias("url")).agg(F.count("*").alias("mismatches"))
    out = routes.select("url").join(n, "url", "left").join(m, "url", "left").na.fill(0)
    level = F.when(F.col("consumers") >= 10, 2).when(F.col("consumers") >= 4, 1).otherwise(0) + F.when(F.col("mismatches") > 0, 1).otherwise(0)
    names = F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH"), F.lit("HIGH"))
    return out.select("url", "consumers", "mismatches", F.element_at(names, level + 1).alias("risk"))


def middleware_routes(rules: DataFrame, routes: DataFrame) -> DataFrame:
    """(url, name) of rules (name, kind, pattern): exact, prefix or regex."""
    fits = (
        F.when(F.col("kind") == "exact", F.col("url") == F.col("pattern"))
        .when(F.col("kind") == "prefix", (F.col("url") == F.col("pattern")) | F.startswith(F.col("url"), F.concat("pattern", F.lit("/"))))
        .otherwise(F.expr("url rlike pattern"))
    )
    return routes.join(F.broadcast(rules), fits).select("url", "name").distinct()  # a project's rules are a handful


def entry_links(handlers: DataFrame, processes: DataFrame) -> DataFrame:
    """(src, process, confidence): routes or tools (id, file) whose file holds
    a process's entry (process, entry_file)."""
    p = processes.select("process", F.col("entry_file").alias("file"))
    return handlers.join(p, "file").select(F.col("id").alias("src"), "process", F.lit(0.85).alias("confidence"))


def model_links(queries: DataFrame, models: DataFrame) -> DataFrame:
    """(file, model, target, method): ORM calls (file, orm, model, method) to the
    model's node if there is one (Class, Interface, CodeElement), else to a
    made-up id; once a file, model and method."""
    order = F.when(F.col("label") == "Class", 0).when(F.col("label") == "Interface", 1).otherwise(2)
    m = first_by(models.filter(F.col("label").isin("Class", "CodeElement", "Interface")).withColumn("_o", order), ["name"], "_o", "id").select(F.col("name").alias("model"), "id")
    q = queries.select("file", "orm", "model", "method").dropDuplicates(["file", "model", "method"])
    return q.join(m, "model", "left").select("file", "model", F.coalesce("id", F.concat(F.lit("CodeElement:"), "orm", F.lit(":"), "model")).alias("target"), "method")


def count_over(df: DataFrame, *keys: str) -> DataFrame:
    return df.withColumn("n", F.count("*").over(W.partitionBy(*keys)))
