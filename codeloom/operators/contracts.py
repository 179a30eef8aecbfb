"""Contracts across repositories: boundaries, matching, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import contract_key, prefixes
from ..functions.text import base_name, dir_name
from .graph import first_by

MARKERS = ("Cargo.toml", "Dockerfile", "build.gradle", "composer.json", "go.mod", "package.json", "pom.xml", "pyproject.toml", "requirements.txt")


def service_boundaries(files: DataFrame) -> DataFrame:
    """(dir, markers, confidence) of directories below the root with marker
    files: 0.75 for one, 0.9 for two, 1.0 for more."""
    m = files.select("file", base_name("file").alias("name"), dir_name("file").alias("dir")).filter(F.col("name").isin(*MARKERS) & (F.col("dir") != ""))
    g = m.groupBy("dir").agg(F.countDistinct("name").alias("markers"))
    return g.withColumn("confidence", F.when(F.col("markers") >= 3, 1.0).when(F.col("markers") == 2, 0.9).otherwise(0.75))


def assign_service(files: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(file, service): the deepest boundary above each file; an equi-join on
    the file's leading paths instead of a prefix comparison."""
    up = files.select("file", F.explode(F.filter(prefixes("file"), lambda p: p != F.col("file"))).alias("dir"))
    hits = up.join(boundaries.select("dir"), "dir")
    return files.select("file").join(hits.groupBy("file").agg(F.max_by("dir", F.char_length("dir")).alias("service")), "file", "left")


def match(contracts: DataFrame) -> DataFrame:
    """(consumer_repo, consumer_service, consumer_id, provider_repo,
    provider_service, provider_id): exact matches of normal forms.

    A consumer of any method (http::*) whose own form no provider has matches
    all methods of the path. Ends in one repository match only between two
    different services.
    """
    c = contracts.withColumn("key", contract_key("contractId")).withColumn("path", F.regexp_extract("key", "^http::[^:]*::(.*)$", 1))
    p = c.filter("role = 'provider'").select(F.col("repo").alias("provider_repo"), F.col("service").alias("provider_service"), F.col("contractId").alias("provider_id"), "key", "path")
    q = c.filter("role = 'consumer'").select(F.col("repo").alias("consumer_repo"), F.col("service").alias("consumer_service"), F.col("contractId").alias("consumer_id"), "key", "path")
    exact = q.join(p.drop("path"), "key").drop("key", "path")
    any_method = q.filter("key like 'http::*::%'").join(p.select("key").distinct(), "key", "left_anti").drop("key").join(p.drop("key").filter("path <> ''"), "path").drop("path")
    both = exact.unionByName(any_method)
    apart = F.col("provider_service").isNotNull() & F.col("consumer_service").isNotNull() & (F.col("provider_service") != F.col("consumer_service"))
    return both.filter((F.col("provider_repo") != F.col("consumer_repo")) | apart)


def unmatched(contracts: DataFrame, matches: DataFrame) -> DataFrame:
    """(repo, contractId, role) that no match uses."""
    used = matches.select(F.col("consumer_repo").alias("repo"), F.col("consumer_id").alias("contractId"), F.lit("consumer").alias("role"))
    used = used.unionByName(matches.select(F.col("provider_repo").alias("repo"), F.col("provider_id").alias("contractId"), F.lit("provider").alias("role")))
    return contracts.select("repo", "contractId", "role").distinct().join(used.distinct(), ["repo", "contractId", "role"], "left_anti")


def status(repos: DataFrame, registry: DataFrame) -> DataFrame:
    """(repo, state) of repos (repo, head) against the registry (repo, commit):
    missing, stale or fresh."""
    j = repos.join(registry.select("repo", F.col("commit")), "repo", "left")
    return j.select("repo", F.when(F.col("commit").isNull(), "missing").when(F.col("commit") != F.col("head"), "stale").otherwise("fresh").alias("state"))


__all__ = ["MARKERS", "assign_service", "first_by", "match", "service_boundaries", "status", "unmatched"]
