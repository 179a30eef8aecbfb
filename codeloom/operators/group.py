"""Groups of repositories: configuration, contract synchronisation, query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import RRF_K
from .contracts import match, unmatched

THRESHOLDS = {"bm25": 0.7, "embedding": 0.65}


def parse_config(config: dict) -> dict:
    """A validated group configuration: version 1, a name, repos by path; links
    name known repositories. Raises ValueError with what is wrong."""
    if config.get("version") != 1:
        raise ValueError("version must be 1")
    if not isinstance(config.get("name"), str) or not config["name"]:
        raise ValueError("name is missing")
    repos = config.get("repos", {})
    if not isinstance(repos, dict) or not all(isinstance(v, str) for v in repos.values()):
        raise ValueError("repos must map names to paths")
    for link in config.get("links") or []:
        for end in ("from", "to"):
            if link.get(end) not in repos:
                raise ValueError(f"link {end} names no repository: {link.get(end)}")
    detect = {"http": True, "grpc": True, "topics": True, "shared_libs": False, **(config.get("detect") or {})}
    return {"version": 1, "name": config["name"], "repos": repos, "links": config.get("links") or [], "packages": config.get("packages") or {}, "detect": detect, "matching": {**THRESHOLDS, **(config.get("matching") or {})}}


def sync(config: dict, contracts: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, rest): matches between the group's repositories and contracts
    without one; written as JSON below target, if given."""
    group = parse_config(config)
    kinds = [k for k, on in (("http", group["detect"]["http"]), ("grpc", group["detect"]["grpc"]), ("topic", group["detect"]["topics"]), ("lib", group["detect"]["shared_libs"])) if on]
    mine = contracts.filter(F.col("repo").isin(list(group["repos"])) & F.substring_index("contractId", "::", 1).isin(kinds))
    links = match(mine)
    rest = unmatched(mine, links)
    if target:
        links.write.mode("overwrite").json(f"{target}/links")
        rest.write.mode("overwrite").json(f"{target}/unmatched")
    return links, rest


def query(hits: DataFrame, limit: int = 10, k: int = RRF_K) -> DataFrame:
    """(repo, id, score): the best of hits (repo, id, score) of all
    repositories by 1 / (k + rank in its own)."""
    r = F.row_number().over(W.partitionBy("repo").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", r).select("repo", "id", (F.lit(1.0) / (k + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "repo", "id").limit(limit)
