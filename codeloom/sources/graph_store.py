"""Parquet graph store: bulk load, upsert, delete by file, export, metadata."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import csv_field, csv_number
from ..operators.graph import PropertyGraph, first_by


class GraphStore:
    """Versions of a graph below one path: nodes by label, edges by type.

    A version is written whole to a folder of its own name, then a pointer of
    its number is renamed into place; the highest pointer holds. Readers never
    see half of a version, a job that dies anywhere before leaves the old one
    and can run again, and of two writers of one number the second fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def meta(self) -> dict | None:
        p, fs = self._fs(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        at = max((n for n in names if re.fullmatch(r"current-\d{12}\.json", n)), default=None)
        if at is None:
            return None
        return json.loads(self.spark.read.option("wholetext", "true").text(f"{self.path}/{at}").first()[0])

    def _point(self, meta: dict) -> None:
        part, fs = self._fs(f"{self.path}/_{uuid.uuid4().hex}.tmp")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        target, _ = self._fs(f"{self.path}/current-{meta['version']:012d}.json")
        if fs.exists(target) or not fs.rename(part, target):
            fs.delete(part, False)
            raise FileExistsError(f"version {meta['version']} was written by another job")

    def read(self) -> PropertyGraph:
        meta = self.meta()
        if meta is None:
            raise FileNotFoundError(f"no graph at {self.path}")
        base = f"{self.path}/{meta['folder']}"
        return PropertyGraph(self._load(f"{base}/nodes", meta["nodes"]), self._load(f"{base}/edges", meta["edges"]))

    def _load(self, path: str, schema: dict) -> DataFrame:
        """With its schema given: empty tables and labels like numbers stay right."""
        return self.spark.read.schema(T.StructType.fromJson(schema)).parquet(path)

    def write(self, graph: PropertyGraph, commit: str = "", first_wins: str | None = None) -> dict:
        """A new version. With ``first_wins`` (an order column), only the first
        row of a node id stays. Edges without both ends are put aside."""
        old = self.meta()
        version = (old["version"] if old else 0) + 1
        folder = f"v{version}-{uuid.uuid4().hex}"
        base = f"{self.path}/{folder}"
        nodes = graph.nodes if first_wins is None else first_by(graph.nodes, ["id"], first_wins)
        nodes.write.partitionBy("label").parquet(f"{base}/nodes")
        kinds = {"nodes": nodes.schema.jsonValue(), "edges": graph.edges.schema.jsonValue()}
        nodes = self._load(f"{base}/nodes", kinds["nodes"])
        ids = nodes.select("id").distinct()
        good = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        good.select(*graph.edges.columns).write.partitionBy("type").parquet(f"{base}/edges")
        PropertyGraph(nodes, graph.edges).orphans().write.parquet(f"{base}/rejected")
        edges = self._load(f"{base}/edges", kinds["edges"])
        meta = {"version": version, "folder": folder, "lastCommit": commit, "stats": {"nodes": nodes.count(), "edges": edges.count()}, **kinds}
        self._point(meta)
        return meta

    def up_to_date(self, commit: str) -> bool:
        meta = self.meta()
        return bool(commit) and meta is not None and meta["lastCommit"] == commit

    def upsert(self, nodes: DataFrame, edges: DataFrame, commit: str = "") -> dict:
        """Rows of the same id are replaced (edges: of the same ends and type)."""
        g = self.read()
        return self.write(PropertyGraph(merge(g.nodes, nodes, ["id"]), merge(g.edges, edges, ["src", "dst", "type"])), commit)

    def delete_files(self, paths: DataFrame, commit: str = "") -> dict:
        return self.write(self.read().without_files(paths), commit)

    def export_csv(self, target: str) -> None:
        """One folder of quoted CSV lines per label, and one of relations."""
        g = self.read()
        text = [c for c in g.nodes.columns if c not in ("label", "startLine", "endLine", "props")]
        cols = [csv_field(F.col(c).cast("string")) for c in text] + [csv_number(c) for c in ("startLine", "endLine") if c in g.nodes.columns]
        g.nodes.select("label", F.concat_ws(",", *cols).alias("value")).write.partitionBy("label").text(f"{target}/nodes")
        e = [csv_field(F.col(c).cast("string")) for c in ("src", "dst", "type")] + [F.coalesce(F.col("confidence"), F.lit(1.0)).cast("string")]
        g.edges.select(F.concat_ws(",", *e).alias("value")).write.text(f"{target}/edges")


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key isn't in new; of repeated keys
    in new one row stays."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys), allowMissingColumns=True)


def keep_vectors(vectors: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """Cached vectors (nodeId, embedding) that are still of use."""
    ids = nodes.select(F.col("id").alias("nodeId"))
    return vectors.filter(F.size("embedding") == dim).join(ids, "nodeId", "left_semi")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")
