"""Incremental updates with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fingerprint
from ..sources.graph_store import GraphStore, last_wins

CHANGE = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("filePath", T.StringType()),
    ]
)


def file_changes(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def upsert_stream(changes: DataFrame, store: GraphStore, checkpoint: str):
    """Applies a stream of node changes (seq, op, id, label, name, filePath).

    Each micro-batch keeps the last change of an id and writes one version of
    the graph; ``op`` delete removes the nodes of that file with their edges.
    A batch that runs again writes the same rows, so recovery is idempotent.
    """

    def apply(batch: DataFrame, number: int) -> None:
        meta = store.meta()
        if meta is not None and meta["lastCommit"] == f"batch-{number}":
            return
        last = last_wins(batch, ["id"], "seq")
        gone = last.filter("op = 'delete'").select("filePath")
        graph = store.read().without_files(gone)
        from ..operators.graph import PropertyGraph
        from ..sources.graph_store import merge

        nodes = merge(graph.nodes, last.filter("op <> 'delete'").drop("op", "seq"), ["id"])
        store.write(PropertyGraph(nodes, graph.edges), f"batch-{number}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def window_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n) per tumbling window; rows later than the
    watermark are dropped by a stream."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def file_states(files: DataFrame) -> DataFrame:
    """(path, hash) of files (filePath, content), for the next comparison."""
    return files.select(F.col("filePath").alias("path"), fingerprint("content").alias("hash"))
