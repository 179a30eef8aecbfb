"""Shared plumbing: scratch tables in the cluster's shared folder, checked
broadcasts, Arrow batch sizing and small column helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Rows in one Arrow batch of whole texts. Bounds a Python worker's memory.
TEXT_BATCH_ROWS = 256
#: Largest row count that ``join_small`` broadcasts; more rows go by shuffle.
BROADCAST_ROWS = 50_000

_written: list[tuple[SparkSession, str]] = []


def text_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Set the session's Arrow batch size for operators that carry texts.

    The setting stays, since plans run after the operator has returned. The
    package is sent to the workers, too.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a fresh one where it is unset.

    Without that setting only local masters are served, because a folder of
    one machine can't be read by the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    root = "file://" + tempfile.mkdtemp(prefix="codeloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)


class Scratch:
    """Parquet tables of one operator call under the shared folder.

    Writing cuts the lineage: a lost executor costs only the tasks it ran.
    ``drop`` frees a table early; the rest goes when the interpreter ends,
    as returned plans may still read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        _written.append((spark, self.base))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _remove(self.spark, f"{self.base}/{name}")


def within(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than that plus one."""
    return df.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join that broadcasts ``small`` only after counting it.

    Beyond ``rows`` it is a shuffle join whose hot keys adaptive execution
    splits; null keys match nothing, so callers give keys without nulls.
    """
    return big.join(F.broadcast(small) if within(small, rows) else small, on, how)


def doc_bucket(col: str, of: int) -> Column:
    """crc32 of the id written as text, modulo ``of``; null ids fall in 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % of, F.lit(0))
