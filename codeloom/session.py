"""Getting this package to the Python workers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers of this session's context, once.

    Python functions are sent by reference, so workers that don't share the
    driver's path need the modules themselves.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="codeloom-code-")) / "codeloom_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def checkpoint(df):
    """df written to the cluster's shared checkpoint folder, its lineage cut.

    The folder is the one in ``spark.checkpoint.dir``; where that is unset, and
    only on a local master, a fresh one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """Partitions for work that is larger than its rows in bytes; given to
    repartition(), adaptive execution doesn't merge them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


SMALL = 100_000


def sized(df, rows: int):
    """df of so many rows, for a join: broadcast if it is small, else sorted.

    Spark's own guess from the bytes of compressed files is far too low.
    """
    return df.hint("broadcast") if rows <= SMALL else df.hint("merge")


def _shared(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_tables: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    for spark, path in _tables:
        if spark.sparkContext._jsc is not None:
            try:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            except Exception:  # the session may be gone when the interpreter ends
                pass


def written(df):
    """df as a Parquet table in the same folder, which is removed when the
    interpreter ends. Unlike a checkpoint this is a query of its own, so
    observed metrics are there when it returns."""
    path = f"{_shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _tables.append((df.sparkSession, path))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df):
    """df in at least as many partitions as there are cores.

    For work on whole texts that would else run in the few partitions of a
    small table; larger tables are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
