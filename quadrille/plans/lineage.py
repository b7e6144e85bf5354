"""Cutting lineage by tables written to the folder all executors share.

A written Parquet table survives lost executors, is compressed, and can be
read back column by column; nothing is kept in executor memory.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and everything runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, kind: str = "t") -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/quadrille-{kind}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through the file system that owns it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            drop_path(spark, path)


def cut(df: DataFrame, kind: str = "t") -> DataFrame:
    """Write df once and return it read back, with its schema and a short lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._quadrille_path = path
    return back


def discard(df: DataFrame) -> None:
    """Remove the table of a cut that nothing will read again: the last round of a loop, once the next one is written."""
    path = getattr(df, "_quadrille_path", None)
    if path:
        with contextlib.suppress(ValueError):
            _made.remove((df.sparkSession, path))
        drop_path(df.sparkSession, path)
