"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MINE = threading.local()


def _open() -> list[list[str]]:
    """Tables of this thread's open scopes, innermost last; micro-batches run in a thread of their own."""
    return _MINE.__dict__.setdefault("open", [])


def is_local(spark: SparkSession) -> bool:
    """True if driver and executors are one process, so that a folder of this machine is shared."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Where it is unset, a session that runs in one process gets a temporary folder, removed at its end; on a cluster
    that is an error, since each executor would write to a disk of its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, where, True)
        where = f"file://{where}"
        spark.sparkContext.setCheckpointDir(where)
    return where


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table, on whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _at_end(spark: SparkSession, path: str) -> None:
    try:
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1), True)
        elif spark.sparkContext._jsc is not None:
            delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone, and its files with the cluster's folder
        pass


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all tables settled within it; what they were for must have run by then.

    Outside of a scope tables stay until the driver ends.
    """
    _open().append([])
    try:
        yield
    finally:
        for path in _open().pop():
            delete(spark, path)


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The copy outlives any executor, is columnar and compressed, and lets later stages read only the columns they need.
    It is deleted at the end of the ``scope`` it was written in, else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open():
        _open()[-1].append(path)
    else:
        atexit.register(_at_end, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly if it is read in less than half as many partitions as the cluster has cores; else as it is.

    For costly work a row on tables that were written in one piece.  A table that is cut finely enough, or that comes
    from a shuffle, isn't shuffled.
    """
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
