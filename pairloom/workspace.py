"""Cutting lineage: intermediate tables in the shared folder that the cluster names.

``spark.checkpoint.dir`` is read from the session.  Only where it is unset (local tests)
is a folder of our own chosen.  Tables are written as Parquet, which is a fraction of the
size of ``DataFrame.checkpoint`` files and is read with column pruning.  All tables of an
application lie in one folder of it, which ``clear`` deletes; it is deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_USED: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def own_dir(spark: SparkSession) -> str:
    """The application's folder for its tables, within shared_dir."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if path not in _USED:
        _USED.add(path)
        atexit.register(_at_exit, spark, path)
    return path


def _at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended first
        _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables of the application: for long sessions, once their results have been written elsewhere."""
    _delete(spark, own_dir(spark))


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or in local mode one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="pairloom-")
    return _FALLBACK[app]


class Table:
    """A written intermediate table; ``drop`` frees its disk once a later one replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.df = spark.read.parquet(path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of stages that are over.

    Executors keep them until the driver's garbage collector meets their handles, which in a small heap
    may be never; a query of many stages asks for that once its large intermediate tables are dropped.
    """
    spark.sparkContext._jvm.System.gc()


def write_table(df: DataFrame, label: str = "t") -> Table:
    """Write ``df`` under the shared folder and return it as a table with short lineage."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Table(spark, path)


def cut(df: DataFrame, label: str = "t") -> DataFrame:
    """``df`` with its lineage cut by a written table."""
    return write_table(df, label).df
