"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK = 250_000  # rows that one task sorts, about

_WORKSPACE: ContextVar[str | None] = ContextVar("workspace", default=None)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tramline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset the warehouse is used, which executors share as well; never a folder of one machine's own.
    """
    root = _WORKSPACE.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Frames materialised inside the block go to one folder, which is deleted at its end.

    For work that ends in a write; a frame read after the block has lost its files.
    """
    path = shared_dir(spark, "run")
    outer = _WORKSPACE.set(path)
    try:
        yield path
    finally:
        _WORKSPACE.reset(outer)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df, name: str):
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(stored: DataFrame, rows: int | None = None) -> int | None:
    """Tasks that take about ``rows`` rows each of a stored frame, whose count costs no pass over it.

    None where that is no more than the cores: Spark's own sizes will do there.
    """
    n = -(-stored.count() // (rows or ROWS_PER_TASK))
    return n if n > stored.sparkSession.sparkContext.defaultParallelism else None


def cut(df: DataFrame, n: int | None, *cols: str) -> DataFrame:
    """``df`` exchanged by ``cols`` into ``n`` tasks, or as many as Spark finds fit.

    Spark fits tasks by their stored bytes and only as finely as there are cores; rows that compress well grow
    many times over when they are sorted. Given ``n`` of ``tasks_for``, a task's rows stay the same for any input.
    """
    keys = [F.col(c) for c in cols]
    return df.repartition(*keys) if n is None else df.repartition(n, *keys)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Rows of a table dealt by ``cols``, which differ from row to row, into tasks of about as many rows; few rows stay as read.

    A task that reads takes a share of the files, and that share grows with the table. What sorts or groups rows before their
    first exchange would hold all of it.
    """
    n = tasks_for(df)
    return df if n is None else df.repartition(n, *[F.col(c) for c in cols])
