"""Size checks behind every choice of a broadcast or a one-task-per-key plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_TASK_CONF = "spark.rushlight.rowsPerTask"
BROADCAST_ROWS_CONF = "spark.rushlight.broadcastRows"
BROADCAST_BYTES_CONF = "spark.rushlight.broadcastBytes"


def rows_per_task(spark: SparkSession) -> int:
    """Rows of one key that a single task may hold before the key is split."""
    return int(spark.conf.get(ROWS_PER_TASK_CONF, "4000000"))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_CONF, "200000"))


def broadcast_bytes(spark: SparkSession) -> int:
    """Bytes of the written (compressed, columnar) table up to which it may be broadcast."""
    return int(spark.conf.get(BROADCAST_BYTES_CONF, str(32 << 20)))


def key_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows of the largest key, rows in total) from one map-side combined count."""
    if not keys:
        total = df.count()
        return total, total
    row = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return int(row[0] or 0), int(row[1] or 0)


def fits_one_task(df: DataFrame, keys: list[str], limit: int | None = None) -> bool:
    return key_sizes(df, keys)[0] <= (limit or rows_per_task(df.sparkSession))


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast ``df`` when it is measured to be small; otherwise leave the join to shuffle.

    Both rows and bytes count, since a row may hold a whole scaffold. The table is written first, so
    measuring it does not compute it a second time.
    """
    spark = df.sparkSession
    limit = limit or broadcast_rows(spark)
    written = settle(df)
    if _written_bytes(spark, _settled[spark.sparkContext.applicationId][-1]) > broadcast_bytes(spark):
        return written
    return F.broadcast(written) if written.count() <= limit else written


def _written_bytes(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir")


_settled: dict[str, list[str]] = {}


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage: write the table to the shared folder and read it back.

    Columnar files keep pruning and give the planner real sizes; nothing is lost with an executor.
    Results read these files, so they stay until ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rushlight-{uuid.uuid4().hex}"
    _settled.setdefault(spark.sparkContext.applicationId, []).append(path)
    for watcher in _watching.get():
        watcher.append(path)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


ROWS_PLANNED = 50_000  # rows of a partition that is planned once


@contextmanager
def planned_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside the ``with`` block are planned once, not anew after each of their stages.

    For loops of many rounds over tables of a known size: adaptive execution runs each stage as a job of its own and keeps
    a description of the whole plan for each, so the driver's garbage grows with the square of the rounds in a plan.
    What it would do for small tables is done by ``rows``, those of the largest one: shuffles have a partition for each
    ``ROWS_PLANNED``, and the session's number at most. Both settings are the session's, so they hold for its other
    threads too until the block ends.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(min(parts, rows // ROWS_PLANNED + 1))}
    before = {k: spark.conf.get(k) for k in once}
    try:
        for k, v in once.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_watching: ContextVar[tuple[list[str], ...]] = ContextVar("watching", default=())


@contextmanager
def tables_made() -> Iterator[list[str]]:
    """Paths of the tables that are settled inside the ``with`` block, by this thread alone."""
    mine: list[str] = []
    token = _watching.set((*_watching.get(), mine))
    try:
        yield mine
    finally:
        _watching.reset(token)


def settled(spark: SparkSession) -> list[str]:
    """Settled tables of this application that are still there, oldest first."""
    return list(_settled.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete settled tables, these or all of the application, once the results that read them are written."""
    known = _settled.get(spark.sparkContext.applicationId, [])
    gone = list(known) if paths is None else [p for p in paths if p in known]
    for path in gone:
        delete(spark, path)
        known.remove(path)
    return len(gone)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that this application wrote, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
