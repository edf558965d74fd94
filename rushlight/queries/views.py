"""How the driver tables stand in for capture tables (Spark and SQL side by side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rushlight.session import table


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that summation order cannot show in the result."""
    return df.select(
        *[
            F.round(F.col(n).cast("double"), digits).alias(n) if kind in ("double", "float") else F.col(n)
            for n, kind in df.dtypes
        ]
    )


def micros(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The sensor stream: user = capture, micros = sample time, k = integer payload."""
    return event_columns(table(spark, folder, "events"))


def event_columns(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select(
        *more,
        F.col("user_id").alias("capture_id"),
        "event_id",
        micros("ts").alias("t"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


EVENTS = """events_v AS (
  SELECT user_id AS capture_id, event_id, epoch_us(ts) AS t, event_type, value,
         CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS k
  FROM events)"""


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Per-frame telemetry columns derived from the event stream."""
    return events(spark, folder).select(
        "capture_id",
        "event_id",
        "t",
        F.col("value").alias("blur_vol"),
        (F.col("k") * 2.5).alias("brightness"),
        (F.col("k") / 500.0).alias("overexposed_ratio"),
        (F.col("value") / 1000.0).alias("underexposed_ratio"),
        F.when(F.col("event_type") != "signup", F.col("value") / 2).alias("motion_diff"),
        F.when(F.col("event_type") != "error", F.lit(0.98) + F.col("k") / 5000.0).alias("hist_correlation"),
    )


SIGNALS = (
    EVENTS
    + """,
signals_v AS (
  SELECT capture_id, event_id, t, value AS blur_vol, k * CAST(2.5 AS DOUBLE) AS brightness,
         k / 500.0 AS overexposed_ratio, value / 1000.0 AS underexposed_ratio,
         CASE WHEN event_type <> 'signup' THEN value / 2 END AS motion_diff,
         CASE WHEN event_type <> 'error' THEN CAST(0.98 AS DOUBLE) + k / 5000.0 END AS hist_correlation
  FROM events_v)"""
)


def vectors(spark: SparkSession, folder: str, dims: dict[str, int]) -> DataFrame:
    """Named (1-based) dimensions of the embedding vectors as doubles."""
    return table(spark, folder, "embeddings").select(
        "vec_id",
        "label",
        *[F.element_at("embedding", i).cast("double").alias(n) for n, i in dims.items()],
    )


def vectors_sql(dims: dict[str, int], name: str = "vectors_v") -> str:
    cols = ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS {n}" for n, i in dims.items())
    return f"{name} AS (SELECT vec_id, label, {cols} FROM embeddings)"
