"""Exact percentiles with linear interpolation, and average ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rushlight.plans.sizing import key_sizes, rows_per_task
from rushlight.plans.timeline import Timeline


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    wanted: dict[str, tuple[str, float]],
    limit: int | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """One row per key with ``{name: percentile(column, p)}``; NULLs are ignored.

    ``percentile`` keeps every distinct value of a group in one task, so it is used only while
    the largest group fits. Beyond that the values are counted first and the two ranks around
    ``p * (n - 1)`` are read off the running count. ``fits`` skips the size check where the
    caller has measured the keys already.
    """
    limit = limit or rows_per_task(df.sparkSession)
    if key_sizes(df, keys)[0] <= limit if fits is None else fits:
        made = [F.percentile(F.col(c), F.lit(p)).alias(n) for n, (c, p) in wanted.items()]
        return df.groupBy(*keys).agg(*made) if keys else df.agg(*made)

    if not keys:
        return exact_percentiles(df.withColumn("_one", F.lit(1)), ["_one"], wanted, limit, False).drop("_one")
    result = df.select(*keys).distinct()
    by_column: dict[str, dict[str, float]] = {}
    for name, (column, p) in wanted.items():
        by_column.setdefault(column, {})[name] = p
    for column, probs in by_column.items():
        result = result.join(_by_rank(df, keys, column, probs, limit), keys, "left")
    return result


def _by_rank(df: DataFrame, keys: list[str], column: str, probs: dict[str, float], limit: int) -> DataFrame:
    counted = (
        df.filter(F.col(column).isNotNull())
        .groupBy(*keys, F.col(column).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return percentiles_of_counts(counted, keys, "_v", "_n", probs, limit)


def percentiles_of_counts(
    counts: DataFrame,
    keys: list[str],
    value: str,
    count: str,
    probs: dict[str, float],
    limit: int | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Percentiles of values given with how often they occur; one row per (key, value)."""
    counted = counts.select(*keys, F.col(value).cast("double").alias("_v"), F.col(count).alias("_n"))
    line = Timeline(tuple(keys), "_v") if fits else Timeline.measure(counted, keys, "_v", limit=limit)
    summed = line.running(counted, {"_upto": ("sum", F.col("_n"))})
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    placed = summed.join(totals, keys)

    def value_at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") >= rank + 1, F.col("_v")))

    picks = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("_all") - 1)
        picks += [
            value_at(F.floor(at)).alias(f"_lo_{name}"),
            value_at(F.ceil(at)).alias(f"_hi_{name}"),
            F.max(at - F.floor(at)).alias(f"_f_{name}"),
        ]
    found = placed.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
            for n in probs
        ],
    )


def value_ranks(
    df: DataFrame, keys: list[str], column: str, limit: int | None = None, fits: bool | None = None
) -> DataFrame:
    """Distinct values of each key with their count and average rank."""
    counted = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("ties"))
    line = Timeline(tuple(keys), column) if fits else Timeline.measure(counted, keys, column, limit=limit)
    summed = line.running(counted, {"_upto": ("sum", F.col("ties"))})
    return summed.select(
        *keys, column, "ties", (F.col("_upto") - (F.col("ties") - 1) / 2.0).alias("rank")
    )


def average_rank(
    df: DataFrame,
    keys: list[str],
    column: str,
    name: str = "rank",
    limit: int | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """Rank every row within its key; tied values share the mean of their ranks.

    While every key fits one task, one sort gives both the first rank of a value and the count up
    to it. Beyond that equal values are counted before any shuffle, so a value that fills a third
    of the table costs one row per task in the ranking.
    """
    limit = limit or rows_per_task(df.sparkSession)
    if key_sizes(df, keys)[0] <= limit if fits is None else fits:
        ordered = Window.partitionBy(*keys).orderBy(column)
        upto = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, (F.rank().over(ordered) + F.count(F.lit(1)).over(upto)) / 2.0)
    ranks = value_ranks(df, keys, column, limit, fits).select(
        *keys, F.col(column), F.col("rank").alias(name)
    )
    return df.join(ranks, [*keys, column])
