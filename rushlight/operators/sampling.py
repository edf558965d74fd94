"""Even samples, holdouts and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushlight.plans.timeline import Timeline

PROBE_LIMIT = 2000  # Fixed value.
HOLDOUT_STRIDE = 8  # Fixed value.
HOLDOUT_MINIMUM = 16  # Fixed value.


def even_indices(n: Column, count: int) -> Column:
    """Distinct truncated positions of ``count`` points spread over ``0..n-1``."""
    take = F.least(F.lit(count), n.cast("int"))
    step = (n - 1) / F.greatest(take - 1, F.lit(1))
    spread = F.transform(
        F.sequence(F.lit(0), F.greatest(take - 1, F.lit(0))),
        lambda i: F.when((i == take - 1) & (take > 1), n - 1).otherwise(F.floor(i * step)).cast("long"),
    )
    return F.when(n <= 0, F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).otherwise(
        F.array_sort(F.array_distinct(spread))
    )


def even_sample(frames: DataFrame, line: Timeline, count: int) -> DataFrame:
    """Rows of each key at the evenly spread positions, before any wide column is read."""
    keys = list(line.keys)
    numbered = line.number(frames, "_rn")
    wanted = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    wanted = wanted.select(*keys, F.explode(even_indices(F.col("_n"), count)).alias("idx"))
    return numbered.withColumn("idx", F.col("_rn") - 1).drop("_rn").join(wanted, [*keys, "idx"], "left_semi")


def phase_sample(start: Column, end: Column, fps: Column, target: float) -> Column:
    """Every n-th frame of a phase at roughly ``target`` fps, both ends kept."""
    stride = F.greatest(F.lit(1), F.rint(fps / target).cast("int"))
    every = F.coalesce(stride, F.lit(1))
    thin = F.array_sort(F.array_union(F.sequence(start, end, every), F.array(end)))
    keep_all = (fps <= 0) | F.lit(target <= 0) | (F.lit(float(target)) >= fps)
    return F.when(keep_all, F.sequence(start, end)).otherwise(thin)


def evenly_spaced(start: Column, end: Column, count: int) -> Column:
    """``count`` rounded positions from start to end, ends included, distinct."""
    take = F.greatest(F.lit(1), F.least(F.lit(count), (end - start + 1).cast("int")))
    step = (end - start) / F.greatest(take - 1, F.lit(1))
    spread = F.transform(
        F.sequence(F.lit(0), take - 1),
        lambda i: F.when((i == take - 1) & (take > 1), end).otherwise(F.rint(i * step + start)).cast("long"),
    )
    return F.array_sort(F.array_distinct(spread))


def probe_points(points: DataFrame, line: Timeline, maximum: int = PROBE_LIMIT) -> DataFrame:
    """All points of a key, or ``maximum`` spread evenly over its row order when there are more.

    Membership is decided by arithmetic on the row number, so nothing is joined but the counts.
    """
    keys = list(line.keys)
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    numbered = line.number(points, "_rn").join(sizes, keys)
    at = (F.col("_rn") - 1).cast("double")
    step = (F.col("_n") - 1) / F.lit(float(maximum - 1))
    last = F.lit(float(maximum - 1))

    def lands(i: Column) -> Column:
        place = F.when(i == last, (F.col("_n") - 1).cast("double")).otherwise(F.rint(i * step))
        return (i >= 0) & (i <= last) & (place == at)

    hit = lands(F.floor(at / step).cast("double")) | lands(F.ceil(at / step).cast("double"))
    return numbered.filter((F.col("_n") <= maximum) | hit).drop("_rn", "_n")


def holdout_split(frames: DataFrame, line: Timeline, stride: int | None = None) -> DataFrame:
    """Flag every ``stride``-th row of a key as held out, never its ends.

    Without a stride, keys shorter than the minimum hold nothing out.
    """
    keys = list(line.keys)
    sizes = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    numbered = line.number(frames, "_rn").join(sizes, keys).withColumn("idx", F.col("_rn") - 1)
    every = stride if stride is not None else HOLDOUT_STRIDE
    inner = (F.col("idx") > 0) & (F.col("idx") < F.col("_n") - 1)
    if every <= 1:
        held = F.lit(False)
    else:
        held = (F.col("idx") % every == 0) & inner
        if stride is None:
            held = held & (F.col("_n") >= HOLDOUT_MINIMUM)
    return numbered.withColumn("held_out", held).drop("_rn", "_n")


def quota_budget(frames: DataFrame, line: Timeline, maximum: int) -> DataFrame:
    """The first ``maximum`` rows of each key in order; 0 means no budget."""
    if not maximum:
        return frames
    return line.number(frames, "_rn").filter(F.col("_rn") <= maximum).drop("_rn")
