"""Exponential smoothing as a distributed window job."""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rushlight.plans.sizing import settle
from rushlight.plans.timeline import Timeline, join_keyed

CARRY_TERMS = 4


def ema(df: DataFrame, line: Timeline, smoothed: dict[str, str], alpha: float, seeded: bool = True) -> DataFrame:
    """Add ``{name: g}`` with g = g + alpha * (x - g), seeded by the first row of each key or, unseeded, from zero.

    The recurrence is linear, so a chunk of rows needs from its past only the smoothed value at
    the end of the chunk before. Chunks are long enough that a value fades by a million over
    one of them; four earlier chunks therefore hold everything a double can show. Every window
    and group is one chunk, so no key is ever gathered in one task.
    """
    keep = 1.0 - alpha
    size = max(2, math.ceil(math.log(1e-6) / math.log(keep)))
    keys = list(line.keys)
    numbered = line.number(df, "_rn")
    numbered = numbered.withColumn("_chunk", F.floor((F.col("_rn") - 1) / size)).withColumn(
        "_j", ((F.col("_rn") - 1) % size).cast("double")
    )
    weight = F.when(F.col("_rn") == 1, F.lit(1.0)).otherwise(F.lit(alpha)) if seeded else F.lit(alpha)
    upto = Window.partitionBy(*keys, "_chunk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    faded = F.pow(F.lit(keep), F.col("_j"))
    local = numbered.select(
        "*", *[(faded * F.sum(weight * F.col(x) / faded).over(upto)).alias(f"_in_{n}") for n, x in smoothed.items()]
    )
    ends = numbered.groupBy(*keys, "_chunk").agg(
        *[
            F.sum(weight * F.col(x) * F.pow(F.lit(keep), F.lit(size - 1.0) - F.col("_j"))).alias(f"_end_{n}")
            for n, x in smoothed.items()
        ]
    )
    sent = ends.withColumn("_ahead", F.explode(F.array(*[F.lit(i) for i in range(1, CARRY_TERMS + 1)])))
    scale = F.pow(F.lit(keep), F.lit(float(size)) * (F.col("_ahead") - 1))
    carried = sent.groupBy(*keys, (F.col("_chunk") + F.col("_ahead")).alias("_chunk")).agg(
        *[F.sum(scale * F.col(f"_end_{n}")).alias(f"_to_{n}") for n in smoothed]
    )
    whole = join_keyed(local, carried, [*keys, "_chunk"])
    return whole.select(
        *df.columns,
        *[
            (F.col(f"_in_{n}") + faded * keep * F.coalesce(F.col(f"_to_{n}"), F.lit(0.0))).alias(n)
            for n in smoothed
        ],
    )


def gated_ema(
    df: DataFrame, line: Timeline, smoothed: dict[str, str], alpha: float, within: float, allowed: Column
) -> DataFrame:
    """Add ``{name: g}``: from zero, g = g + alpha * (x - g) on ``allowed`` rows whose x lies closer than ``within`` to g.

    Which rows move the mean depends on the mean, so this is no linear recurrence. For given rows it is one: the means
    of a guess come from ``ema``, in chunks, and say which rows should have moved them. Keys where that differs from the
    guess go round again with the new rows. The first row is right at once and each round makes at least the next one
    right, so what stops changing is the recurrence itself; as old rows fade, a few rounds do it. No key is walked by a task.
    """
    keys, names = list(line.keys), list(smoothed)

    def near(means: dict[str, Column]) -> Column:
        away = [F.col(x) - means[n] for n, x in smoothed.items()]
        return allowed & (F.sqrt(sum((a * a for a in away[1:]), away[0] * away[0])) < within)

    kept = [c for c in df.columns]
    active = df.withColumn("_on", F.coalesce(near({n: F.lit(0.0) for n in names}), F.lit(False)))
    done: list[DataFrame] = []
    while True:
        moved = ema(active.filter("_on"), line, {f"_s_{n}": x for n, x in smoothed.items()}, alpha, seeded=False)
        both = moved.unionByName(active.filter("not _on"), allowMissingColumns=True)
        one = F.when(F.col("_on"), F.struct(*[F.col(f"_s_{n}").alias(n) for n in names]))
        after = line.running(both.select(*kept, "_on", one.alias("_one")), {"_mean": ("last", F.col("_one"))})
        before = line.rolling(after, 1, 0, lambda ordered, _: {"_before": F.lag("_mean").over(ordered)})
        want = near({n: F.coalesce(F.col("_before")[n], F.lit(0.0)) for n in names})
        judged = settle(before.select(*kept, "_on", "_mean", F.coalesce(want, F.lit(False)).alias("_want")))
        wrong = judged.filter("_on <> _want").select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        if wrong.isEmpty():
            done.append(judged)
            break
        wrong = settle(wrong)
        done.append(judged.join(wrong, same, "left_anti"))
        active = judged.join(wrong, same, "left_semi").select(*kept, F.col("_want").alias("_on"))
    whole = reduce(DataFrame.unionByName, done)
    return whole.select(*kept, *[F.coalesce(F.col("_mean")[n], F.lit(0.0)).alias(n) for n in names])
