"""Exact nearest neighbours that stay linear under skew and copies.

Positions are counted first, so copies of a point are one row with a weight. The rest is laid
out in blocks of equal size along a space-filling order. A block answers its own points in
one numpy task and gives each an upper bound on its k-th distance; a point then asks only the
blocks that hold points inside that ball, found by an equi join on the cells of the grid level
whose cell is as wide as the ball. No group larger than a block is ever paired with itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushlight.plans.sizing import settle
from rushlight.plans.timeline import Timeline

MIN_SQ_DIST = 1e-14  # Fixed value: floor of a squared distance.
LEVELS = 21  # three indices make one 63-bit code
BLOCK_ROWS = 1024


def _spread(x: Column) -> Column:
    """Put two zero bits between the bits of a 21-bit number."""
    masks = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
    for shift, mask in masks:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _bent(value: Column, axis: str) -> Column:
    return F.asinh((value - F.col(f"_mid_{axis}")) / F.col(f"_wide_{axis}"))


def _index(value: Column, axis: str) -> Column:
    """Finest grid index along an axis, non-decreasing in ``value``.

    The axis is bent like a logarithm away from the middle half of the points, so that far outliers do not take
    the resolution from where the points are.
    """
    low, high = _bent(F.col(f"_lo_{axis}"), axis), _bent(F.col(f"_hi_{axis}"), axis)
    share = F.coalesce(F.try_divide(_bent(value, axis) - low, high - low), F.lit(0.0)) * float(1 << LEVELS)
    return F.greatest(F.lit(0), F.least(F.lit((1 << LEVELS) - 1), F.floor(share))).cast("long")


def _fresh(df: DataFrame) -> DataFrame:
    """Same columns under new ids, so a table can be joined with what was made from it."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _nearest(queries: np.ndarray, points: np.ndarray, weights: np.ndarray, k: int, own: bool):
    """Distances and weights of up to ``k`` nearest points per query, nearest first."""
    keep = min(k, len(points))
    dists, picks = np.empty((len(queries), keep)), np.empty((len(queries), keep), dtype=np.int64)
    for start in range(0, len(queries), 512):
        part = queries[start : start + 512]
        d2 = ((part[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
        if own:  # a point is not its own neighbour
            d2[np.arange(len(part)), np.arange(start, start + len(part))] = np.inf
        near = np.argpartition(d2, keep - 1, axis=1)[:, :keep]
        near_d = np.take_along_axis(d2, near, axis=1)
        order = np.argsort(near_d, axis=1, kind="stable")
        picks[start : start + 512] = np.take_along_axis(near, order, axis=1)
        dists[start : start + 512] = np.take_along_axis(near_d, order, axis=1)
    taken = weights[picks]
    taken[~np.isfinite(dists)] = 0
    return dists, taken


def _radius(dists: np.ndarray, weights: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Squared distance at which the neighbours reach ``need``; inf where they do not."""
    upto = np.cumsum(weights, axis=1)
    reached = upto >= need[:, None]
    first = reached.argmax(axis=1)
    found = np.where(reached.any(axis=1), dists[np.arange(len(dists)), first], np.inf)
    return np.where(need <= 0, 0.0, found)


def knn_mean_sq_dist(
    points: DataFrame, k: int = 3, scene: str = "scene_id", row_id: str = "gid", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Mean squared distance of every point to its ``k`` nearest others in the scene.

    Copies count as neighbours at distance zero. With fewer than ``k`` others all are used; a
    lone point, or one on top of its neighbours, gets the floor.
    """
    xyz = ["x", "y", "z"]
    data = points.select(scene, row_id, *[F.col(c).cast("double").alias(c) for c in xyz])
    distinct = _fresh(data).groupBy(scene, *xyz).agg(F.count(F.lit(1)).alias("_w"))
    boxes = distinct.groupBy(scene).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in xyz],
        *[F.max(c).alias(f"_hi_{c}") for c in xyz],
        *[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"_q_{c}") for c in xyz],
        F.greatest(*[F.max(c) - F.min(c) for c in xyz], F.lit(1e-300)).alias("_side"),
        F.sum("_w").alias("_all"),
    )
    for c in xyz:
        q = F.col(f"_q_{c}")
        inner = F.greatest(F.get(q, 2) - F.get(q, 0), (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * 1e-6, F.lit(1e-300))
        boxes = boxes.withColumns({f"_mid_{c}": F.get(q, 1), f"_wide_{c}": inner}).drop(f"_q_{c}")
    placed = distinct.join(boxes, scene)
    cells = {f"_i{c}": _index(F.col(c), c) for c in xyz}
    placed = placed.withColumns(cells)
    code = _spread(F.col("_ix")).bitwiseOR(F.shiftleft(_spread(F.col("_iy")), 1)).bitwiseOR(
        F.shiftleft(_spread(F.col("_iz")), 2)
    )
    placed = placed.withColumn("_code", code)
    numbered = Timeline.measure(placed, [scene], "_code", xyz).number(placed, "_pid")
    # the layout is read by every later step, so it is written once
    laid = settle(numbered.withColumn("_block", F.floor((F.col("_pid") - 1) / block_rows)).drop("_code"))

    def local(rows: pd.DataFrame) -> pd.DataFrame:
        at, weights = rows[xyz].to_numpy(), rows["_w"].to_numpy()
        need = np.minimum(k, rows["_all"].to_numpy() - 1) - (weights - 1)
        dists, taken = _nearest(at, at, weights, k, own=True)
        return pd.DataFrame(
            {
                scene: rows[scene],
                "_pid": rows["_pid"],
                "_r2": _radius(dists, taken, need),
                "_d": list(dists),
                "_n": list(taken.astype(np.int64)),
            }
        )

    kind = dict(laid.dtypes)[scene]
    found_schema = f"{scene} {kind}, _pid long, _r2 double, _d array<double>, _n array<long>"
    mine = settle(laid.groupBy(scene, "_block").applyInPandas(local, found_schema))

    several = laid.filter(F.col("_block") > 0).limit(1).count() > 0
    theirs = _ask_others(laid, mine, found_schema, scene, k) if several else None
    whole = mine.unionByName(theirs) if several else mine
    each = whole.groupBy(scene, "_pid").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("_d", "_n")))).alias("_near"))
    # walk outwards until enough neighbours are counted; copies of the point come first
    take = F.least(F.lit(k).cast("long"), F.col("_all") - 1)
    start = F.struct(F.least(take, F.col("_w") - 1).alias("got"), F.lit(0.0).alias("sum"))

    def step(state: Column, item: Column) -> Column:
        add = F.least(take - state["got"], item["_n"])
        return F.struct(
            (state["got"] + add).alias("got"),
            (state["sum"] + F.when(add > 0, add * item["_d"]).otherwise(F.lit(0.0))).alias("sum"),
        )

    summed = laid.join(each, [scene, "_pid"]).withColumn("_s", F.aggregate("_near", start, step, lambda s: s["sum"]))
    mean = F.greatest(F.coalesce(F.try_divide(F.col("_s"), take), F.lit(0.0)), F.lit(MIN_SQ_DIST))
    answers = summed.select(scene, *xyz, mean.alias("mean_sq_dist"))
    return data.join(answers, [scene, *xyz]).select(scene, row_id, "mean_sq_dist")


def _ask_others(laid: DataFrame, mine: DataFrame, found_schema: str, scene: str, k: int) -> DataFrame:
    """Neighbours found in other blocks: a ball can only reach points in the cells it overlaps."""
    xyz = ["x", "y", "z"]
    asks = _fresh(laid).join(mine.select(scene, "_pid", "_r2"), [scene, "_pid"])
    reach = F.sqrt(F.col("_r2")) * (1 + 1e-9) + F.col("_side") * 1e-12
    asks = asks.filter(F.col("_r2") > 0).withColumn("_reach", reach)
    for c in xyz:
        asks = asks.withColumns({f"_l{c}": _index(F.col(c) - F.col("_reach"), c), f"_h{c}": _index(F.col(c) + F.col("_reach"), c)})
    # the finest level at which the ball spans two cells at most along every axis; an unbounded ball has level 0
    span = F.greatest(*[F.col(f"_h{c}") - F.col(f"_l{c}") for c in xyz])
    level = F.lit(LEVELS) - F.ceil(F.log2(F.greatest(span, F.lit(1)).cast("double")))
    asks = asks.withColumn("_level", F.greatest(level, F.lit(0)).cast("int"))
    shift = F.lit(1).cast("long") * F.pow(F.lit(2.0), F.lit(LEVELS) - F.col("_level")).cast("long")

    def cell(index: Column) -> Column:
        return F.floor(index / shift).cast("long")

    for c in xyz:
        asks = asks.withColumn(f"_c{c}", F.explode(F.sequence(cell(F.col(f"_l{c}")), cell(F.col(f"_h{c}"))))).drop(f"_l{c}", f"_h{c}")
    keys = [scene, "_level", *[f"_c{c}" for c in xyz]]
    used = [r[0] for r in asks.select("_level").distinct().collect()]  # at most LEVELS + 1 numbers
    occupied = (
        _fresh(laid).withColumn("_level", F.explode(F.array(*[F.lit(v) for v in used]).cast("array<int>")))
        .select(scene, "_level", *[cell(F.col(f"_i{c}")).alias(f"_c{c}") for c in xyz], "_block", *xyz)
        .groupBy(*keys, F.col("_block").alias("_other"))
        .agg(*[F.min(c).alias(f"_min_{c}") for c in xyz], *[F.max(c).alias(f"_max_{c}") for c in xyz])
    )
    gap = [F.greatest(F.col(f"_min_{c}") - F.col(c), F.col(c) - F.col(f"_max_{c}"), F.lit(0.0)) for c in xyz]
    near = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]) <= F.col("_reach")
    pairs = (
        asks.join(occupied, keys)
        .filter((F.col("_other") != F.col("_block")) & near)
        .select(scene, F.col("_other").alias("_block"), "_pid", *xyz)
        .distinct()
    )

    def remote(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        dists, taken = _nearest(queries[xyz].to_numpy(), rows[xyz].to_numpy(), rows["_w"].to_numpy(), k, own=False)
        return pd.DataFrame(
            {
                scene: queries[scene],
                "_pid": queries["_pid"],
                "_r2": np.full(len(queries), np.nan),
                "_d": list(dists),
                "_n": list(taken.astype(np.int64)),
            }
        )

    # blocks nobody asks never reach Python
    asked = pairs.select(scene, "_block").distinct()
    return (
        pairs.groupBy(scene, "_block")
        .cogroup(
            _fresh(laid)
            .select(scene, "_block", *xyz, "_w")
            .join(_fresh(asked), [scene, "_block"], "left_semi")
            .groupBy(scene, "_block")
        )
        .applyInPandas(remote, found_schema)
    )


def init_log_scales(spacing: DataFrame, max_scale: float | None = None) -> DataFrame:
    """Isotropic log scale from the local point spacing."""
    scale = F.sqrt("mean_sq_dist")
    if max_scale is not None:
        scale = F.least(scale, F.lit(max_scale))
    return spacing.withColumn("log_scale", F.log(scale))
