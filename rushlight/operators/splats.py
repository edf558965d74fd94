"""Splat tables: decode, prune, order, truncate, quantise, sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushlight.functions import encoding as enc
from rushlight.functions import geometry as g
from rushlight.plans.quantiles import exact_percentiles
from rushlight.plans.sizing import settle, small
from rushlight.plans.timeline import Timeline

MIN_OPACITY = 0.02  # Fixed value.
DEAD_OPACITY = 0.005  # Fixed value.
GROWTH = 0.05  # Fixed value.


def visible(splats: DataFrame, min_opacity: float = MIN_OPACITY) -> DataFrame:
    return splats.filter(F.col("opacity") >= min_opacity)


def visible_alpha(splats: DataFrame, min_opacity: float = MIN_OPACITY) -> DataFrame:
    """4-D form: compares the alpha byte; no threshold keeps everything."""
    return splats.filter(F.col("a") >= int(round(min_opacity * 255))) if min_opacity > 0 else splats


def pruned_counts(splats: DataFrame, min_opacity: float = MIN_OPACITY, scene: str = "scene_id") -> DataFrame:
    """Rows kept and pruned per scene; ``empty`` marks scenes nothing would be left of."""
    keep = F.col("a") >= int(round(min_opacity * 255))
    return splats.groupBy(scene).agg(
        F.count_if(keep).alias("kept"), F.count_if(~keep).alias("pruned"), (F.count_if(keep) == 0).alias("empty")
    )


def decode_splats(raw: DataFrame, rounded_colour: bool = False) -> DataFrame:
    """Trained rows to usable ones: opacity, linear scales, colour bytes, unit quaternion."""
    q = g.vec("rot_0", "rot_1", "rot_2", "rot_3")
    size = g.length(q)
    safe = F.when(size == 0, F.lit(1.0)).otherwise(size)
    made = {"opacity": enc.sigmoid(F.col("opacity"))}
    made |= {f"s{a}": F.exp(f"scale_{i}") for i, a in enumerate("xyz")}
    made |= {c: enc.colour_byte(F.col(f"f_dc_{i}"), rounded_colour) for i, c in enumerate("rgb")}
    made |= {n: F.col(f"rot_{i}") / safe for i, n in enumerate(("qw", "qx", "qy", "qz"))}
    dropped = [c for c in raw.columns if c.startswith(("rot_", "scale_", "f_dc_"))]
    return raw.withColumns(made).drop(*dropped)


def importance(sx: Column, sy: Column, sz: Column, opacity: Column) -> Column:
    """Covered volume times opacity."""
    floor = F.lit(1e-12)
    return F.greatest(sx, floor) * F.greatest(sy, floor) * F.greatest(sz, floor) * opacity


def importance_rank(splats: DataFrame, value: str, group: list[str], row_id: str, name: str = "rank") -> DataFrame:
    """1-based rank by falling importance within each group, ties by id."""
    keyed = splats.withColumn("_neg", -F.col(value))
    return Timeline.measure(keyed, group, "_neg", [row_id]).number(keyed, name).drop("_neg")


def order_by_importance(splats: DataFrame, value: str, scene: str, dynamic: str, row_id: str) -> DataFrame:
    """Global position per scene: the dynamic group first, each by falling importance."""
    ranked = importance_rank(splats, value, [scene, dynamic], row_id)
    counts = splats.groupBy(scene).agg(F.count_if(F.col(dynamic)).alias("_moving"))
    position = F.col("rank") - 1 + F.when(F.col(dynamic), 0).otherwise(F.col("_moving"))
    return ranked.join(small(counts), scene).withColumn("position", position).drop("_moving")


def truncate(ordered: DataFrame, maximum: int, scene: str, dynamic: str) -> DataFrame:
    """Keep the most important rows of both groups in proportion; ``rank`` comes from the order."""
    counts = ordered.groupBy(scene).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col(dynamic)).alias("_moving")
    )
    cap = max(1, int(maximum))
    share = F.rint(F.col("_moving") * (F.lit(float(cap)) / F.col("_all"))).cast("long")
    moving = F.least(F.col("_moving"), F.greatest(F.lit(1), share))
    still = F.least(F.greatest(F.lit(0), F.lit(cap) - moving), F.col("_all") - F.col("_moving"))
    quota = F.when(F.col(dynamic), moving).otherwise(still)
    keep = (F.col("_all") <= cap) | (F.col("rank") <= quota)
    return ordered.join(small(counts), scene).filter(keep).drop("_all", "_moving")


def grid_bounds(df: DataFrame, keys: list[str], columns: list[str], floor: float = enc.GRID_SPAN_FLOOR) -> DataFrame:
    """Origin and span per column; a flat axis gets a tiny span."""
    made = []
    for c in columns:
        made += [F.min(c).alias(f"{c}_origin"), F.greatest(F.max(c) - F.min(c), F.lit(floor)).alias(f"{c}_span")]
    return df.groupBy(*keys).agg(*made) if keys else df.agg(*made)


def aabb(df: DataFrame, keys: list[str], columns: list[str], margin: float = 0.1) -> DataFrame:
    """Axis-aligned bounds padded by a share of each span."""
    made = []
    for c in columns:
        pad = F.greatest(F.max(c) - F.min(c), F.lit(1e-6)) * margin
        made += [(F.min(c) - pad).alias(f"{c}_lo"), (F.max(c) + pad).alias(f"{c}_hi")]
    return df.groupBy(*keys).agg(*made)


def scene_framing(points: DataFrame, keys: list[str], columns: list[str], percent: float = 2.0) -> DataFrame:
    """Centre and radius of the box between two percentiles of each axis."""
    p = percent / 100.0
    wanted = {}
    for c in columns:
        wanted |= {f"_lo_{c}": (c, p), f"_hi_{c}": (c, 1 - p)}
    spread = exact_percentiles(points, keys, wanted)
    size = F.sqrt(
        sum(
            ((F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) for c in columns[1:]),
            (F.col(f"_hi_{columns[0]}") - F.col(f"_lo_{columns[0]}")) * (F.col(f"_hi_{columns[0]}") - F.col(f"_lo_{columns[0]}")),
        )
    )
    return spread.select(
        *keys,
        *[((F.col(f"_lo_{c}") + F.col(f"_hi_{c}")) / 2).alias(f"{c}_centre") for c in columns],
        F.when(size > 0, size / 2).otherwise(F.lit(1.0)).alias("radius"),
    )


def splat_summary(splats: DataFrame, keys: list[str], scales: list[str], opacity: str) -> DataFrame:
    """Count, median of all scale components, mean opacity."""
    each = splats.select(*keys, F.explode(F.array(*[F.col(s) for s in scales])).alias("_scale"))
    middle = exact_percentiles(each, keys, {"median_scale": ("_scale", 0.5)})
    counted = splats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(opacity).alias("mean_opacity"))
    return counted.join(middle, keys)


def scene_scale(points: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Median distance from the centroid; 1 where that is not a positive number."""
    centre = points.groupBy(*keys).agg(*[F.avg(c).alias(f"_m{c}") for c in columns])
    away = g.length(tuple(F.col(c) - F.col(f"_m{c}") for c in columns))
    spread = points.join(small(centre), keys).withColumn("_r", away)
    middle = exact_percentiles(spread, keys, {"_s": ("_r", 0.5)})
    good = (F.col("_s") > 0) & (F.col("_s") < float("inf"))
    return middle.select(*keys, F.when(good, F.col("_s")).otherwise(F.lit(1.0)).alias("scene_scale"))


def probe_grid_resolution(splats: DataFrame, keys: list[str], columns: list[str], scales: list[str], opacity: str) -> DataFrame:
    """Is the position grid too coarse for the median gaussian? An outlier stretches the box."""
    spans = grid_bounds(splats, keys, columns)
    sizes = splat_summary(splats, keys, scales, opacity).select(*keys, "median_scale")
    step = enc.grid_step(F.greatest(*[F.col(f"{c}_span") for c in columns]))
    return spans.join(sizes, keys).select(
        *keys,
        step.alias("step"),
        "median_scale",
        ((F.col("median_scale") > 0) & (step >= F.col("median_scale") / 4)).alias("refused"),
    )


def quantise_positions(splats: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    bounds = grid_bounds(splats, keys, columns)
    joined = splats.join(small(bounds), keys)
    codes = {f"{c}_code": enc.quantise_grid(F.col(c), F.col(f"{c}_origin"), F.col(f"{c}_span")) for c in columns}
    return joined.withColumns(codes)


def pack_geometry(splats: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Four 32-bit words per splat: 16-bit positions and log scales (one shared grid), quaternion."""
    logs = splats.withColumns({f"_l{a}": F.log(F.greatest(F.col(f"s{a}"), F.lit(1e-12))) for a in "xyz"})
    names = [f"_l{a}" for a in "xyz"]
    shared = logs.groupBy(scene).agg(
        *[F.min(a).alias(f"{a}_origin") for a in "xyz"],
        *[F.greatest(F.max(a) - F.min(a), F.lit(enc.GRID_SPAN_FLOOR)).alias(f"{a}_span") for a in "xyz"],
        F.min(F.least(*names)).alias("_lo"),
        F.max(F.greatest(*names)).alias("_hi"),
    )
    joined = logs.join(small(shared), scene)
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(enc.GRID_SPAN_FLOOR))
    joined = joined.withColumns(
        {f"_p{a}": enc.quantise_grid(F.col(a), F.col(f"{a}_origin"), F.col(f"{a}_span")) for a in "xyz"}
        | {f"_k{a}": enc.quantise_grid(F.col(f"_l{a}"), F.col("_lo"), span) for a in "xyz"}
        | {"_q": enc.pack_quat32(g.vec("qw", "qx", "qy", "qz"))}
    )
    words = enc.geometry_words(g.vec("_px", "_py", "_pz"), g.vec("_kx", "_ky", "_kz"), F.col("_q"))
    keep = [c for c in splats.columns if c not in ("x", "y", "z", "sx", "sy", "sz", "qw", "qx", "qy", "qz")]
    return joined.select(*keep, *[w.alias(f"word{i}") for i, w in enumerate(words)])


def pack_trajectory_rows(traj: DataFrame, line: Timeline, scene: str = "scene_id") -> DataFrame:
    """Seven codes per (frame, node): four signed quaternion codes, three translation codes."""
    from rushlight.operators.skinning import hemisphere_continuous

    smooth = hemisphere_continuous(traj, line)
    bounds = grid_bounds(smooth, [scene], ["tx", "ty", "tz"], enc.TRAJECTORY_SPAN_FLOOR)
    joined = smooth.join(small(bounds), scene)
    codes = enc.pack_quat_snorm16(g.vec("qw", "qx", "qy", "qz"))
    return joined.select(
        scene,
        "frame",
        "node",
        *[c.alias(n) for c, n in zip(codes, ("qw", "qx", "qy", "qz"), strict=True)],
        *[enc.quantise_grid(F.col(c), F.col(f"{c}_origin"), F.col(f"{c}_span")).alias(c) for c in ("tx", "ty", "tz")],
    )


def align_splats(splats: DataFrame, ups: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Rotate positions and orientations so that each scene's ``up`` becomes +Y.

    ``ups``: scene, ux, uy, uz (any length). Scenes without an up direction keep their frame.
    """
    up = g.vec("ux", "uy", "uz")
    size = g.length(up)
    unit = ups.withColumns(g.named(g.scaled(up, 1 / F.when(size > 0, size).otherwise(F.lit(1.0))), "ux", "uy", "uz"))
    m = g.rotation_to_y_up(g.vec("ux", "uy", "uz"))
    flat = unit.withColumns({f"_m{r}{c}": m[r][c] for r in range(3) for c in range(3)})
    rows = tuple(tuple(F.col(f"_m{r}{c}") for c in range(3)) for r in range(3))
    turns = flat.select(scene, *[f"_m{r}{c}" for r in range(3) for c in range(3)], *[
        v.alias(n) for v, n in zip(g.matrix_to_quat(rows), ("_tw", "_tx", "_ty", "_tz"), strict=True)
    ])
    joined = splats.join(small(turns), scene, "left")
    place, own = g.vec("x", "y", "z"), g.vec("qw", "qx", "qy", "qz")
    moved = g.apply(rows, place)
    turned = g.quat_multiply(g.vec("_tw", "_tx", "_ty", "_tz"), own)
    known = F.col("_tw").isNotNull()
    made = {n: F.when(known, v).otherwise(F.col(n)) for n, v in zip(("x", "y", "z"), moved, strict=True)}
    made |= {n: F.when(known, v).otherwise(F.col(n)) for n, v in zip(("qw", "qx", "qy", "qz"), turned, strict=True)}
    return joined.select(*[made[c].alias(c) if c in made else F.col(c) for c in splats.columns])


def _uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the row: the same on every run and retry."""
    word = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 13), 16, 10)
    return word.cast("double") / float(1 << 52)


def weighted_draws(population: DataFrame, wanted: DataFrame, scene: str, row_id: str, weight: str, seed: int) -> DataFrame:
    """One weighted pick with replacement for every row of ``wanted`` (scene, slot).

    The running weight of the population and the draws are walked together in one ordered pass:
    a draw takes the first row whose running weight passes it. Nothing is paired.
    """
    line = Timeline.measure(population, [scene], row_id)
    summed = line.running(population, {"_upto": ("sum", F.greatest(F.col(weight), F.lit(1e-12)))})
    totals = population.groupBy(scene).agg(F.sum(F.greatest(F.col(weight), F.lit(1e-12))).alias("_total"))
    draws = wanted.join(small(totals), scene).select(
        scene, F.col("slot"), (_uniform(seed, F.col(scene), F.col("slot")) * F.col("_total")).alias("_upto"), F.lit(0).alias("_kind")
    )
    rows = summed.select(
        scene, F.col(row_id).alias("_pick"), "_upto", F.lit(1).alias("_kind"), (-F.col(row_id)).alias("_back")
    )
    both = draws.unionByName(rows, allowMissingColumns=True)
    walk = Timeline.measure(both, [scene], "_upto", ["_kind", "_back"]).reversed()
    # walking down from the top, the last population row seen is the first one above the draw;
    # of rows too light to move the sum, the one before them is seen last
    found = walk.running(both, {"_got": ("last", F.col("_pick"))})
    last = population.groupBy(scene).agg(F.max(row_id).alias("_last"))
    return (
        found.filter(F.col("_kind") == 0)
        .join(small(last), scene)
        .select(scene, "slot", F.coalesce("_got", "_last").alias("parent"))
    )


def split_opacity(opacity: Column) -> Column:
    """Opacity of each of two copies that together look like the original."""
    halved = 1.0 - F.sqrt(F.greatest(1.0 - opacity, F.lit(1e-8)))
    return enc.clip(halved, 1e-4, 1 - 1e-4)


def _hand_over(rows: DataFrame, picks: DataFrame, scene: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the picked ones' opacity split, one copy of a picked row per slot)."""
    taken = picks.select(scene, F.col("parent").alias(row_id)).distinct().withColumn("_split", F.lit(True))
    base = rows.join(taken, [scene, row_id], "left").withColumn(
        "opacity", F.when(F.col("_split"), split_opacity(F.col("opacity"))).otherwise(F.col("opacity"))
    )
    copies = (
        picks.select(scene, "slot", F.col("parent").alias("_from"))
        .join(rows.withColumnRenamed(row_id, "_from"), [scene, "_from"])
        .withColumn("opacity", split_opacity(F.col("opacity")))
    )
    return base.drop("_split"), copies.drop("_from")


def resample_by_weight(
    splats: DataFrame, cap: int, seed: int = 0, scene: str = "scene_id", row_id: str = "gid", growth: float = GROWTH
) -> DataFrame:
    """Overwrite dead splats with weighted survivors, then grow towards ``cap``.

    Adds ``parent`` (the row a splat descends from, itself for survivors) and ``grown``. New rows
    get ids after the largest one. A picked row and its copies share the split opacity.
    """
    rows = splats.withColumn("parent", F.col(row_id))
    alive = rows.filter(F.col("opacity") >= DEAD_OPACITY)
    dead = rows.filter(F.col("opacity") < DEAD_OPACITY)
    picks = settle(
        weighted_draws(alive, dead.select(scene, F.col(row_id).alias("slot")), scene, row_id, "opacity", seed)
    )
    kept, copies = _hand_over(alive, picks, scene, row_id)
    # scenes without a survivor keep their dead rows
    lost = dead.join(alive.select(scene).distinct(), scene, "left_anti")
    relocated = settle(kept.unionByName(copies.withColumnRenamed("slot", row_id)).unionByName(lost))

    sizes = relocated.groupBy(scene).agg(F.count(F.lit(1)).alias("_n"), F.max(row_id).alias("_top"))
    grow = F.least(F.greatest(F.lit(cap) - F.col("_n"), F.lit(0)), F.floor(F.col("_n") * growth))
    sizes = sizes.withColumn("_grow", grow)
    # the first rows of a scene lend their numbers to the new slots
    numbered = Timeline.measure(relocated, [scene], row_id).number(relocated.select(scene, row_id), "slot")
    slots = numbered.join(small(sizes), scene).filter(F.col("slot") <= F.col("_grow")).select(scene, "slot")
    drawn = settle(weighted_draws(relocated, slots, scene, row_id, "opacity", seed + 1))
    base, children = _hand_over(relocated, drawn, scene, row_id)
    born = children.join(small(sizes.select(scene, "_top")), scene).withColumn(row_id, F.col("_top") + F.col("slot"))
    return base.withColumn("grown", F.lit(False)).unionByName(
        born.drop("slot", "_top").withColumn("grown", F.lit(True))
    )


def _farthest(top: int):
    """One row per block: its first ``top`` points by distance to the seeds so far, and where the rest begins."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids = batch["ids"][i].values.to_numpy()
                xyz = np.stack([batch[c][i].values.to_numpy() for c in ("x", "y", "z")])
                seeds = np.stack([batch[f"seed_{c}"][i].values.to_numpy() for c in ("x", "y", "z")])
                near = np.full(len(ids), np.inf)
                for seed in seeds.T:
                    near = np.minimum(near, _away(xyz, seed))
                order = np.lexsort((ids, -near))[: top + 1]
                sent, rest = order[:top], order[top:]
                made = {"scene": [batch["scene"][i].as_py()], "taken": [seeds.shape[1]], "most": [batch["most"][i].as_py()]}
                made |= {"ids": [ids[sent]], "near": [near[sent]]} | {c: [xyz[k][sent]] for k, c in enumerate("xyz")}
                made |= {"rest_near": [float(near[rest][0]) if len(rest) else None], "rest_id": [int(ids[rest][0]) if len(rest) else None]}
                columns = [pa.array(made["scene"], batch.schema.field("scene").type), *[pa.array(made[c], kind) for c, kind in _SENT]]
                yield pa.RecordBatch.from_arrays(columns, ["scene", *[c for c, _ in _SENT]])

    return walk


_SENT = [
    ("taken", pa.int32()), ("most", pa.int64()), ("ids", pa.list_(pa.int64())), ("near", pa.list_(pa.float64())), ("x", pa.list_(pa.float64())),
    ("y", pa.list_(pa.float64())), ("z", pa.list_(pa.float64())), ("rest_near", pa.float64()), ("rest_id", pa.int64()),
]


def _away(xyz: np.ndarray, seed: np.ndarray) -> np.ndarray:
    x, y, z = (xyz[k] - seed[k] for k in range(3))
    return x * x + y * y + z * z


def _picked(blocks: pd.DataFrame) -> pd.DataFrame:
    """Further seeds of one scene, as long as the best point sent is before all that blocks kept back.

    Distances only shrink as seeds are added, so a point that was kept back stays behind where its block's rest began.
    """
    ids, near = np.concatenate(blocks["ids"].tolist()), np.concatenate(blocks["near"].tolist())
    xyz = np.stack([np.concatenate(blocks[c].tolist()) for c in ("x", "y", "z")])
    back = blocks.dropna(subset=["rest_near"])
    limit = max(zip(back["rest_near"], -back["rest_id"]), default=None)
    node, out = int(blocks["taken"].iloc[0]), []
    while node < blocks["most"].iloc[0]:
        best = np.flatnonzero(near == near.max())
        best = best[ids[best].argmin()]
        if limit is not None and (near[best], -ids[best]) <= limit:
            break
        out.append((blocks["scene"].iloc[0], node, ids[best], *xyz[:, best]))
        near = np.minimum(near, _away(xyz, xyz[:, best]))
        node += 1
    return pd.DataFrame(out, columns=["scene", "node", "id", "x", "y", "z"])


def farthest_points(
    points: DataFrame,
    count: int = 256,
    scene: str = "scene_id",
    row_id: str = "gid",
    start: str = "centroid",
    least: int = 8,
    block_points: int = 1 << 16,
    top: int = 1 << 12,
) -> DataFrame:
    """Farthest-point seeds of all scenes at once, in picking order; ties go to the lower id, ids are whole numbers.

    Points lie in blocks. A pass takes from every block its ``top`` farthest points and the distance at which the rest
    begins, and picks seed after seed among them for as long as the farthest is beyond all the rests: then it is the
    farthest of all, without looking at the others. The next pass measures anew from all seeds. So a pass gives
    many seeds and sends ``top`` points of each block, never the block. Points without a place are left out.
    """
    spark, xyz = points.sparkSession, ("x", "y", "z")
    kind, number = dict(points.dtypes)[scene], dict(points.dtypes)[row_id]
    whole = points.select(F.col(scene).alias("scene"), F.col(row_id).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in xyz])
    whole = whole.dropna(subset=list(xyz))
    sizes = whole.groupBy("scene").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in xyz]).filter(F.col("n") >= least)
    known = whole.join(small(sizes), "scene")
    origin = [F.col(f"m{c}") if start == "centroid" else F.lit(0.0) for c in xyz]
    x, y, z = ((F.col(c) - o) * (F.col(c) - o) for c, o in zip(xyz, origin, strict=True))
    first = known.groupBy("scene").agg(F.max(F.struct((x + y + z).alias("far"), (-F.col("id")).alias("order"), *xyz)).alias("p"))
    seeds = settle(first.select("scene", F.lit(0).alias("node"), (-F.col("p.order")).alias("id"), *[F.col(f"p.{c}").alias(c) for c in xyz]))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block_points))
    lists = F.collect_list(F.struct("id", *xyz))
    blocks = known.groupBy("scene", part.alias("part"), F.least("n", F.lit(count)).alias("most")).agg(lists.alias("r"))
    blocks = settle(blocks.select("scene", "most", F.col("r.id").alias("ids"), *[F.col(f"r.{c}").alias(c) for c in xyz]))
    sent = f"scene {kind}, taken int, most bigint, ids array<bigint>, near array<double>, x array<double>, y array<double>, z array<double>, rest_near double, rest_id bigint"
    while True:
        places = F.array_sort(F.collect_list(F.struct("node", *xyz)))
        so_far = seeds.groupBy("scene").agg(places.alias("s")).select("scene", *[F.col(f"s.{c}").alias(f"seed_{c}") for c in xyz])
        open_ = blocks.join(small(so_far), "scene").filter(F.size("seed_x") < F.col("most"))
        more = open_.mapInArrow(_farthest(top), sent).groupBy("scene").applyInPandas(_picked, f"scene {kind}, node int, id bigint, x double, y double, z double")
        more = settle(more)
        if more.isEmpty():
            break
        seeds = settle(seeds.unionByName(more))
    return seeds.select(F.col("scene").alias(scene), "node", F.col("id").cast(number).alias(row_id), *xyz)
