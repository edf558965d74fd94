"""Splat, neighbour, scaffold and trajectory operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushlight.functions import encoding as enc
from rushlight.functions import geometry as g
from rushlight.operators import neighbours, skinning, splats
from rushlight.plans.timeline import Timeline
from rushlight.queries.registry import query
from rushlight.queries.views import EVENTS, events, rounded, vectors, vectors_sql
from rushlight.session import table

ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
ITEMS = ", ".join(ITEM)


def items(spark, folder):
    return table(spark, folder, "lineitem")


# -- filters and decoding ---------------------------------------------------------------
@query("flt1_visible", f"SELECT {ITEMS}, l_discount AS opacity FROM lineitem WHERE l_discount >= 0.02")
def visible(spark, folder):
    return splats.visible(items(spark, folder).select(*ITEM, F.col("l_discount").alias("opacity")))


ALPHA = "CAST(round_even(l_discount * 255, 0) AS INT)"


@query("flt1_visible_alpha", f"SELECT {ITEMS}, {ALPHA} AS a FROM lineitem WHERE {ALPHA} >= 5")
def visible_alpha(spark, folder):
    rows = items(spark, folder).select(*ITEM, F.rint(F.col("l_discount") * 255).cast("int").alias("a"))
    return splats.visible_alpha(rows)


@query(
    "flt1_pruned_counts",
    f"""SELECT l_suppkey AS scene_id, count(CASE WHEN {ALPHA} >= 5 THEN 1 END) AS kept, count(CASE WHEN {ALPHA} < 5 THEN 1 END) AS pruned,
      count(CASE WHEN {ALPHA} >= 5 THEN 1 END) = 0 AS empty FROM lineitem GROUP BY 1""",
)
def pruned_counts(spark, folder):
    rows = items(spark, folder).select(F.col("l_suppkey").alias("scene_id"), F.rint(F.col("l_discount") * 255).cast("int").alias("a"))
    return splats.pruned_counts(rows)


RAW = {n: i + 1 for i, n in enumerate("rot_0 rot_1 rot_2 rot_3 scale_0 scale_1 scale_2 opacity f_dc_0 f_dc_1 f_dc_2".split())}
SH = "CAST(0.28209479177387814 AS DOUBLE)"


def decode_sql(colour):
    return f"""WITH {vectors_sql(RAW)}, n AS (SELECT *, sqrt(rot_0 * rot_0 + rot_1 * rot_1 + rot_2 * rot_2 + rot_3 * rot_3) AS n FROM vectors_v)
    SELECT vec_id, round(1 / (1 + exp(-opacity)), 6) AS opacity, {", ".join(f"round(exp(scale_{i}), 6) AS s{a}" for i, a in enumerate("xyz"))},
      {", ".join(colour.format(dc=f"f_dc_{i}", sh=SH) + f" AS {a}" for i, a in enumerate("rgb"))},
      {", ".join(f"round(rot_{i} / n, 6) AS q{a}" for i, a in enumerate("wxyz"))} FROM n"""


@query("flt2_decode_splats", decode_sql("CAST(trunc(greatest(0, least(1, 0.5 + {sh} * {dc})) * 255) AS INT)"))
def decode(spark, folder):
    return rounded(splats.decode_splats(vectors(spark, folder, RAW)).drop("label"))


@query("flt2_decode_splats_rounded", decode_sql("CAST(trunc(greatest(0, least(255, (0.5 + {sh} * {dc}) * 255 + 0.5))) AS INT)"))
def decode_rounded(spark, folder):
    return rounded(splats.decode_splats(vectors(spark, folder, RAW), rounded_colour=True).drop("label"))


@query(
    "flt8_prune_skin",
    """WITH s AS (SELECT vec_id, [abs(CAST(embedding[1] AS DOUBLE)), abs(CAST(embedding[2] AS DOUBLE)), abs(CAST(embedding[3] AS DOUBLE)), abs(CAST(embedding[4] AS DOUBLE))] AS w FROM embeddings),
    e AS (SELECT vec_id, unnest(w) AS w, unnest([10, 20, 30, 40]) AS idx FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, idx) AS pos FROM e),
    k AS (SELECT *, sum(w) OVER (PARTITION BY vec_id) AS total FROM r WHERE pos <= 2)
    SELECT vec_id, CAST(pos - 1 AS INT) AS pos, idx, round(w / total, 6) AS w FROM k""",
)
def prune_skin(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        "vec_id",
        F.array(*[F.lit(v) for v in (10, 20, 30, 40)]).alias("idx"),
        F.transform(F.slice("embedding", 1, 4), lambda v: F.abs(v.cast("double"))).alias("w"),
    )
    kept = skinning.prune_skin(rows, 2)
    each = kept.select("vec_id", F.posexplode(F.arrays_zip("idx", "w")).alias("pos", "e"))
    return rounded(each.select("vec_id", "pos", "e.idx", "e.w"))


# -- order and truncation ---------------------------------------------------------------
IMPORTANCE = "greatest(l_quantity, 1e-12) * greatest(l_extendedprice, 1e-12) * greatest(1 + l_tax, 1e-12) * (1 + l_discount)"
ORDERED = f"""ordered_v AS (SELECT {ITEMS}, l_suppkey AS scene_id, l_linestatus = 'F' AS dynamic,
    row_number() OVER (PARTITION BY l_suppkey, l_linestatus = 'F' ORDER BY {IMPORTANCE} DESC, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey) AS rank,
    count(*) OVER (PARTITION BY l_suppkey) AS n, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey) AS d FROM lineitem)"""


def ordered(spark, folder):
    value = splats.importance(F.col("l_quantity"), F.col("l_extendedprice"), 1 + F.col("l_tax"), 1 + F.col("l_discount"))
    rows = items(spark, folder).select(
        *ITEM, F.col("l_suppkey").alias("scene_id"), (F.col("l_linestatus") == "F").alias("dynamic"), value.alias("importance"),
        (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("gid"),
    )
    return splats.order_by_importance(rows, "importance", "scene_id", "dynamic", "gid")


@query(
    "top5_order_by_importance",
    f"WITH {ORDERED} SELECT {ITEMS}, scene_id, dynamic, CAST(rank - 1 + CASE WHEN dynamic THEN 0 ELSE d END AS BIGINT) AS position FROM ordered_v",
)
def order_by_importance(spark, folder):
    return ordered(spark, folder).drop("gid", "importance", "rank")


@query(
    "top6_truncate",
    f"""WITH {ORDERED}, q AS (SELECT *, least(d, greatest(1, CAST(round_even(d * (CAST(100 AS DOUBLE) / n), 0) AS BIGINT))) AS kd FROM ordered_v)
    SELECT {ITEMS}, scene_id, dynamic, rank FROM q WHERE n <= 100 OR rank <= CASE WHEN dynamic THEN kd ELSE least(greatest(0, 100 - kd), n - d) END""",
)
def truncate(spark, folder):
    return splats.truncate(ordered(spark, folder), 100, "scene_id", "dynamic").drop("gid", "importance", "position")


# -- bounds and summaries ---------------------------------------------------------------
AXES = ["l_quantity", "l_extendedprice", "l_discount"]


def scened(spark, folder):
    return items(spark, folder).withColumnRenamed("l_suppkey", "scene_id")


@query(
    "agg20_grid_bounds",
    f"""SELECT l_suppkey AS scene_id, {", ".join(f"round(min({c}), 6) AS {c}_origin, round(greatest(max({c}) - min({c}), 1e-9), 6) AS {c}_span" for c in AXES)}
    FROM lineitem GROUP BY 1""",
)
def grid_bounds(spark, folder):
    return rounded(splats.grid_bounds(scened(spark, folder), ["scene_id"], AXES))


@query(
    "agg20_aabb",
    f"""SELECT l_suppkey AS scene_id, {", ".join(f"round(min({c}) - greatest(max({c}) - min({c}), 1e-6) * 0.1, 6) AS {c}_lo, round(max({c}) + greatest(max({c}) - min({c}), 1e-6) * 0.1, 6) AS {c}_hi" for c in AXES)}
    FROM lineitem GROUP BY 1""",
)
def aabb(spark, folder):
    return rounded(splats.aabb(scened(spark, folder), ["scene_id"], AXES))


@query(
    "fn8_quantise_grid",
    f"""WITH b AS (SELECT l_suppkey, {", ".join(f"min({c}) AS o{i}, greatest(max({c}) - min({c}), 1e-9) AS s{i}" for i, c in enumerate(AXES))} FROM lineitem GROUP BY 1)
    SELECT {ITEMS}, {", ".join(f"CAST(round_even(greatest(0, least(1, ({c} - o{i}) / s{i})) * 65535, 0) AS INT) AS {c}_code" for i, c in enumerate(AXES))}
    FROM lineitem JOIN b USING (l_suppkey)""",
)
def quantise_grid(spark, folder):
    made = splats.quantise_positions(scened(spark, folder), ["scene_id"], AXES)
    return made.select(*ITEM, *[f"{c}_code" for c in AXES])


@query(
    "fn8_dequantise_grid",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(5.0 + l_quantity * 100 / 65535.0 * 40.0, 6) AS value, round(40.0 / 65535.0, 9) AS step FROM lineitem""",
)
def dequantise_grid(spark, folder):
    value = enc.dequantise_grid(F.col("l_quantity") * 100, F.lit(5.0), F.lit(40.0))
    rows = items(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", F.round(value, 6).alias("value"))
    return rows.withColumn("step", F.round(enc.grid_step(F.lit(40.0)), 9))


@query(
    "agg18_scene_framing",
    """WITH e AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
    p AS (SELECT label, quantile_cont(x, 0.02) AS xl, quantile_cont(x, 0.98) AS xh, quantile_cont(y, 0.02) AS yl, quantile_cont(y, 0.98) AS yh,
      quantile_cont(z, 0.02) AS zl, quantile_cont(z, 0.98) AS zh FROM e GROUP BY 1)
    SELECT label, round((xl + xh) / 2, 6) AS x_centre, round((yl + yh) / 2, 6) AS y_centre, round((zl + zh) / 2, 6) AS z_centre,
      round(sqrt(pow(xh - xl, 2) + pow(yh - yl, 2) + pow(zh - zl, 2)) / 2, 6) AS radius FROM p""",
)
def scene_framing(spark, folder):
    return rounded(splats.scene_framing(vectors(spark, folder, {"x": 1, "y": 2, "z": 3}), ["label"], ["x", "y", "z"]))


@query(
    "agg19_splat_summary",
    """WITH s AS (SELECT l_suppkey, unnest([l_quantity, l_tax * 100, l_discount * 100]) AS s FROM lineitem), m AS (SELECT l_suppkey, quantile_cont(s, 0.5) AS m FROM s GROUP BY 1)
    SELECT l.l_suppkey AS scene_id, count(*) AS n, round(avg(l_discount), 6) AS mean_opacity, round(any_value(m), 6) AS median_scale
    FROM lineitem l JOIN m ON l.l_suppkey = m.l_suppkey GROUP BY 1""",
)
def splat_summary(spark, folder):
    rows = scened(spark, folder).withColumns({"t": F.col("l_tax") * 100, "d": F.col("l_discount") * 100})
    return rounded(splats.splat_summary(rows, ["scene_id"], ["l_quantity", "t", "d"], "l_discount"))


@query(
    "agg19_scene_scale",
    """WITH c AS (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS x, avg(CAST(embedding[2] AS DOUBLE)) AS y, avg(CAST(embedding[3] AS DOUBLE)) AS z FROM embeddings GROUP BY 1)
    SELECT label, round(quantile_cont(sqrt(pow(CAST(embedding[1] AS DOUBLE) - x, 2) + pow(CAST(embedding[2] AS DOUBLE) - y, 2) + pow(CAST(embedding[3] AS DOUBLE) - z, 2)), 0.5), 6) AS scene_scale
    FROM embeddings JOIN c USING (label) GROUP BY 1""",
)
def scene_scale(spark, folder):
    return rounded(splats.scene_scale(vectors(spark, folder, {"x": 1, "y": 2, "z": 3}), ["label"], ["x", "y", "z"]))


@query(
    "agg31_probe_grid_resolution",
    """WITH b AS (SELECT l_suppkey, greatest(max(l_quantity) - min(l_quantity), max(l_extendedprice) - min(l_extendedprice)) / 65535.0 AS step,
        quantile_cont(l_tax, 0.5) AS m FROM lineitem GROUP BY 1)
    SELECT l_suppkey AS scene_id, round(step, 6) AS step, round(m, 6) AS median_scale, m > 0 AND step >= m / 4 AS refused FROM b""",
)
def probe_grid(spark, folder):
    made = splats.probe_grid_resolution(scened(spark, folder), ["scene_id"], ["l_quantity", "l_extendedprice"], ["l_tax"], "l_discount")
    return rounded(made)


# -- packing ----------------------------------------------------------------------------
SPLAT = {n: i + 1 for i, n in enumerate("x y z lx ly lz qw qx qy qz".split())}


def embedded_splats(spark, folder):
    rows = vectors(spark, folder, SPLAT).withColumns({f"s{a}": F.exp(f"l{a}") for a in "xyz"})
    return rows.select("vec_id", F.col("label").alias("scene_id"), "x", "y", "z", "sx", "sy", "sz", "qw", "qx", "qy", "qz")


def code16(value, lo, span):
    return f"CAST(round_even(greatest(0, least(1, ({value} - {lo}) / greatest({span}, 1e-9))) * 65535, 0) AS BIGINT)"


@query(
    "fn12_pack_geometry_words",
    f"""WITH {vectors_sql(SPLAT)}, v AS (SELECT vec_id, label, x, y, z, ln(greatest(exp(lx), 1e-12)) AS lx, ln(greatest(exp(ly), 1e-12)) AS ly, ln(greatest(exp(lz), 1e-12)) AS lz FROM vectors_v),
    b AS (SELECT label, min(x) AS x0, max(x) - min(x) AS xs, min(y) AS y0, max(y) - min(y) AS ys, min(z) AS z0, max(z) - min(z) AS zs,
      min(least(lx, ly, lz)) AS l0, max(greatest(lx, ly, lz)) - min(least(lx, ly, lz)) AS ls FROM v GROUP BY 1)
    SELECT vec_id, label AS scene_id, {code16("x", "x0", "xs")} + {code16("y", "y0", "ys")} * 65536 AS word0,
      {code16("z", "z0", "zs")} + {code16("lx", "l0", "ls")} * 65536 AS word1, {code16("ly", "l0", "ls")} + {code16("lz", "l0", "ls")} * 65536 AS word2
    FROM v JOIN b USING (label)""",
)
def pack_geometry(spark, folder):
    return splats.pack_geometry(embedded_splats(spark, folder)).drop("word3")


TRAJ = {n: i + 1 for i, n in enumerate("qw qx qy qz tx ty tz".split())}
# every label is a node, its vectors in id order are the frames
FRAMES = f"""{vectors_sql(TRAJ, "tv")}, traj_v AS (SELECT label AS node, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id, tx, ty, tz,
    qw / n AS qw, qx / n AS qx, qy / n AS qy, qz / n AS qz FROM (SELECT *, sqrt(qw * qw + qx * qx + qy * qy + qz * qz) AS n FROM tv))"""


def trajectory(spark, folder):
    rows = vectors(spark, folder, TRAJ)
    line = Timeline.measure(rows, ["label"], "vec_id")
    rows = line.number(rows, "_rn").withColumns(g.named(g.quat_normalise(g.vec("qw", "qx", "qy", "qz")), "qw", "qx", "qy", "qz"))
    made = rows.select(
        F.lit(1).alias("scene_id"), (F.col("_rn") - 1).alias("frame"), F.col("label").alias("node"), "vec_id", *TRAJ
    )
    return made, Timeline(("scene_id", "node"), "frame", splits=(), block_rows=line.block_rows) if not line.splits else Timeline.measure(made, ["scene_id", "node"], "frame")


SIGNED = """dot_v AS (SELECT *, qw * lag(qw) OVER w + qx * lag(qx) OVER w + qy * lag(qy) OVER w + qz * lag(qz) OVER w AS dot FROM traj_v
    WINDOW w AS (PARTITION BY node ORDER BY frame)),
  signed_v AS (SELECT *, CASE WHEN sum(CASE WHEN dot < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY frame) % 2 = 1 THEN -1 ELSE 1 END AS s FROM dot_v)"""


@query(
    "win15_hemisphere_continuous",
    f"WITH {FRAMES}, {SIGNED} SELECT vec_id, {', '.join(f'round(s * q{k}, 6) AS q{k}' for k in 'wxyz')} FROM signed_v",
)
def hemisphere(spark, folder):
    traj, line = trajectory(spark, folder)
    return rounded(skinning.hemisphere_continuous(traj, line).select("vec_id", "qw", "qx", "qy", "qz"))


@query(
    "fn13_pack_trajectory_rows",
    f"""WITH {FRAMES}, {SIGNED}, b AS (SELECT min(tx) AS x0, greatest(max(tx) - min(tx), 1e-6) AS xs, min(ty) AS y0, greatest(max(ty) - min(ty), 1e-6) AS ys,
      min(tz) AS z0, greatest(max(tz) - min(tz), 1e-6) AS zs FROM traj_v)
    SELECT 1 AS scene_id, node, frame, {", ".join(f"CAST(greatest(-32767, least(32767, round_even(s * q{k} * 32767, 0))) AS INT) AS q{k}" for k in "wxyz")},
      {", ".join(f"CAST({code16('t' + k, k + '0', k + 's')} AS INT) AS t{k}" for k in "xyz")} FROM signed_v, b""",
)
def pack_trajectory(spark, folder):
    traj, line = trajectory(spark, folder)
    return splats.pack_trajectory_rows(traj, line)


@query(
    "win16_trajectory_smoothness",
    f"""WITH {FRAMES}, f AS (SELECT node, qw AS fw, qx AS fx, qy AS fy, qz AS fz FROM traj_v WHERE frame = 0),
    a AS (SELECT t.*, CASE WHEN qw * fw + qx * fx + qy * fy + qz * fz < 0 THEN -1 ELSE 1 END AS s FROM traj_v t JOIN f USING (node)),
    d AS (SELECT {", ".join(f"s * q{k} - 2 * lag(s * q{k}) OVER w + lag(s * q{k}, 2) OVER w AS q{k}" for k in "wxyz")},
      {", ".join(f"t{k} - 2 * lag(t{k}) OVER w + lag(t{k}, 2) OVER w AS t{k}" for k in "xyz")} FROM a WINDOW w AS (PARTITION BY node ORDER BY frame))
    SELECT 1 AS scene_id, round(avg(qw * qw + qx * qx + qy * qy + qz * qz) + avg(tx * tx + ty * ty + tz * tz), 6) AS smoothness FROM d""",
)
def smoothness(spark, folder):
    traj, line = trajectory(spark, folder)
    return rounded(skinning.trajectory_smoothness(traj, line))


@query(
    "win17_interpolate_nodes",
    f"""WITH {FRAMES}, w AS (SELECT DISTINCT k / 3 AS tau FROM (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events)),
    c AS (SELECT tau, least(tau, m) AS place, CAST(floor(least(tau, m)) AS BIGINT) AS lo, least(CAST(floor(least(tau, m)) AS BIGINT) + 1, m) AS hi FROM w, (SELECT max(frame) AS m FROM traj_v)),
    j AS (SELECT tau, a.node, place - lo AS u, {", ".join(f"a.{n} AS a{n}, b.{n} AS b{n}" for n in TRAJ)} FROM c JOIN traj_v a ON a.frame = lo JOIN traj_v b ON b.frame = hi AND b.node = a.node),
    s AS (SELECT *, CASE WHEN aqw * bqw + aqx * bqx + aqy * bqy + aqz * bqz < 0 THEN -1 ELSE 1 END AS s FROM j),
    q AS (SELECT tau, node, {", ".join(f"aq{k} + (s * bq{k} - aq{k}) * u AS q{k}" for k in "wxyz")}, {", ".join(f"at{k} + (bt{k} - at{k}) * u AS t{k}" for k in "xyz")} FROM s)
    SELECT 1 AS scene_id, round(tau, 6) AS tau, node, {", ".join(f"round(q{k} / sqrt(qw * qw + qx * qx + qy * qy + qz * qz), 6) AS q{k}" for k in "wxyz")},
      {", ".join(f"round(t{k}, 6) AS t{k}" for k in "xyz")} FROM q""",
)
def interpolate_nodes(spark, folder):
    traj, _ = trajectory(spark, folder)
    wanted = events(spark, folder).select(F.lit(1).alias("scene_id"), (F.col("k") / 3).alias("tau")).distinct()
    return rounded(skinning.interpolate_nodes(traj, wanted))


KEY_TIME = "frame + (frame * frame % 7) / CAST(10 AS DOUBLE)"


@query(
    "win17_interpolate_by_time",
    f"""WITH {FRAMES}, w AS (SELECT DISTINCT k / 3 AS t FROM (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events)),
    e AS (SELECT DISTINCT frame, {KEY_TIME} AS kt FROM traj_v),
    b AS (SELECT t, max(CASE WHEN kt <= t THEN frame END) AS below, min(CASE WHEN kt >= t THEN frame END) AS above FROM w, e GROUP BY t),
    c AS (SELECT t, l.frame AS lo, h.frame AS hi, CASE WHEN h.kt > l.kt THEN (t - l.kt) / (h.kt - l.kt) ELSE 0.0 END AS u
      FROM b JOIN e l ON l.frame = coalesce(below, above) JOIN e h ON h.frame = coalesce(above, below)),
    j AS (SELECT t, a.node, u, {", ".join(f"a.{n} AS a{n}, b.{n} AS b{n}" for n in TRAJ)} FROM c JOIN traj_v a ON a.frame = lo JOIN traj_v b ON b.frame = hi AND b.node = a.node),
    s AS (SELECT *, CASE WHEN aqw * bqw + aqx * bqx + aqy * bqy + aqz * bqz < 0 THEN -1 ELSE 1 END AS s FROM j),
    q AS (SELECT t, node, {", ".join(f"aq{k} + (s * bq{k} - aq{k}) * u AS q{k}" for k in "wxyz")}, {", ".join(f"at{k} + (bt{k} - at{k}) * u AS t{k}" for k in "xyz")} FROM s)
    SELECT 1 AS scene_id, round(t, 6) AS t_sec, node, {", ".join(f"round(q{k} / sqrt(qw * qw + qx * qx + qy * qy + qz * qz), 6) AS q{k}" for k in "wxyz")},
      {", ".join(f"round(t{k}, 6) AS t{k}" for k in "xyz")} FROM q""",
)
def interpolate_by_time(spark, folder):
    traj, _ = trajectory(spark, folder)
    times = traj.select("scene_id", "frame").distinct().withColumn("t_sec", F.col("frame") + (F.col("frame") * F.col("frame") % 7) / F.lit(10.0))
    wanted = events(spark, folder).select(F.lit(1).alias("scene_id"), (F.col("k") / 3).alias("t_sec")).distinct()
    return rounded(skinning.interpolate_nodes_at(traj, times, wanted))


def rotate_sql(q, p):
    """Three expressions: ``p`` turned by the unit quaternion with prefix ``q``."""
    w, x, y, z = (f"{q}{k}" for k in "wxyz")
    m = [
        f"(1 - 2 * ({y} * {y} + {z} * {z}))", f"(2 * ({x} * {y} - {w} * {z}))", f"(2 * ({x} * {z} + {w} * {y}))",
        f"(2 * ({x} * {y} + {w} * {z}))", f"(1 - 2 * ({x} * {x} + {z} * {z}))", f"(2 * ({y} * {z} - {w} * {x}))",
        f"(2 * ({x} * {z} - {w} * {y}))", f"(2 * ({y} * {z} + {w} * {x}))", f"(1 - 2 * ({x} * {x} + {y} * {y}))",
    ]
    return ["(" + " + ".join(f"{m[3 * r + i]} * ({p[i]})" for i in range(3)) + ")" for r in range(3)]


NODES = f"""{vectors_sql({"x": 1, "y": 2, "z": 3}, "nv")}, nodes_v AS (SELECT label AS node, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM nv GROUP BY 1)"""


def nodes(spark, folder):
    rows = vectors(spark, folder, {"x": 1, "y": 2, "z": 3})
    return rows.groupBy(F.lit(1).alias("scene_id"), F.col("label").alias("node")).agg(*[F.avg(c).alias(c) for c in "xyz"])


F_Q = {"w": "uw * vw + ux * vx + uy * vy + uz * vz", "x": "-uw * vx + ux * vw - uy * vz + uz * vy", "y": "-uw * vy + ux * vz + uy * vw - uz * vx", "z": "-uw * vz - ux * vy + uy * vx + uz * vw"}


@query(
    "win19_reanchor_trajectory",
    f"""WITH {FRAMES}, {NODES}, a AS (SELECT node, qw AS vw, qx AS vx, qy AS vy, qz AS vz, tx AS ax, ty AS ay, tz AS az FROM traj_v WHERE frame = 0),
    j AS (SELECT t.node, frame, qw AS uw, qx AS ux, qy AS uy, qz AS uz, tx, ty, tz, vw, vx, vy, vz, ax, ay, az, n.x AS nx, n.y AS ny, n.z AS nz
      FROM traj_v t JOIN a USING (node) JOIN nodes_v n USING (node)),
    c AS (SELECT *, {", ".join(f"n{k} + t{k} - {r} AS c{k}" for k, r in zip("xyz", rotate_sql("u", ("nx", "ny", "nz"))))},
      {", ".join(f"n{k} + a{k} - {r} AS d{k}" for k, r in zip("xyz", rotate_sql("v", ("nx", "ny", "nz"))))}, {", ".join(f"{e} AS f{k}" for k, e in F_Q.items())} FROM j),
    r AS (SELECT *, {", ".join(f"c{k} - {r} AS m{k}" for k, r in zip("xyz", rotate_sql("f", ("dx", "dy", "dz"))))} FROM c)
    SELECT 1 AS scene_id, frame, node, {", ".join(f"round(f{k}, 6) AS q{k}" for k in "wxyz")},
      {", ".join(f"round(m{k} + {r} - n{k}, 6) AS t{k}" for k, r in zip("xyz", rotate_sql("f", ("nx", "ny", "nz"))))} FROM r""",
)
def reanchor(spark, folder):
    traj, _ = trajectory(spark, folder)
    made = skinning.reanchor_trajectory(traj, nodes(spark, folder), 0)
    numbers = ["qw", "qx", "qy", "qz", "tx", "ty", "tz"]
    # adding zero turns a rounded -0.0 into 0.0
    return rounded(made).withColumns({n: F.col(n) + F.lit(0.0) for n in numbers})


# -- neighbours and binding -------------------------------------------------------------
XYZ = vectors_sql({"x": 1, "y": 2, "z": 3})


@query(
    "jn9_knn_mean_sq_dist",
    f"""WITH {XYZ}, d AS (SELECT a.label, a.vec_id, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) AS d FROM vectors_v a JOIN vectors_v b ON a.label = b.label AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS rk FROM d)
    SELECT label AS scene_id, vec_id AS gid, round(greatest(avg(d), 1e-14), 9) AS mean_sq_dist FROM r WHERE rk <= 3 GROUP BY ALL""",
)
def knn_by_scene(spark, folder):
    rows = vectors(spark, folder, {"x": 1, "y": 2, "z": 3}).select(F.col("label").alias("scene_id"), F.col("vec_id").alias("gid"), "x", "y", "z")
    return rounded(neighbours.knn_mean_sq_dist(rows), 9)


@query(
    "fn17_init_log_scales",
    f"""WITH {XYZ}, d AS (SELECT a.vec_id, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) AS d FROM vectors_v a JOIN vectors_v b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS rk FROM d),
    m AS (SELECT vec_id, greatest(avg(d), 1e-14) AS m FROM r WHERE rk <= 3 GROUP BY 1)
    SELECT vec_id AS gid, round(ln(least(sqrt(m), 0.05)), 6) AS log_scale, round((n_dc - 0.5) / {SH}, 6) AS dc, round(ln(CAST(0.1 AS DOUBLE) / 0.9), 6) AS opacity
    FROM m JOIN (SELECT vec_id, abs(CAST(embedding[4] AS DOUBLE)) AS n_dc FROM embeddings) USING (vec_id)""",
)
def init_log_scales(spark, folder):
    rows = vectors(spark, folder, {"x": 1, "y": 2, "z": 3, "c": 4})
    whole = rows.select(F.lit(1).alias("scene_id"), F.col("vec_id").alias("gid"), "x", "y", "z")
    made = neighbours.init_log_scales(neighbours.knn_mean_sq_dist(whole, block_rows=128), max_scale=0.05)
    colours = rows.select(F.col("vec_id").alias("gid"), enc.encode_colour(F.abs("c")).alias("dc"))
    return rounded(made.select("gid", "log_scale").join(colours, "gid").withColumn("opacity", enc.logit(F.lit(0.1))))


NEAR = f"""{XYZ}, {NODES.replace(vectors_sql({"x": 1, "y": 2, "z": 3}, "nv"), vectors_sql({"x": 1, "y": 2, "z": 3}, "nv"))},
pair_v AS (SELECT v.vec_id, n.node, sqrt(pow(v.x - n.x, 2) + pow(v.y - n.y, 2) + pow(v.z - n.z, 2)) AS d FROM vectors_v v, nodes_v n),
near_v AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, node) AS rk FROM pair_v)"""


def points(spark, folder):
    return vectors(spark, folder, {"x": 1, "y": 2, "z": 3}).select(F.lit(1).alias("scene_id"), "vec_id", "x", "y", "z")


def unrolled(bound):
    each = bound.select("vec_id", F.posexplode(F.arrays_zip("idx", "w")).alias("pos", "e"))
    return rounded(each.select("vec_id", "pos", F.col("e.idx").alias("node"), F.col("e.w").alias("w")))


@query(
    "jn10_bind_to_nodes",
    f"""WITH {NEAR}, s AS (SELECT greatest(avg(d), 1e-6) AS s FROM near_v WHERE rk = 4),
    w AS (SELECT vec_id, node, rk, exp(-0.5 * pow(d / s, 2)) AS w FROM near_v, s WHERE rk <= 4)
    SELECT vec_id, CAST(rk - 1 AS INT) AS pos, node, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS w FROM w""",
)
def bind_to_nodes(spark, folder):
    return unrolled(skinning.bind_to_nodes(points(spark, folder), nodes(spark, folder)))


@query(
    "jn11_bind_inverse_distance",
    f"""WITH {NEAR}, w AS (SELECT vec_id, node, rk, 1 / (d + 0.001) AS w FROM near_v WHERE rk <= 3)
    SELECT vec_id, CAST(rk - 1 AS INT) AS pos, node, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS w FROM w""",
)
def bind_inverse(spark, folder):
    return unrolled(skinning.bind_inverse_distance(points(spark, folder), nodes(spark, folder), 3))


EDGES = f"""{NODES}, ep AS (SELECT a.node AS i, b.node AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM nodes_v a, nodes_v b),
er AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rk FROM ep),
edges_v AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM er WHERE rk <= 4 AND i <> j)"""


@query("jn12_graph_edges", f"WITH {EDGES} SELECT 1 AS scene_id, i, j FROM edges_v")
def graph_edges(spark, folder):
    return skinning.graph_edges(nodes(spark, folder), 3)


POSES = f"""{FRAMES}, {EDGES}, poses_v AS (SELECT frame, t.node, n.x AS rx, n.y AS ry, n.z AS rz, qw, qx, qy, qz, tx, ty, tz FROM traj_v t JOIN nodes_v n USING (node))"""


def poses(spark, folder):
    traj, _ = trajectory(spark, folder)
    rest = nodes(spark, folder).select("node", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"))
    return traj.drop("vec_id").join(rest, "node")


def whole_poses(spark, folder):
    """Every frame in which all nodes have a pose; a splat has no place where one of its nodes has none."""
    posed, n = poses(spark, folder), nodes(spark, folder).agg(F.count(F.lit(1)).alias("n"))
    known = posed.groupBy(F.col("frame").alias("f")).agg(F.count(F.lit(1)).alias("c"))
    complete = known.join(F.broadcast(n), F.col("c") == F.col("n"))  # one row
    return posed.join(complete, F.col("frame") == F.col("f"), "left_semi")


ARAP_I = rotate_sql("qi", ("ex", "ey", "ez"))
ARAP_J = rotate_sql("qj", ("ex", "ey", "ez"))


@query(
    "agg29_arap_energy",
    f"""WITH {POSES}, j AS (SELECT a.frame, {", ".join(f"b.r{k} - a.r{k} AS e{k}, b.r{k} + b.t{k} - a.r{k} - a.t{k} AS p{k}" for k in "xyz")},
      {", ".join(f"a.q{k} AS qi{k}, b.q{k} AS qj{k}" for k in "wxyz")} FROM edges_v e JOIN poses_v a ON a.node = e.i JOIN poses_v b ON b.node = e.j AND b.frame = a.frame)
    SELECT 1 AS scene_id, frame, round(0.5 * (avg({" + ".join(f"pow(p{k} - {r}, 2)" for k, r in zip("xyz", ARAP_I))}) + avg({" + ".join(f"pow(p{k} - {r}, 2)" for k, r in zip("xyz", ARAP_J))})), 6) AS energy
    FROM j GROUP BY frame""",
)
def arap(spark, folder):
    return rounded(skinning.arap_energy(skinning.graph_edges(nodes(spark, folder), 3), poses(spark, folder)))


SKIN = f"""{POSES}, {XYZ.replace("vectors_v", "pv")}, kp AS (SELECT v.vec_id, v.label, v.x, v.y, v.z, n.node, sqrt(pow(v.x - n.x, 2) + pow(v.y - n.y, 2) + pow(v.z - n.z, 2)) AS d FROM pv v, nodes_v n),
kr AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, node) AS rk FROM kp),
skin_v AS (SELECT *, (1 / (d + 0.001)) / sum(1 / (d + 0.001)) OVER (PARTITION BY vec_id) AS w FROM kr WHERE rk <= 3),
posed_v AS (SELECT s.*, {", ".join(f"p.{c}" for c in skinning.POSE)}, p.frame FROM skin_v s JOIN poses_v p ON p.node = s.node
  WHERE p.frame IN (SELECT frame FROM poses_v GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM nodes_v)))"""


def skinned(spark, folder):
    """Vectors bound to the label scaffold; label 0 stays static."""
    quats = vectors(spark, folder, {"qw": 4, "qx": 5, "qy": 6, "qz": 7}).withColumns(
        g.named(g.quat_normalise(g.vec("qw", "qx", "qy", "qz")), "qw", "qx", "qy", "qz")
    )
    bound = skinning.bind_inverse_distance(points(spark, folder), nodes(spark, folder), 3).join(quats, "vec_id")
    still = F.col("label") == 0
    return bound.withColumn("idx", F.when(~still, F.col("idx"))).withColumn("w", F.when(~still, F.col("w")))


@query(
    "jn13_skin_positions",
    f"""WITH {SKIN} SELECT vec_id, frame, {", ".join(f"round(CASE WHEN any_value(label) = 0 THEN any_value({k}) ELSE sum(w * ({r} + r{k} + t{k})) END, 6) AS p{k}" for k, r in zip("xyz", rotate_sql("q", ("x - rx", "y - ry", "z - rz"))))}
    FROM posed_v GROUP BY vec_id, frame""",
)
def skin_positions(spark, folder):
    made = skinning.skin_positions(skinned(spark, folder), whole_poses(spark, folder), keep=["vec_id"])
    return rounded(made.select("vec_id", "frame", "px", "py", "pz"))


OWN = vectors_sql({"ow": 4, "ox": 5, "oy": 6, "oz": 7}, "ov")


@query(
    "jn14_skin_orientation",
    f"""WITH {SKIN}, {OWN}, h AS (SELECT p.*, CASE WHEN qw * first_value(qw) OVER k + qx * first_value(qx) OVER k + qy * first_value(qy) OVER k + qz * first_value(qz) OVER k < 0 THEN -1 ELSE 1 END AS s
      FROM posed_v p WINDOW k AS (PARTITION BY vec_id, frame ORDER BY w DESC, node)),
    b AS (SELECT vec_id, frame, label, {", ".join(f"sum(w * s * q{k}) AS a{k}" for k in "wxyz")} FROM h GROUP BY ALL),
    u AS (SELECT b.vec_id, b.frame, b.label, {", ".join(f"a{k} / sqrt(aw * aw + ax * ax + ay * ay + az * az) AS a{k}" for k in "wxyz")},
      {", ".join(f"o{k} / sqrt(ow * ow + ox * ox + oy * oy + oz * oz) AS g{k}" for k in "wxyz")} FROM b JOIN ov USING (vec_id))
    SELECT vec_id, frame, round(CASE WHEN label = 0 THEN gw ELSE aw * gw - ax * gx - ay * gy - az * gz END, 6) AS ow,
      round(CASE WHEN label = 0 THEN gx ELSE aw * gx + ax * gw + ay * gz - az * gy END, 6) AS ox,
      round(CASE WHEN label = 0 THEN gy ELSE aw * gy - ax * gz + ay * gw + az * gx END, 6) AS oy,
      round(CASE WHEN label = 0 THEN gz ELSE aw * gz + ax * gy - ay * gx + az * gw END, 6) AS oz FROM u""",
)
def skin_orientation(spark, folder):
    made = skinning.skin_orientation(skinned(spark, folder), whole_poses(spark, folder), keep=["vec_id"])
    return rounded(made.select("vec_id", "frame", "ow", "ox", "oy", "oz"))


@query(
    "top8_depth_order",
    f"""WITH {SKIN}, d AS (SELECT vec_id, frame, CASE WHEN any_value(label) = 0 THEN any_value(0.36 * x + 0.48 * y + 0.8 * z)
        ELSE sum(w * ({" + ".join(f"{c} * ({r} + r{k} + t{k})" for c, k, r in zip((0.36, 0.48, 0.8), "xyz", rotate_sql("q", ("x - rx", "y - ry", "z - rz"))))})) END AS depth
      FROM posed_v GROUP BY vec_id, frame), b AS (SELECT frame, min(depth) AS lo, max(depth) AS hi FROM d GROUP BY 1)
    SELECT vec_id, frame, round(depth, 6) AS depth, CAST(floor((depth - lo) / (hi - lo) * 65535) AS INT) AS bucket FROM d JOIN b USING (frame)""",
)
def depth_order(spark, folder):
    view = (0.36, 0.48, 0.8)
    folded = skinning.fold_view_row(whole_poses(spark, folder), view)
    deep = skinning.depth_order(skinned(spark, folder), folded, view, keep=["vec_id"], row_id="vec_id")
    return rounded(deep.select("vec_id", "frame", "depth", "bucket"))


FARTHEST = f"""WITH RECURSIVE {vectors_sql({"x": 1, "y": 2, "z": 3})},
    m AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*) AS n FROM vectors_v GROUP BY 1 HAVING count(*) >= 8),
    walk AS (SELECT label, n, vec_id, x, y, z, 0 AS node, pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2) AS score, CAST('Infinity' AS DOUBLE) AS near
      FROM vectors_v JOIN m USING (label)
      UNION ALL SELECT label, n, vec_id, x, y, z, node + 1, least(near, d), least(near, d)
      FROM (SELECT *, pow(x - first_value(x) OVER w, 2) + pow(y - first_value(y) OVER w, 2) + pow(z - first_value(z) OVER w, 2) AS d
        FROM walk WHERE node + 1 < least(n, 256) WINDOW w AS (PARTITION BY label ORDER BY score DESC, vec_id)))
    SELECT label AS scene_id, node, arg_max(vec_id, (score, -vec_id)) AS vec_id FROM walk GROUP BY ALL"""


@query("top7_farthest_points", FARTHEST)
def farthest_points(spark, folder):
    rows = vectors(spark, folder, {"x": 1, "y": 2, "z": 3}).withColumnRenamed("label", "scene_id")
    return splats.farthest_points(rows, row_id="vec_id").select("scene_id", "node", "vec_id")


@query(
    "top9_split_opacity",
    f"""SELECT {ITEMS}, round(greatest(0.0001, least(0.9999, 1 - sqrt(greatest(1 - l_discount, 1e-8)))), 9) AS opacity FROM lineitem""",
)
def split_opacity(spark, folder):
    rows = items(spark, folder).select(*ITEM, splats.split_opacity(F.col("l_discount")).alias("opacity"))
    return rows.withColumn("opacity", F.round("opacity", 9))


@query("top9_resample_by_weight")
def resample(spark, folder):
    rows = events(spark, folder).select(
        (F.col("capture_id") % 5).alias("scene_id"), F.col("event_id").alias("gid"), (F.col("k") / 100.0).alias("opacity"), "value"
    )
    return splats.resample_by_weight(rows, cap=100_000_000)


@query(
    "top9_weighted_draws",
    f"""WITH {EVENTS}, w AS (SELECT event_type, event_id, sum(greatest(k, 1e-12)) OVER (PARTITION BY event_type ORDER BY event_id) AS upto FROM events_v),
    f AS (SELECT event_type, upto, min(event_id) AS event_id FROM w GROUP BY ALL),
    t AS (SELECT event_type, sum(greatest(k, 1e-12)) AS total FROM events_v GROUP BY 1),
    d AS (SELECT event_type, event_id AS slot, CAST(('0x' || substr(md5('7|' || event_type || '|' || event_id), 1, 13)) AS BIGINT) / 4503599627370496.0 * total AS u FROM events_v JOIN t USING (event_type))
    SELECT d.event_type, d.slot, w.event_id AS parent FROM d ASOF JOIN f w ON d.event_type = w.event_type AND d.u < w.upto""",
)
def weighted_draws(spark, folder):
    rows = events(spark, folder)
    wanted = rows.select("event_type", F.col("event_id").alias("slot"))
    return splats.weighted_draws(rows, wanted, "event_type", "event_id", "k", seed=7)


@query(
    "fn6_align_splats",
    f"""WITH {vectors_sql({"x": 1, "y": 2, "z": 3})}, u AS (SELECT label, x / n AS ux, y / n AS uy, z / n AS uz FROM
      (SELECT label, x, y, z, sqrt(x * x + y * y + z * z) AS n FROM (SELECT label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM vectors_v GROUP BY 1)))
    SELECT vec_id, round((uy + uz * uz / (1 + uy)) * x - ux * y - ux * uz / (1 + uy) * z, 6) AS x, round(ux * x + uy * y + uz * z, 6) AS y,
      round(-ux * uz / (1 + uy) * x - uz * y + (uy + ux * ux / (1 + uy)) * z, 6) AS z FROM vectors_v JOIN u USING (label)""",
)
def align_splats(spark, folder):
    rows = vectors(spark, folder, {"x": 1, "y": 2, "z": 3, "qw": 4, "qx": 5, "qy": 6, "qz": 7}).withColumnRenamed("label", "scene_id")
    ups = rows.groupBy("scene_id").agg(F.avg("x").alias("ux"), F.avg("y").alias("uy"), F.avg("z").alias("uz"))
    return rounded(splats.align_splats(rows, ups).select("vec_id", "x", "y", "z"))
