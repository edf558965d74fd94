"""Pose operators: vectors read as posed images (dims 1-7), label as capture."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushlight.functions import geometry as g
from rushlight.operators import poses
from rushlight.plans.sizing import settle
from rushlight.queries.geometry import rotation_sql
from rushlight.queries.registry import query
from rushlight.queries.views import rounded, vectors, vectors_sql
from rushlight.session import table

DIMS = {n: i + 1 for i, n in enumerate("qw qx qy qz tx ty tz dx dy dz x y z".split())}
R = rotation_sql("qw", "qx", "qy", "qz")


def turned_t(i, v):
    """Component ``i`` of Rᵀv."""
    return "(" + " + ".join(f"{R[3 * r + i]} * {v[r]}" for r in range(3)) + ")"


POSED = f"""{vectors_sql(DIMS, "raw_v")}, posed_v AS (SELECT label AS capture_id, vec_id AS image_id, qw / n AS qw, qx / n AS qx, qy / n AS qy, qz / n AS qz, tx, ty, tz,
    dx / m AS dx, dy / m AS dy, dz / m AS dz, x, y, z FROM (SELECT *, sqrt(qw * qw + qx * qx + qy * qy + qz * qz) AS n, sqrt(dx * dx + dy * dy + dz * dz) AS m FROM raw_v)),
centre_v AS (SELECT *, {", ".join(f"-{turned_t(i, ('tx', 'ty', 'tz'))} AS c{k}" for i, k in enumerate("xyz"))} FROM posed_v)"""


def posed(spark, folder):
    rows = vectors(spark, folder, DIMS)
    unit = rows.withColumns(
        g.named(g.quat_normalise(g.vec("qw", "qx", "qy", "qz")), "qw", "qx", "qy", "qz")
        | g.named(tuple(c / g.length(g.vec("dx", "dy", "dz")) for c in g.vec("dx", "dy", "dz")), "dx", "dy", "dz")
    )
    return unit.select(F.col("label").alias("capture_id"), F.col("vec_id").alias("image_id"), *DIMS)


MIDDLE = rotation_sql("w", "x", "y", "z")


@query(
    "agg9_median_pose",
    f"""WITH RECURSIVE {POSED},
    sides AS (SELECT p.capture_id, p.qw * s AS w, p.qx * s AS x, p.qy * s AS y, p.qz * s AS z FROM (
      SELECT p.*, CASE WHEN p.qw * f.qw + p.qx * f.qx + p.qy * f.qy + p.qz * f.qz < 0 THEN -1 ELSE 1 END AS s
      FROM posed_v p JOIN (SELECT * FROM posed_v QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY image_id) = 1) f USING (capture_id)) p),
    sums AS (SELECT capture_id, avg(w) AS w, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM sides GROUP BY 1),
    steps AS (SELECT 0 AS step, capture_id, w / n AS w, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS n FROM sums)
      UNION ALL SELECT step + 1, capture_id, w / n, x / n, y / n, z / n FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS n FROM (
        SELECT step, capture_id, sum(w / d) AS w, sum(x / d) AS x, sum(y / d) AS y, sum(z / d) AS z FROM (
          SELECT m.step, q.*, greatest(sqrt(pow(q.w - m.w, 2) + pow(q.x - m.x, 2) + pow(q.y - m.y, 2) + pow(q.z - m.z, 2)), 1e-9) AS d
          FROM steps m JOIN sides q USING (capture_id) WHERE m.step < 64) GROUP BY 1, 2))),
    mid AS (SELECT capture_id, median(cx) AS cx, median(cy) AS cy, median(cz) AS cz FROM centre_v GROUP BY 1),
    whole AS (SELECT * FROM steps JOIN mid USING (capture_id) WHERE step = 64)
    SELECT capture_id, round(w, 6) AS qw, round(x, 6) AS qx, round(y, 6) AS qy, round(z, 6) AS qz,
      {", ".join(f"round(-({MIDDLE[3 * r]} * cx + {MIDDLE[3 * r + 1]} * cy + {MIDDLE[3 * r + 2]} * cz), 6) AS t{k}" for r, k in enumerate("xyz"))},
      round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz FROM whole""",
)
def median_pose(spark, folder):
    return rounded(poses.median_pose(posed(spark, folder)))


@query(
    "agg9_median_centre",
    f"WITH {POSED} SELECT capture_id, round(median(cx), 6) AS cx, round(median(cy), 6) AS cy, round(median(cz), 6) AS cz FROM centre_v GROUP BY 1",
)
def median_centre(spark, folder):
    return rounded(poses.median_centre(posed(spark, folder)))


FIRST = """ref_v AS (SELECT capture_id, qw AS rw, qx AS rx, qy AS ry, qz AS rz, tx AS ux, ty AS uy, tz AS uz, cx AS ox, cy AS oy, cz AS oz FROM centre_v
    WHERE image_id IN (SELECT min(image_id) FROM posed_v GROUP BY capture_id))"""


def first_pose(rows):
    """The first image of each capture stands in for its fixed pose."""
    names = ["qw", "qx", "qy", "qz", "tx", "ty", "tz"]
    firsts = poses.centres(rows).groupBy("capture_id").agg(F.min_by(F.struct(*names, "cx", "cy", "cz"), "image_id").alias("f"))
    return firsts.select("capture_id", "f.*")


@query(
    "agg10_pose_spread",
    f"""WITH {POSED}, {FIRST} SELECT capture_id, round(max(degrees(2 * acos(least(1, abs(qw * rw + qx * rx + qy * ry + qz * rz))))), 5) AS spread_deg
    FROM posed_v JOIN ref_v USING (capture_id) GROUP BY 1""",
)
def pose_spread(spark, folder):
    rows = posed(spark, folder)
    return rounded(poses.pose_spread_deg(rows, first_pose(rows)), 5)


RR = rotation_sql("rw", "rx", "ry", "rz")
RI = rotation_sql("qw", "qx", "qy", "qz")


def seen_sql(m, t):
    return ["(" + " + ".join(f"{m[3 * r + i]} * p.{k}" for i, k in enumerate("xyz")) + f" + {t[r]})" for r in range(3)]


A, B = seen_sql(RR, ("ux", "uy", "uz")), seen_sql(RI, ("i.tx", "i.ty", "i.tz"))


@query(
    "agg10_reprojection",
    f"""WITH {POSED}, {FIRST}, s AS (SELECT p.capture_id, i.image_id, {A[0]} AS ax, {A[1]} AS ay, {A[2]} AS az, {B[0]} AS bx, {B[1]} AS by_, {B[2]} AS bz
      FROM (SELECT capture_id, x, y, z FROM posed_v) p JOIN ref_v USING (capture_id) JOIN (SELECT capture_id, image_id, qw, qx, qy, qz, tx, ty, tz FROM posed_v) i USING (capture_id)),
    m AS (SELECT capture_id, image_id, sqrt(avg(pow(500 * bx / bz - 500 * ax / az, 2) + pow(500 * by_ / bz - 500 * ay / az, 2))) AS rms FROM s WHERE az > 1e-6 AND bz > 1e-6 GROUP BY ALL)
    SELECT capture_id, round(max(rms), 3) AS residual_px FROM m GROUP BY 1""",
)
def reprojection(spark, folder):
    rows = posed(spark, folder)
    points = rows.select("capture_id", "x", "y", "z")
    return rounded(poses.reprojection_px(points, rows, first_pose(rows), lens(rows)), 3)


def lens(rows):
    one = rows.select("capture_id").distinct()
    return one.select("capture_id", F.lit(500.0).alias("fx"), F.lit(500.0).alias("fy"), F.lit(320.0).alias("ppx"), F.lit(240.0).alias("ppy"))


@query(
    "agg11_fixed_pose_status",
    """WITH f AS (SELECT o_custkey AS capture_id, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS rest_cameras,
      count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS hold_cameras, CASE WHEN max(o_totalprice) > 300000 THEN min(o_totalprice) / 10000 END AS residual_px FROM orders GROUP BY 1)
    SELECT capture_id, rest_cameras, hold_cameras, round(residual_px, 6) AS residual_px,
      CASE WHEN rest_cameras = 0 AND hold_cameras = 0 THEN 'error' WHEN rest_cameras = 0 THEN 'verified' WHEN hold_cameras = 0 OR residual_px IS NULL THEN 'asserted'
        WHEN residual_px <= 3.0 THEN 'verified' ELSE 'contradicted' END AS source,
      CASE WHEN rest_cameras > 0 THEN 'rest_window' WHEN hold_cameras > 0 THEN 'hold_keyframes' END AS derived_from FROM f""",
)
def fixed_pose_status(spark, folder):
    facts = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("capture_id")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("rest_cameras"),
        F.count_if(F.col("o_orderstatus") == "O").alias("hold_cameras"),
        F.when(F.max("o_totalprice") > 300000, F.min("o_totalprice") / 10000).alias("residual_px"),
    )
    return rounded(poses.fixed_pose_status(facts))


UP = [f"-{R[3 + i]}" for i in range(3)]


@query(
    "agg12_mean_direction",
    f"""WITH {POSED}, m AS (SELECT capture_id, count(*) AS n, {", ".join(f"avg({u}) AS m{k}" for u, k in zip(UP, "xyz"))} FROM posed_v GROUP BY 1),
    a AS (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS agreement FROM m)
    SELECT capture_id, n, round(agreement, 6) AS agreement, {", ".join(f"CASE WHEN agreement >= 0.35 THEN round(m{k} / agreement, 6) END AS up_{k}" for k in "xyz")} FROM a""",
)
def mean_direction(spark, folder):
    return rounded(poses.camera_up(posed(spark, folder)))


MOUNTS = [poses.SENSOR_TO_CAMERA, *[m for m in poses.axis_rotations() if m != poses.SENSOR_TO_CAMERA]]
MOUNT_ROWS = ", ".join(f"({i}, {', '.join(str(v) for row in m for v in row)})" for i, m in enumerate(MOUNTS))
CD = [f"(c{b}0 * dx + c{b}1 * dy + c{b}2 * dz)" for b in range(3)]


@query(
    "agg13_gravity_from_readings",
    f"""WITH {POSED}, mounts AS (SELECT * FROM (VALUES {MOUNT_ROWS}) AS m(mount, c00, c01, c02, c10, c11, c12, c20, c21, c22)),
    w AS (SELECT capture_id, mount, count(*) AS frames, {", ".join(f"avg({turned_t(i, CD)}) AS m{k}" for i, k in enumerate("xyz"))} FROM posed_v, mounts GROUP BY ALL),
    l AS (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS len FROM w),
    k AS (SELECT capture_id, any_value(frames) AS frames, max(CASE WHEN mount = 0 THEN len END) AS known, max(CASE WHEN mount > 0 THEN len END) AS rival FROM l GROUP BY 1)
    SELECT capture_id, frames, round(CASE WHEN rival > known + 0.05 THEN rival ELSE known END, 6) AS consistency, round(abs(known - rival) * CASE WHEN rival > known AND rival <= known + 0.05 THEN -1 ELSE 1 END, 6) AS margin FROM k""",
)
def gravity_from_readings(spark, folder):
    made = poses.gravity_from_readings(posed(spark, folder))
    return rounded(made.select("capture_id", "frames", "consistency", "margin"))


@query(
    "agg14_world_up",
    """WITH c AS (SELECT c_custkey AS capture_id, CASE WHEN c_acctbal > 3000 THEN c_acctbal END AS gx FROM customer),
    o AS (SELECT o_custkey AS capture_id, max(o_totalprice) AS ox FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT c.capture_id, round(coalesce(gx, ox), 6) AS up_x, CASE WHEN gx IS NOT NULL THEN 'gravity' WHEN ox IS NOT NULL THEN 'cameras' END AS source
    FROM c LEFT JOIN o USING (capture_id)""",
)
def world_up(spark, folder):
    captures = table(spark, folder, "customer").select(F.col("c_custkey").alias("capture_id"), F.col("c_acctbal").alias("b"))
    zero = [F.lit(0.0).alias("up_y"), F.lit(0.0).alias("up_z")]
    gravity = captures.select("capture_id", F.when(F.col("b") > 3000, F.col("b")).alias("up_x"), *zero)
    cameras = (
        table(spark, folder, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("capture_id"))
        .agg(F.max("o_totalprice").alias("up_x")).select("capture_id", "up_x", *zero)
    )
    return rounded(poses.world_up(captures, gravity, cameras).select("capture_id", "up_x", "source"))


P = seen_sql(RR, ("ux", "uy", "uz"))
# set mask pixels: where part sizes and keys point
MASK = "mask_v AS (SELECT DISTINCT CAST(p_partkey % 10 AS INT) AS capture_id, CAST(p_partkey % 48 AS INT) AS row, CAST(p_size AS INT) AS col FROM part)"
LABELLED = f"""{POSED}, {FIRST}, {MASK},
seen_v AS (SELECT p.capture_id, p.image_id, p.x, p.y, p.z, {P[0]} AS sx, {P[1]} AS sy, {P[2]} AS depth FROM (SELECT capture_id, image_id, x, y, z FROM posed_v) p JOIN ref_v USING (capture_id)),
pixel_v AS (SELECT *, CASE WHEN depth > 1e-6 THEN 20 * sx / depth + 32 END AS u, CASE WHEN depth > 1e-6 THEN 20 * sy / depth + 24 END AS v FROM seen_v),
hit_v AS (SELECT p.*, m.row IS NOT NULL AS dynamic, depth > 1e-6 AS in_front FROM pixel_v p LEFT JOIN mask_v m ON u >= 0 AND u < 64 AND v >= 0 AND v < 48
  AND m.capture_id = p.capture_id AND m.col = least(CAST(round_even(u, 0) AS INT), 63) AND m.row = least(CAST(round_even(v, 0) AS INT), 47))"""


def labelled(spark, folder):
    rows = posed(spark, folder)
    eye = first_pose(rows).withColumns(
        {"fx": F.lit(20.0), "fy": F.lit(20.0), "ppx": F.lit(32.0), "ppy": F.lit(24.0), "width": F.lit(64), "height": F.lit(48)}
    ).drop("cx", "cy", "cz")
    mask = table(spark, folder, "part").select(
        (F.col("p_partkey") % 10).cast("int").alias("capture_id"), (F.col("p_partkey") % 48).cast("int").alias("row"), F.col("p_size").alias("col")
    )
    points = rows.select("capture_id", "image_id", "x", "y", "z")
    return poses.label_dynamic(points, eye, mask)


@query("jn8_label_dynamic", f"WITH {LABELLED} SELECT capture_id, image_id, dynamic, in_front FROM hit_v")
def label_dynamic(spark, folder):
    return labelled(spark, folder).drop("x", "y", "z")


SUBJECT = f"""{LABELLED}, tier_v AS (SELECT *, CASE WHEN count(CASE WHEN dynamic THEN 1 END) OVER c >= 8 THEN 'm' WHEN count(CASE WHEN in_front THEN 1 END) OVER c > 0 THEN 'f' ELSE 'a' END AS tier
    FROM hit_v WINDOW c AS (PARTITION BY capture_id)),
subject_v AS (SELECT capture_id, median(x) AS sx, median(y) AS sy, median(z) AS sz,
    CASE any_value(tier) WHEN 'm' THEN 'dynamic_mask' WHEN 'f' THEN 'sparse_points' ELSE 'sparse_points_unfiltered' END AS centroid_source
  FROM tier_v WHERE tier = 'a' OR (tier = 'f' AND in_front) OR (tier = 'm' AND dynamic) GROUP BY 1)"""


@query(
    "agg15_subject_centroid",
    f"WITH {SUBJECT} SELECT capture_id, round(sx, 6) AS sx, round(sy, 6) AS sy, round(sz, 6) AS sz, centroid_source FROM subject_v",
)
def subject_centroid(spark, folder):
    return rounded(poses.subject_centroid(labelled(spark, folder)))


CONE = f"""{SUBJECT}, b AS (SELECT r.capture_id, sx, sy, sz, (sx - ox) / n AS wx, (sy - oy) / n AS wy, (sz - oz) / n AS wz, -{RR[3]} AS ax, -{RR[4]} AS ay, -{RR[5]} AS az
    FROM (SELECT *, sqrt(pow(sx - ox, 2) + pow(sy - oy, 2) + pow(sz - oz, 2)) AS n FROM ref_v JOIN subject_v USING (capture_id)) r),
b2 AS (SELECT *, ax - d * wx AS px, ay - d * wy AS py, az - d * wz AS pz FROM (SELECT *, ax * wx + ay * wy + az * wz AS d FROM b)),
b3 AS (SELECT *, px / n AS ux, py / n AS uy, pz / n AS uz FROM (SELECT *, sqrt(px * px + py * py + pz * pz) AS n FROM b2)),
b4 AS (SELECT *, uy * wz - uz * wy AS rx, uz * wx - ux * wz AS ry, ux * wy - uy * wx AS rz FROM b3),
v AS (SELECT c.capture_id, sx - cx AS dx, sy - cy AS dy, sz - cz AS dz, wx, wy, wz, ux, uy, uz, rx, ry, rz FROM centre_v c JOIN b4 USING (capture_id)),
a AS (SELECT capture_id, sqrt(dx * dx + dy * dy + dz * dz) AS r, dx * wx + dy * wy + dz * wz AS f, dx * rx + dy * ry + dz * rz AS s, dx * ux + dy * uy + dz * uz AS h FROM v),
angle_v AS (SELECT capture_id, r, degrees(atan2(s, f)) AS az, degrees(atan2(h, sqrt(f * f + s * s))) AS el FROM a),
cone_v AS (SELECT capture_id, quantile_cont(az, 0.02) AS az0, quantile_cont(az, 0.98) AS az1, quantile_cont(el, 0.02) AS el0, quantile_cont(el, 0.98) AS el1, median(r) AS radius, count(*) AS cameras FROM angle_v GROUP BY 1),
half_v AS (SELECT *, greatest(0, least(-az0, az1)) AS azh, greatest(0, least(-el0, el1)) AS elh, 10.0 + capture_id * 12 AS imu FROM cone_v)"""


@query(
    "agg16_view_cone",
    f"""WITH {CONE} SELECT capture_id, round(least(azh, imu), 4) AS azimuth_half_deg, round(elh, 4) AS elevation_half_deg, round(az0, 4) AS azimuth_min_deg, round(az1, 4) AS azimuth_max_deg,
      round(el0, 4) AS elevation_min_deg, round(el1, 4) AS elevation_max_deg, round(radius, 4) AS radius, cameras,
      CASE WHEN imu < azh THEN 'measured_clamped_by_imu' ELSE 'measured' END AS source, CASE WHEN least(azh, imu) < 20 THEN 'narrow' ELSE '' END AS warnings FROM half_v""",
)
def view_cone(spark, folder):
    rows = posed(spark, folder)
    subject = settle(poses.subject_centroid(labelled(spark, folder))).withColumn("imu", 10.0 + F.col("capture_id") * 12)
    made = poses.view_cone(rows.select("capture_id", "image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz"), first_pose(rows), subject, "imu")
    return rounded(made, 4)
