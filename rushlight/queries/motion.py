"""Inertial operators on the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushlight.functions.sensors import alignable, blur_pixels, classify_sensor_clock
from rushlight.operators import motion
from rushlight.plans.recurrence import ema
from rushlight.plans.timeline import Timeline
from rushlight.queries.registry import query
from rushlight.queries.views import EVENTS, events, rounded
from rushlight.session import table


def line_of(stream, *ties):
    return Timeline.measure(stream, ["capture_id"], "t", list(ties) or ["event_id"])


@query(
    "win14_angular_rate",
    f"""WITH {EVENTS} SELECT event_id, round(avg(value) OVER (PARTITION BY capture_id ORDER BY t, event_id
      ROWS BETWEEN 31 PRECEDING AND CURRENT ROW), 9) AS angular_rate FROM events_v""",
)
def angular_rate(spark, folder):
    stream = events(spark, folder).select("capture_id", "event_id", "t", "value")
    return rounded(motion.angular_rate(stream, line_of(stream), "value").select("event_id", "angular_rate"), 9)


@query(
    "win14_blur_pixels",
    f"""WITH {EVENTS} SELECT event_id, CASE WHEN k > 0 THEN round(abs(value) * (k / 1000.0) * 1300.0, 6) ELSE 0.0 END AS blur_px FROM events_v""",
)
def blur_px(spark, folder):
    made = blur_pixels(F.col("value"), F.col("k") / 1000.0, F.lit(1300.0))
    return rounded(events(spark, folder).select("event_id", made.alias("blur_px")))


@query(
    "win13_rolling_rms",
    f"""WITH {EVENTS} SELECT event_id, round(sqrt(avg(value * value) OVER (PARTITION BY capture_id ORDER BY t, event_id
      ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)), 6) AS gyro_rms FROM events_v""",
)
def rolling_rms(spark, folder):
    stream = events(spark, folder).select("capture_id", "event_id", "t", "value")
    return rounded(motion.rolling_rms(stream, line_of(stream), "value", "gyro_rms").select("event_id", "gyro_rms"))


@query(
    "win11_low_pass",
    f"""WITH {EVENTS}, w AS (SELECT event_id, list(sqrt(value)) OVER (PARTITION BY capture_id ORDER BY t, event_id) AS xs FROM events_v)
    SELECT event_id, round(list_reduce(xs, lambda g, x: g + CAST(0.05 AS DOUBLE) * (x - g)), 6) AS low FROM w""",
)
def low_pass(spark, folder):
    stream = events(spark, folder).select("capture_id", "event_id", "t", F.sqrt("value").alias("value"))
    return rounded(ema(stream, line_of(stream), {"low": "value"}, 0.05).select("event_id", "low"))


ISLANDS = """stepped AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1
      THEN 0 ELSE 1 END AS step FROM events_v WINDOW w AS (PARTITION BY capture_id ORDER BY t, event_id)),
  island_v AS (SELECT *, sum(step) OVER (PARTITION BY capture_id ORDER BY t, event_id) AS island FROM stepped)"""


@query(
    "win9_phase_spans",
    f"""WITH {EVENTS}, {ISLANDS}
    SELECT capture_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS frames, min(t) AS t_first, max(t) AS t_last,
      arg_min(event_id, (t, event_id)) AS frame_first, arg_max(event_id, (t, event_id)) AS frame_last
    FROM island_v GROUP BY ALL""",
)
def phase_spans(spark, folder):
    stream = events(spark, folder).withColumn("frame", F.col("event_id"))
    return motion.phase_spans(stream, line_of(stream), "event_type", "t")


ORDER_GAPS = """gaps_v AS (SELECT o_custkey AS capture_id, o_orderkey, coalesce(o_orderkey - lag(o_orderkey)
      OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, 0) AS gap FROM orders)"""


def order_gaps(spark, folder):
    frames = table(spark, folder, "orders").select(F.col("o_custkey").alias("capture_id"), "o_orderkey")
    line = Timeline.measure(frames, ["capture_id"], "o_orderkey")
    return motion.frame_gaps(frames, line, "o_orderkey")


@query("win10_frame_gaps", f"WITH {ORDER_GAPS} SELECT * FROM gaps_v")
def frame_gaps(spark, folder):
    return order_gaps(spark, folder)


@query(
    "agg27_dropped_frames",
    f"WITH {ORDER_GAPS} SELECT capture_id, CAST(sum(greatest(gap, 0)) AS BIGINT) AS dropped, count(CASE WHEN gap > 0 THEN 1 END) AS gaps FROM gaps_v GROUP BY 1",
)
def dropped_frames(spark, folder):
    return motion.dropped_frames(order_gaps(spark, folder), ["capture_id"])


@query(
    "agg27_stream_health",
    f"""WITH {EVENTS} SELECT capture_id, event_type, count(*) AS samples,
      CASE WHEN max(t) > min(t) THEN CAST(trunc(count(*) * CAST(100000000000 AS DOUBLE) / (max(t) - min(t))) AS INT) ELSE 0 END AS rate_hz
    FROM events_v GROUP BY ALL""",
)
def stream_health(spark, folder):
    return motion.stream_health(events(spark, folder), ["capture_id", "event_type"], "t", per_second=100_000_000_000)


@query(
    "agg26_lock_report",
    """WITH p AS (SELECT l_suppkey, CAST(round(l_extendedprice) AS BIGINT) AS actual,
        CASE WHEN l_returnflag <> 'N' THEN CAST(p_retailprice * 25 AS BIGINT) END AS requested, l_tax
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    c AS (SELECT l_suppkey, count(CASE WHEN requested IS NOT NULL THEN 1 END) AS checked,
      count(CASE WHEN abs(actual - requested) <= requested // 50 THEN 1 END) AS matched, bool_and(l_tax < 0.08) AS white_balance_locked
      FROM p GROUP BY 1)
    SELECT *, round(matched / CAST(nullif(checked, 0) AS DOUBLE), 6) AS locks_verified_ratio,
      CASE WHEN checked > 0 THEN matched >= 0.999 * checked END AS exposure_locked FROM c""",
)
def lock_report(spark, folder):
    items = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    frames = items.select(
        "l_suppkey",
        F.round("l_extendedprice").cast("long").alias("actual"),
        F.when(F.col("l_returnflag") != "N", F.rint(F.col("p_retailprice") * 25).cast("long")).alias("requested"),
        "l_tax",
    )
    return rounded(motion.lock_report(frames, ["l_suppkey"], "actual", "requested", F.col("l_tax") < 0.08))


@query(
    "agg28_sweep_rate_median",
    f"""WITH {EVENTS}, b AS (SELECT capture_id, greatest(0, least(255, CAST(trunc(abs(value) / 0.5) AS INT))) AS bin, count(*) AS n
      FROM events_v GROUP BY ALL),
    s AS (SELECT *, sum(n) OVER (PARTITION BY capture_id ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY capture_id) AS total FROM b)
    SELECT capture_id, (min(bin) + 0.5) * 0.5 AS median_rate, CAST(max(total) AS BIGINT) AS samples FROM s WHERE upto > total // 2 GROUP BY 1""",
)
def sweep_rate_median(spark, folder):
    return motion.sweep_rate_median(events(spark, folder), ["capture_id"], "value")


SENSORS = (
    EVENTS
    + """,
sensors_v AS (SELECT capture_id, event_id, t * 1000 AS t_ns,
    CASE event_type WHEN 'click' THEN 'rotation' WHEN 'purchase' THEN 'accel' WHEN 'error' THEN 'accel' ELSE 'gyro' END AS sensor,
    (k - 50) / CAST(100 AS DOUBLE) AS x, (value - 50) / CAST(400 AS DOUBLE) AS y, (event_id % 97 - 48) / CAST(100 AS DOUBLE) AS z
  FROM events_v WHERE capture_id >= 0),
turn_v AS (SELECT *, sqrt(greatest(1 - (x * x + y * y + z * z), 0)) AS s FROM sensors_v WHERE sensor = 'rotation'),
turned_v AS (SELECT capture_id, event_id, -2 * (x * z - s * y) AS gx, -2 * (y * z + s * x) AS gy, -(1 - 2 * (x * x + y * y)) AS gz FROM turn_v),
accel_v AS (SELECT capture_id, event_id, list(x) OVER w AS xs, list(y) OVER w AS ys, list(z) OVER w AS zs FROM sensors_v
  WHERE sensor = 'accel' WINDOW w AS (PARTITION BY capture_id ORDER BY t_ns)),
low_v AS (SELECT capture_id, event_id, -list_reduce(xs, lambda g, x: g + CAST(0.05 AS DOUBLE) * (x - g)) AS gx,
  -list_reduce(ys, lambda g, x: g + CAST(0.05 AS DOUBLE) * (x - g)) AS gy, -list_reduce(zs, lambda g, x: g + CAST(0.05 AS DOUBLE) * (x - g)) AS gz FROM accel_v),
marked_v AS (SELECT s.*, CASE WHEN r.event_id IS NOT NULL THEN {'x': r.gx, 'y': r.gy, 'z': r.gz} END AS turn,
    CASE WHEN l.event_id IS NOT NULL THEN {'x': l.gx, 'y': l.gy, 'z': l.gz} END AS low
  FROM sensors_v s LEFT JOIN turned_v r USING (event_id) LEFT JOIN low_v l USING (event_id)),
carried_v AS (SELECT *, last_value(turn IGNORE NULLS) OVER w AS last_turn, last_value(low IGNORE NULLS) OVER w AS last_low
  FROM marked_v WINDOW w AS (PARTITION BY capture_id ORDER BY t_ns ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pointed_v AS (SELECT *, coalesce(last_turn, last_low) AS v, last_turn IS NOT NULL AS from_rotation FROM carried_v),
gravity_v AS (SELECT *, v.x / sqrt(v.x * v.x + v.y * v.y + v.z * v.z) AS gx, v.y / sqrt(v.x * v.x + v.y * v.y + v.z * v.z) AS gy,
  v.z / sqrt(v.x * v.x + v.y * v.y + v.z * v.z) AS gz FROM pointed_v)"""
)


def sensors(spark, folder):
    return sensor_columns(events(spark, folder))


def sensor_columns(rows, *more):
    kind = (
        F.when(F.col("event_type") == "click", "rotation")
        .when(F.col("event_type").isin("purchase", "error"), "accel")
        .otherwise("gyro")
    )
    return rows.select(
        *more,
        "capture_id",
        "event_id",
        (F.col("t") * 1000).alias("t_ns"),
        kind.alias("sensor"),
        ((F.col("k") - 50) / 100.0).alias("x"),
        ((F.col("value") - 50) / 400.0).alias("y"),
        ((F.col("event_id") % 97 - 48) / 100.0).alias("z"),
    )


def sensor_line(rows):
    return Timeline.measure(rows, ["capture_id"], "t_ns")


@query(
    "win11_gravity_axis",
    f"""WITH {SENSORS} SELECT event_id, from_rotation, round(gx, 6) AS gx, round(gy, 6) AS gy, round(gz, 6) AS gz FROM gravity_v""",
)
def gravity_axis(spark, folder):
    rows = sensors(spark, folder)
    made = motion.with_gravity(rows, sensor_line(rows))
    return rounded(
        made.select("event_id", "from_rotation", F.col("gravity.x").alias("gx"), F.col("gravity.y").alias("gy"), F.col("gravity.z").alias("gz"))
    )


STEP_NS = 172_800_000_000_000


@query(
    "win11_sweep",
    f"""WITH {SENSORS},
    g AS (SELECT *, t_ns - lag(t_ns) OVER (PARTITION BY capture_id ORDER BY t_ns) AS step, x * gx + y * gy + z * gz AS yaw
      FROM gravity_v WHERE sensor = 'gyro'),
    m AS (SELECT *, sum(yaw * step / 1e9) OVER (PARTITION BY capture_id ORDER BY t_ns) AS heading FROM g
      WHERE step > 0 AND step <= {STEP_NS} AND abs(yaw) >= 0.05),
    bins AS (SELECT capture_id, least(255, CAST(trunc(abs(degrees(yaw)) / 0.5) AS INT)) AS bin, count(*) AS n FROM m GROUP BY ALL),
    upto AS (SELECT *, sum(n) OVER (PARTITION BY capture_id ORDER BY bin) AS u, sum(n) OVER (PARTITION BY capture_id) AS a FROM bins),
    med AS (SELECT capture_id, (min(bin) + 0.5) * 0.5 AS median_rate_deg_s FROM upto WHERE u > a // 2 GROUP BY 1),
    w AS (SELECT capture_id, degrees(greatest(max(heading), 0)) AS l, degrees(-least(min(heading), 0)) AS r,
      abs(degrees(arg_max(heading, t_ns))) AS e, (max(t_ns) - min(t_ns)) / 1e9 AS d FROM m GROUP BY 1),
    z AS (SELECT capture_id, coalesce(l, 0.0) AS l, coalesce(r, 0.0) AS r, coalesce(e, 0.0) AS e, coalesce(d, 0.0) AS d, coalesce(median_rate_deg_s, 0.0) AS median_rate_deg_s
      FROM (SELECT DISTINCT capture_id FROM sensors_v) LEFT JOIN w USING (capture_id) LEFT JOIN med USING (capture_id))
    SELECT capture_id, round(l, 3) AS left_deg, round(r, 3) AS right_deg, round(l + r, 3) AS swept_deg, round(e, 3) AS return_error_deg,
      round(least(l, r) * 0.8, 3) AS implied_cone_deg, round(d, 3) AS duration_sec, median_rate_deg_s,
      CASE WHEN l < 30 AND l <= r THEN -1 WHEN r < 30 THEN 1 ELSE 0 END AS suggested_direction
    FROM z""",
)
def sweep(spark, folder):
    rows = sensors(spark, folder)
    return rounded(motion.sweep(rows, sensor_line(rows), max_step=STEP_NS), 3)


@query(
    "win12_orbit_or_pan",
    f"""WITH {SENSORS},
    a AS (SELECT *, sqrt(pow(x - p * gx, 2) + pow(y - p * gy, 2) + pow(z - p * gz, 2)) AS across
      FROM (SELECT *, x * gx + y * gy + z * gz AS p FROM gravity_v WHERE sensor = 'accel')),
    c AS (SELECT capture_id, count(CASE WHEN from_rotation AND across > 0.15 THEN 1 END) AS o,
      count(CASE WHEN from_rotation AND across <= 0.15 THEN 1 END) AS p FROM a GROUP BY 1),
    k AS (SELECT capture_id, bool_or(sensor = 'rotation') AS m FROM sensors_v GROUP BY 1)
    SELECT capture_id, coalesce(o, 0) AS orbit_samples, coalesce(p, 0) AS pan_samples, m AS orbit_measured,
      NOT m OR coalesce(o, 0) > coalesce(p, 0) AS orbit_likely FROM k LEFT JOIN c USING (capture_id)""",
)
def orbit_or_pan(spark, folder):
    rows = sensors(spark, folder)
    return motion.orbit_or_pan(rows, sensor_line(rows))


@query(
    "str4_first_deviations",
    f"""WITH {EVENTS}, f AS (SELECT capture_id, arg_min(event_type, (t, event_id)) AS type0, arg_min(k, (t, event_id)) AS k0 FROM events_v GROUP BY 1),
    d AS (SELECT capture_id, t, event_id, 'lens_switch' AS kind, event_type AS value FROM events_v JOIN f USING (capture_id) WHERE event_type <> type0
      UNION ALL SELECT capture_id, t, event_id, 'exposure_drift', CAST(CAST(k AS BIGINT) AS VARCHAR) FROM events_v JOIN f USING (capture_id) WHERE abs(k - k0) > 40)
    SELECT capture_id, kind, min(t) AS t, arg_min(value, (t, event_id)) AS value FROM d GROUP BY ALL""",
)
def first_deviations(spark, folder):
    stream = events(spark, folder).withColumn("k", F.col("k").cast("long"))
    return motion.first_deviations(
        stream,
        line_of(stream),
        {
            "lens_switch": ("event_type", F.col("event_type") != F.col("first_event_type")),
            "exposure_drift": ("k", F.abs(F.col("k") - F.col("first_k")) > 40),
        },
    )


@query(
    "fn19_classify_sensor_clock",
    f"""WITH {EVENTS}, c AS (SELECT event_id, t * 1000 AS t_ns, t * 1000 + CAST(value * 100000000 AS BIGINT) AS boot,
        t * 1000 + CAST(k * 100000000 AS BIGINT) AS mono FROM events_v),
    d AS (SELECT *, CASE WHEN abs(boot - t_ns) < abs(mono - t_ns) AND abs(boot - t_ns) < 5000000000 THEN 'BOOTTIME'
      WHEN abs(mono - t_ns) < 5000000000 THEN 'MONOTONIC' ELSE 'UNKNOWN' END AS clock FROM c)
    SELECT event_id, clock, CASE WHEN clock = 'MONOTONIC' THEN boot - mono ELSE 0 END AS offset_ns, clock <> 'UNKNOWN' AS alignable FROM d""",
)
def sensor_clock(spark, folder):
    t = F.col("t") * 1000
    boot = t + F.rint(F.col("value") * 100000000).cast("long")
    mono = t + F.rint(F.col("k") * 100000000).cast("long")
    rows = events(spark, folder).select("event_id", classify_sensor_clock(t, boot, mono).alias("c"))
    return rows.select("event_id", "c.clock", "c.offset_ns", alignable(F.lit("REALTIME"), F.col("c.clock")).alias("alignable"))
