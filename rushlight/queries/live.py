"""Batch replays of the streaming folds, and streams driven by the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rushlight.functions.sensors import blur_pixels
from rushlight.operators import frames as fr
from rushlight.operators import motion, rest
from rushlight.plans.sizing import shared_folder
from rushlight.plans.timeline import Timeline
from rushlight.queries import pixels
from rushlight.queries.motion import SENSORS, sensor_columns, sensors
from rushlight.queries.registry import query
from rushlight.queries.views import EVENTS, event_columns, events, rounded
from rushlight.session import table
from rushlight.streaming import live

# samples squeezed to the rate of a sensor: the stream's month becomes minutes
SQUEEZE = 200_000
# captures of the event table are many and short, so a lane has many
LANES = 512


def fast_sensors(rows):
    """The sensor view at sensor rate, small rotations, gravity on the z axis."""
    upright = F.when(F.col("sensor") == "accel", 9.81 + F.col("z") / 20).otherwise(F.col("z") / 20)
    return squeezed(rows).withColumns({"x": F.col("x") / 20, "y": F.col("y") / 20, "z": upright})


FAST = (
    SENSORS.replace("sensors_v AS (", "raw_v AS (", 1)
    .replace("turn_v AS (", f"""sensors_v AS (SELECT capture_id, event_id, t_ns // {SQUEEZE} AS t_ns, sensor, x, y, z FROM raw_v),
turn_v AS (""", 1)
    .replace("ORDER BY t_ns", "ORDER BY t_ns, event_id")
)
UPTO = "PARTITION BY capture_id ORDER BY t_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def low_pass(axis):
    return f"list_reduce({axis}s, lambda g, x: g + CAST(0.05 AS DOUBLE) * (x - g))"


STILLNESS = f"""WITH RECURSIVE {FAST},
    f AS (SELECT capture_id, event_id, t_ns, CASE WHEN sensor = 'rotation' THEN 'mark' ELSE sensor END AS sensor, x / 20 AS x, y / 20 AS y,
      CASE WHEN sensor = 'accel' THEN CAST(9.81 AS DOUBLE) + z / 20 ELSE z / 20 END AS z FROM sensors_v),
    a AS (SELECT capture_id, event_id, list(x) OVER w AS xs, list(y) OVER w AS ys, list(z) OVER w AS zs FROM f WHERE sensor = 'accel' WINDOW w AS ({UPTO})),
    g AS (SELECT capture_id, event_id, {{'x': {low_pass("x")}, 'y': {low_pass("y")}, 'z': {low_pass("z")}}} AS own FROM a),
    k AS (SELECT f.*, own, last_value(own IGNORE NULLS) OVER w AS gravity FROM f LEFT JOIN g USING (capture_id, event_id) WINDOW w AS ({UPTO})),
    s AS (SELECT *, sum(CASE WHEN sensor = 'mark' AND gravity IS NOT NULL THEN 1 ELSE 0 END) OVER w AS span,
      last_value(CASE WHEN sensor = 'mark' THEN gravity END IGNORE NULLS) OVER w AS reference FROM k WINDOW w AS ({UPTO})),
    free AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY t_ns, event_id) AS rn FROM s WHERE sensor = 'gyro' AND span = 0),
    walk AS (SELECT DISTINCT capture_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS DOUBLE) AS bx, CAST(0 AS DOUBLE) AS yb, CAST(0 AS DOUBLE) AS bz FROM free
      UNION ALL SELECT w.capture_id, f.rn, f.event_id,
        CASE WHEN sqrt((x - bx) * (x - bx) + (y - yb) * (y - yb) + (z - bz) * (z - bz)) < 0.06 THEN bx + CAST(0.002 AS DOUBLE) * (x - bx) ELSE bx END,
        CASE WHEN sqrt((x - bx) * (x - bx) + (y - yb) * (y - yb) + (z - bz) * (z - bz)) < 0.06 THEN yb + CAST(0.002 AS DOUBLE) * (y - yb) ELSE yb END,
        CASE WHEN sqrt((x - bx) * (x - bx) + (y - yb) * (y - yb) + (z - bz) * (z - bz)) < 0.06 THEN bz + CAST(0.002 AS DOUBLE) * (z - bz) ELSE bz END
      FROM walk w JOIN free f ON f.capture_id = w.capture_id AND f.rn = w.rn + 1),
    gy AS (SELECT s.capture_id, s.event_id, t_ns, span, sqrt(pow(x - coalesce(last_value(bx IGNORE NULLS) OVER w, 0), 2) + pow(y - coalesce(last_value(yb IGNORE NULLS) OVER w, 0), 2)
        + pow(z - coalesce(last_value(bz IGNORE NULLS) OVER w, 0), 2)) AS speed
      FROM s LEFT JOIN walk USING (capture_id, event_id) WHERE sensor = 'gyro' WINDOW w AS ({UPTO})),
    gr AS (SELECT capture_id, event_id, sqrt(avg(speed * speed) OVER (PARTITION BY capture_id ORDER BY t_ns, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)) AS rms,
      CASE WHEN span > 0 AND step > 0 AND step <= 20000000 THEN speed * step / 1e9 END AS turned
      FROM (SELECT *, t_ns - lag(t_ns) OVER (PARTITION BY capture_id, span ORDER BY t_ns, event_id) AS step FROM gy)),
    ar AS (SELECT capture_id, event_id, sqrt(avg(shake * shake) OVER (PARTITION BY capture_id ORDER BY t_ns, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)) AS rms, tilt
      FROM (SELECT *, abs(sqrt(x * x + y * y + z * z) - sqrt(own.x * own.x + own.y * own.y + own.z * own.z)) AS shake,
        CASE WHEN span > 0 THEN degrees(acos(greatest(-1, least(1, (own.x * reference.x + own.y * reference.y + own.z * reference.z)
          / (sqrt(own.x * own.x + own.y * own.y + own.z * own.z) * sqrt(reference.x * reference.x + reference.y * reference.y + reference.z * reference.z)))))) END AS tilt
        FROM s WHERE sensor = 'accel')),
    r AS (SELECT s.capture_id, s.event_id, t_ns, span, tilt, turned, last_value(gr.rms IGNORE NULLS) OVER w AS gyro_rms, last_value(ar.rms IGNORE NULLS) OVER w AS accel_rms
      FROM s LEFT JOIN gr USING (capture_id, event_id) LEFT JOIN ar USING (capture_id, event_id) WHERE sensor <> 'mark' WINDOW w AS ({UPTO})),
    q AS (SELECT *, coalesce(gyro_rms < 0.03 AND accel_rms < 0.25, FALSE) AS quiet FROM r),
    o AS (SELECT *, CASE WHEN quiet AND NOT coalesce(lag(quiet) OVER (PARTITION BY capture_id ORDER BY t_ns, event_id), FALSE) THEN t_ns END AS opened FROM q),
    c AS (SELECT *, last_value(opened IGNORE NULLS) OVER w AS since, last_value(tilt IGNORE NULLS) OVER v AS tilt_now, max(tilt) OVER v AS tilt_most,
      bool_or(span > 0 AND (NOT quiet OR coalesce(tilt > 1, FALSE))) OVER v AS upset, sum(coalesce(turned, 0)) OVER v AS residual
      FROM o WINDOW w AS ({UPTO}), v AS (PARTITION BY capture_id, span ORDER BY t_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT capture_id, t_ns, round(coalesce(gyro_rms, 0), 6) AS gyro_rms, round(coalesce(accel_rms, 0), 6) AS accel_rms, round(coalesce(tilt_now, 0), 6) AS tilt_deg,
      round(coalesce(tilt_most, 0), 6) AS max_tilt_deg, quiet AS at_rest, CASE WHEN quiet THEN (t_ns - since) // 1000000 ELSE 0 END AS rest_for_ms, upset AS disturbed,
      round(degrees(residual), 6) AS residual_deg FROM c"""


def marked_sensors(rows):
    return rows.withColumn("sensor", F.when(F.col("sensor") == "rotation", "mark").otherwise(F.col("sensor")))


def fast_line(rows):
    return Timeline.measure(rows, ["capture_id"], "t_ns", ["event_id"])


@query("win13_stillness", STILLNESS)
def stillness(spark, folder):
    rows = marked_sensors(fast_sensors(sensors(spark, folder)))
    return rounded(rest.stillness(rows, fast_line(rows)).drop("event_id"))


@query("str1_live_stillness", STILLNESS)
def live_stillness(spark, folder):
    rows = ended(spark, marked_sensors(fast_sensors(sensor_stream(spark, folder))), "ts", event_end(spark, folder))
    return rounded(drain(spark, live.live(rows, "stillness", "ts", ["event_id"], lanes=LANES)))


SWEEP_STEP = 200_000_000
SWEEPS = f"""WITH {FAST},
    o AS (SELECT *, x * gx + y * gy + z * gz AS p FROM gravity_v),
    c AS (SELECT *, sum(CASE WHEN sensor = 'accel' AND from_rotation AND across > 0.15 THEN 1 ELSE 0 END) OVER w AS orbit,
        sum(CASE WHEN sensor = 'accel' AND from_rotation AND across <= 0.15 THEN 1 ELSE 0 END) OVER w AS pan
      FROM (SELECT *, sqrt(pow(x - p * gx, 2) + pow(y - p * gy, 2) + pow(z - p * gz, 2)) AS across FROM o) WINDOW w AS ({UPTO})),
    g AS (SELECT *, t_ns - lag(t_ns) OVER (PARTITION BY capture_id ORDER BY t_ns, event_id) AS step FROM c WHERE sensor = 'gyro'),
    h AS (SELECT *, sum(CASE WHEN step > 0 AND step <= {SWEEP_STEP} AND abs(p) >= 0.05 THEN p * step / 1e9 ELSE 0 END) OVER w AS heading FROM g WINDOW w AS ({UPTO})),
    r AS (SELECT *, degrees(greatest(max(heading) OVER w, 0)) AS l, degrees(greatest(-min(heading) OVER w, 0)) AS r FROM h WINDOW w AS ({UPTO}))
    SELECT capture_id, t_ns, round(-degrees(heading), 6) AS heading_deg, round(l, 6) AS left_deg, round(r, 6) AS right_deg, round(l + r, 6) AS swept_deg,
      round(least(l, r) * 0.8, 6) AS implied_cone_deg, CAST(orbit AS BIGINT) AS orbit_samples, CAST(pan AS BIGINT) AS pan_samples, NOT from_rotation OR orbit > pan AS orbit_likely FROM r"""


def squeezed(rows):
    return rows.withColumn("t_ns", F.expr(f"t_ns div {SQUEEZE}"))


@query("str2_live_sweep_replay", SWEEPS)
def sweep_replay(spark, folder):
    rows = squeezed(sensors(spark, folder))
    return rounded(rest.sweep_ticks(rows, fast_line(rows), SWEEP_STEP).drop("event_id"))


@query("str2_live_sweep", SWEEPS)
def live_sweep(spark, folder):
    rows = ended(spark, squeezed(sensor_stream(spark, folder)), "ts", event_end(spark, folder))
    return rounded(drain(spark, live.live(rows, "sweep", "ts", ["event_id"], lanes=LANES, max_step=SWEEP_STEP)))


def ticks(spark, folder):
    """Protocol ticks from the event stream: one event is one tick of a capture's script."""
    stream = events(spark, folder)
    return stream.select(
        "capture_id", "event_id", F.floor((F.col("t") - 1_704_067_200_000_000) / 100_000).alias("t_ms"), (F.col("event_type") != "error").alias("at_rest"),
        F.col("value").cast("long").alias("rest_for_ms"), F.col("k").alias("swept_deg"), (F.col("k") > 10).alias("orbit_likely"),
    )


@query("str3_phase_machine")
def phase_machine(spark, folder):
    return live.replay_phases(ticks(spark, folder), ["event_id"])


LOCKS = f"""WITH {EVENTS}, r AS (SELECT capture_id, event_id, t, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS lens, CAST(trunc(value * 1000) AS BIGINT) AS exposure, k FROM events_v),
    c AS (SELECT *, row_number() OVER w AS checked, sum(CASE WHEN abs(exposure - 50000) <= 1000 THEN 1 ELSE 0 END) OVER w AS matched, first_value(lens IGNORE NULLS) OVER w AS first_lens
      FROM r WINDOW w AS (PARTITION BY capture_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    e AS (
      SELECT capture_id, event_id, t, 'lens_switch' AS kind, first_lens || ' -> ' || lens AS detail, checked - 1 AS checked, matched - CASE WHEN abs(exposure - 50000) <= 1000 THEN 1 ELSE 0 END AS matched FROM c WHERE lens <> first_lens
      UNION ALL SELECT capture_id, event_id, t, 'exposure_drift', 'requested 50000 ns, got ' || exposure, checked, matched FROM c WHERE abs(exposure - 50000) > 1000
      UNION ALL SELECT capture_id, event_id, t, 'awb_not_manual', 'requested OFF', checked, matched FROM c WHERE k = 99)
    SELECT capture_id, t AS t_ns, kind, detail, checked, matched FROM e
    QUALIFY row_number() OVER (PARTITION BY capture_id, kind ORDER BY t, event_id) = 1"""


def lock_rows(stream):
    return stream.select(
        "capture_id", "event_id", F.col("t").alias("t_ns"), F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).alias("physical_id"),
        (F.col("value") * 1000).cast("long").alias("exposure_ns"), F.lit(50000).cast("long").alias("requested_ns"), (F.col("k") != 99).alias("awb_manual"),
        F.lit("0 0 4080 3060").alias("crop"), *(["ts"] if "ts" in stream.columns else []),
    )


@query("str4_lock_events_replay", LOCKS)
def lock_events(spark, folder):
    rows = lock_rows(events(spark, folder))
    return rest.lock_events(rows, fast_line(rows))


@query("str4_live_locks", LOCKS)
def live_locks(spark, folder):
    rows = ended(spark, lock_rows(named_events(spark, folder)), "ts", event_end(spark, folder))
    return drain(spark, live.live(rows, "locks", "ts", ["event_id"], lanes=LANES))


RATES = f"""WITH {EVENTS}, r AS (SELECT event_id, capture_id, t, avg(value) OVER (PARTITION BY capture_id ORDER BY t, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS r, k FROM events_v)
    SELECT capture_id, t AS t_ns, round(r, 9) AS angular_rate, CASE WHEN k > 0 THEN round(abs(r) * (k / 1000.0) * 1300.0, 9) ELSE 0.0 END AS blur_px FROM r"""


def rate_rows(stream):
    return stream.select(
        "capture_id", "event_id", F.col("t").alias("t_ns"), F.col("value").alias("speed"), (F.col("k") / 1000.0).alias("exposure_s"), F.lit(1300.0).alias("focal_px"),
        *(["ts"] if "ts" in stream.columns else []),
    )


@query("str5_live_rate_replay", RATES)
def rate_replay(spark, folder):
    rows = rate_rows(events(spark, folder))
    made = motion.angular_rate(rows, fast_line(rows), "speed")
    return rounded(made.select("capture_id", "t_ns", "angular_rate", blur_pixels(F.col("angular_rate"), F.col("exposure_s"), F.col("focal_px")).alias("blur_px")), 9)


@query("str5_live_rate", RATES)
def live_rate(spark, folder):
    rows = ended(spark, rate_rows(named_events(spark, folder)), "ts", event_end(spark, folder))
    return rounded(drain(spark, live.live(rows, "rate", "ts", ["event_id"], lanes=LANES)), 9)


SELECTED = f"""{pixels.SELECT_WALK}
    SELECT b.label AS capture_id, b.vec_id AS frame, round(sqrt(b.vol), 6) AS blur_root, c.blurred, NOT c.blurred AND NOT w.kept AS duplicate, w.kept
    FROM walk w JOIN cand c ON c.label = w.label AND c.rn = w.rn JOIN vol_v b ON b.vec_id = w.vec_id"""
CHOICE = {"correlation": 0.2, "max_diff": 40.0}


def selected(made):
    return rounded(made.select("capture_id", "frame", F.sqrt("blur_vol").alias("blur_root"), "blurred", "duplicate", "kept"))


@query("str6_online_selection_replay", SELECTED)
def selection_replay(spark, folder):
    rows = pixels.grey(spark, folder)
    return selected(fr.select_frames(fr.frame_signals(rows), pixels.line_of(rows), blur_threshold=0.9, **CHOICE))


@query("str6_live_selection", SELECTED)
def live_selection(spark, folder):
    planes = table(spark, folder, "embeddings")
    rows = pixels.grey_planes(streamed(spark, folder, "embeddings")).withColumn("ts", F.timestamp_seconds(F.col("frame") + 1_000_000_000))
    end = planes.agg(F.timestamp_seconds(F.max("vec_id") + 1_000_086_400).alias("end"))
    return selected(drain(spark, live.live(ended(spark, rows, "ts", end), "select", "ts", blur=0.9, **CHOICE)))


@query(
    "str7_new_manifests",
    """WITH d AS (SELECT o_orderkey AS capture_id, CASE WHEN o_orderstatus <> 'P' THEN 's' || o_custkey END AS session, o_orderdate AS ts FROM orders),
    k AS (SELECT *, coalesce(session, 'name:' || capture_id) AS session_key, row_number() OVER (PARTITION BY coalesce(session, 'name:' || capture_id) ORDER BY ts, capture_id) AS rn FROM d)
    SELECT capture_id, session_key FROM k WHERE rn = 1""",
)
def new_manifests(spark, folder):
    session = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("s"), F.col("o_custkey").cast("string")))
    documents = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("capture_id"), F.to_json(F.struct(session.alias("session_id"))).alias("document"), F.col("o_orderdate").cast("timestamp").alias("ts")
    )
    return live.new_manifests(documents).select("capture_id", "session_key")


@query(
    "str8_stream_health",
    """WITH w AS (SELECT user_id AS capture_id, event_type AS sensor, time_bucket(INTERVAL 1 DAY, ts + to_microseconds(user_id * 1000)) AS b, ts + to_microseconds(user_id * 1000) AS ts FROM events)
    SELECT capture_id, sensor, epoch_us(b) AS window_us, count(*) AS samples, CASE WHEN max(ts) > min(ts) THEN round((count(*) - 1) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) ELSE 0.0 END AS rate_hz FROM w GROUP BY ALL""",
)
def stream_health(spark, folder):
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("capture_id"), F.col("event_type").alias("sensor"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") * 1000).alias("offset")
    )
    made = live.stream_health(rows, window="1 day", offset_us="offset")
    return rounded(made.select("capture_id", "sensor", F.unix_micros("window_start").alias("window_us"), "samples", "rate_hz"), 9)


def drain(spark, stream, mode="append"):
    """Run a stream over all there is and return what it wrote."""
    name = f"drain_{uuid.uuid4().hex}"
    place = f"{shared_folder(spark)}/{name}"
    running = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def streamed(spark, folder, name):
    """A table as a stream, whether it is one file or a folder of files (a file source takes a single file by a pattern only)."""
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]")


def named_events(spark, folder):
    """The stream as ``views.events`` names it, with its event time."""
    return event_columns(streamed(spark, folder, "events"), F.col("ts").cast("timestamp").alias("ts"))


def sensor_stream(spark, folder):
    return sensor_columns(named_events(spark, folder), "ts")


def event_end(spark, folder):
    return table(spark, folder, "events").agg((F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 DAY")).alias("end"))


def ended(spark, stream, event_time, end):
    """The stream and one row of nulls, far behind the others in time, which moves the watermark past them all.

    The row itself is never passed, so nothing comes of it.
    """
    place = f"{shared_folder(spark)}/end-{uuid.uuid4().hex}"
    nothing = [(F.col("end") if f.name == event_time else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema]
    end.select(*nothing).write.parquet(place)
    return stream.union(spark.readStream.schema(stream.schema).parquet(place))


@query(
    "str8_stream_health_live",
    """WITH w AS (SELECT user_id AS capture_id, event_type AS sensor, time_bucket(INTERVAL 1 DAY, ts) AS b, ts FROM events)
    SELECT capture_id, sensor, epoch_us(b) AS window_us, count(*) AS samples FROM w GROUP BY ALL""",
)
def stream_health_live(spark, folder):
    rows = named_events(spark, folder).select("capture_id", F.col("event_type").alias("sensor"), "ts")
    end = event_end(spark, folder).select((F.col("end") + F.expr("INTERVAL 1 DAY")).alias("end"))
    made = drain(spark, live.stream_health(ended(spark, rows, "ts", end), window="1 day"))
    return made.select("capture_id", "sensor", F.unix_micros("window_start").alias("window_us"), "samples")
