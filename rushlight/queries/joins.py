"""Time, interval and key joins, inventories and samples on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushlight.operators import catalog, integrity, joins, sampling, telemetry
from rushlight.plans.timeline import Timeline
from rushlight.queries.registry import query
from rushlight.queries.telemetry import REPORT, measured
from rushlight.queries.telemetry import report as telemetry_rows
from rushlight.queries.views import EVENTS, events, rounded
from rushlight.session import table
from rushlight.sources.sensors import last_per_frame

CLICKS_VIEWS = (
    EVENTS
    + """,
frames_v AS (SELECT capture_id, event_id, t FROM events_v WHERE event_type = 'click'),
samples_v AS (SELECT capture_id, t, value, k FROM events_v WHERE event_type = 'view')"""
)


def frames_and_samples(spark, folder):
    stream = events(spark, folder)
    frames = stream.filter("event_type = 'click'").select("capture_id", "event_id", "t")
    samples = stream.filter("event_type = 'view'").select("capture_id", "t", "value", "k")
    return frames, samples


@query(
    "jn1_interp_join",
    f"""WITH {CLICKS_VIEWS},
    p AS (SELECT f.*, s.t AS t0, s.value AS v0, s.k AS k0 FROM frames_v f ASOF JOIN samples_v s
          ON f.capture_id = s.capture_id AND f.t >= s.t),
    b AS (SELECT p.*, s.t AS t1, s.value AS v1, s.k AS k1 FROM p ASOF JOIN samples_v s
          ON p.capture_id = s.capture_id AND p.t <= s.t)
    SELECT capture_id, event_id, t,
      round(v0 + (v1 - v0) * CASE WHEN t1 > t0 THEN (t - t0) / CAST(t1 - t0 AS DOUBLE) ELSE 0.0 END, 6) AS value,
      round(k0 + (k1 - k0) * CASE WHEN t1 > t0 THEN (t - t0) / CAST(t1 - t0 AS DOUBLE) ELSE 0.0 END, 6) AS k
    FROM b""",
)
def interp_join(spark, folder):
    frames, samples = frames_and_samples(spark, folder)
    return rounded(joins.interp_join(frames, samples, "capture_id", "t", ["value", "k"]))


HOUR = 3_600_000_000


@query(
    "jn3_nearest_join",
    f"""WITH {CLICKS_VIEWS}, shifted AS (SELECT capture_id, t + 1000000 AS t, value FROM samples_v),
    p AS (SELECT f.*, s.t AS t0, s.value AS v0 FROM frames_v f ASOF LEFT JOIN shifted s
          ON f.capture_id = s.capture_id AND f.t >= s.t),
    b AS (SELECT p.*, s.t AS t1, s.value AS v1 FROM p ASOF LEFT JOIN shifted s
          ON p.capture_id = s.capture_id AND p.t <= s.t),
    c AS (SELECT *, CASE WHEN t1 IS NULL OR t - t0 <= t1 - t THEN t0 ELSE t1 END AS sample_t,
                 CASE WHEN t1 IS NULL OR t - t0 <= t1 - t THEN v0 ELSE v1 END AS value FROM b)
    SELECT capture_id, event_id, t, sample_t, abs(t - sample_t) AS delta, value FROM c
    WHERE abs(t - sample_t) <= {6 * HOUR}""",
)
def nearest_join(spark, folder):
    frames, samples = frames_and_samples(spark, folder)
    samples = samples.withColumn("clock_offset", F.lit(1_000_000))
    return joins.nearest_join(frames, samples, "capture_id", "t", ["value"], 6 * HOUR, offset="clock_offset")


@query(
    "jn3_frame_count_drift",
    f"""WITH {CLICKS_VIEWS}, l AS (SELECT capture_id, count(*) AS logged FROM frames_v GROUP BY 1),
    v AS (SELECT capture_id, count(*) AS video_frames FROM samples_v GROUP BY 1)
    SELECT capture_id, logged, video_frames, logged - video_frames AS drift FROM l FULL JOIN v USING (capture_id)""",
)
def frame_count_drift(spark, folder):
    frames, samples = frames_and_samples(spark, folder)
    video = samples.groupBy("capture_id").agg(F.count(F.lit(1)).alias("video_frames"))
    return joins.frame_count_drift(frames, video, "capture_id")


LAST = """last_v AS (
  SELECT capture_id, CAST(k AS BIGINT) AS frame, arg_max(t, (t, event_id)) AS t_ns,
         arg_max(event_type, (t, event_id)) AS phase
  FROM events_v GROUP BY ALL)"""


def last_frames(spark, folder):
    lines = events(spark, folder).withColumn("frame", F.col("k").cast("long"))
    return last_per_frame(lines, ["capture_id", "frame"], ["t", "event_id"], {"t_ns": "t", "phase": "event_type"})


@query("src2_frames_last_wins", f"WITH {EVENTS}, {LAST} SELECT * FROM last_v")
def frames_last_wins(spark, folder):
    return last_frames(spark, folder)


@query(
    "jn2_frame_timestamps",
    f"""WITH {EVENTS}, {LAST}
    SELECT e.capture_id, e.event_id || '.jpg' AS name, l.frame, l.t_ns
    FROM events_v e JOIN last_v l ON e.capture_id = l.capture_id
      AND CAST(round_even(e.k / CAST(29.97 AS DOUBLE) * CAST(29.97 AS DOUBLE), 0) AS BIGINT) = l.frame
    WHERE event_type <> 'error'""",
)
def frame_timestamps(spark, folder):
    index = events(spark, folder).select(
        "capture_id",
        F.concat(F.lit("frames/images/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("file"),
        (F.col("k") / 29.97).alias("timestamp_sec"),
        F.when(F.col("event_type") != "error", 29.97).otherwise(0.0).alias("fps"),
    )
    return joins.frame_timestamps(index, last_frames(spark, folder))


PHASES = """phases_v AS (
  SELECT DISTINCT user_id AS capture_id, name, lo + user_id % 10 AS start_frame, hi + user_id % 10 AS end_frame
  FROM events, (VALUES ('perch', 0, 19), ('arc', 20, 59), ('reseat', 60, 69), ('hold', 65, 85)) AS p(name, lo, hi))"""


def phases(spark, folder):
    spans = [("perch", 0, 19), ("arc", 20, 59), ("reseat", 60, 69), ("hold", 65, 85)]
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, a, b in spans])
    users = table(spark, folder, "events").select(F.col("user_id").alias("capture_id")).distinct()
    return users.select("capture_id", F.explode(each).alias("p")).select(
        "capture_id",
        "p.name",
        (F.col("p.lo") + F.col("capture_id") % 10).alias("start_frame"),
        (F.col("p.hi") + F.col("capture_id") % 10).alias("end_frame"),
    )


@query(
    "jn4_phase_of",
    f"""WITH {EVENTS}, {PHASES}
    SELECT e.event_id, any_value(e.k) AS k,
      arg_min(p.name, CASE p.name WHEN 'perch' THEN 0 WHEN 'arc' THEN 1 WHEN 'reseat' THEN 2 ELSE 3 END) AS phase
    FROM events_v e LEFT JOIN phases_v p ON e.capture_id = p.capture_id AND e.k BETWEEN p.start_frame AND p.end_frame
    GROUP BY e.event_id""",
)
def phase_of(spark, folder):
    frames = events(spark, folder).select("capture_id", "event_id", "k")
    return joins.phase_of(frames, phases(spark, folder), "capture_id", "k").select("event_id", "k", "phase")


@query(
    "jn4_phase_durations",
    f"""WITH {PHASES} SELECT capture_id, name, end_frame - start_frame + 1 AS frame_count,
      round((end_frame - start_frame + 1) / 30.0, 6) AS duration_sec FROM phases_v""",
)
def phase_durations(spark, folder):
    made = joins.phase_durations(phases(spark, folder).withColumn("fps", F.lit(30.0)))
    return rounded(made.select("capture_id", "name", "frame_count", "duration_sec"))


@query(
    "jn5_overlapping_phases",
    f"""WITH {PHASES}, caps AS (SELECT DISTINCT user_id AS capture_id, user_id % 10 + 10 AS rest_start FROM events)
    SELECT capture_id, name, 'error' AS level, 'overlap' AS code FROM
      (SELECT *, lag(end_frame) OVER (PARTITION BY capture_id ORDER BY start_frame) AS before FROM phases_v)
    WHERE start_frame <= before
    UNION ALL
    SELECT c.capture_id, NULL, 'error', 'rest_outside' FROM caps c JOIN phases_v p ON c.capture_id = p.capture_id
    WHERE p.name IN ('perch', 'arc') AND c.rest_start BETWEEN p.start_frame AND p.end_frame""",
)
def overlapping_phases(spark, folder):
    spans = phases(spark, folder)
    captures = spans.select("capture_id").distinct().select(
        "capture_id",
        F.lit("fixed_camera_4d").alias("capture_type"),
        (F.col("capture_id") % 10 + 10).alias("rest_start"),
        (F.col("capture_id") % 10 + 14).alias("rest_end"),
    )
    return integrity.overlapping_phases(spans, captures).drop("message")


DOCS = """files_v AS (SELECT source AS capture_id, 'data/' || doc_id || '.txt' AS path, octet_length(encode(text)) AS length,
    sha256(text) AS digest FROM documents WHERE lang <> 'de'),
listed_v AS (SELECT source AS capture_id, 'data/' || d.doc_id || '.txt' AS path,
    CASE WHEN toxic = 1 THEN sha256(text || '.') ELSE sha256(text) END AS digest
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def doc_files(spark, folder):
    return (
        table(spark, folder, "documents")
        .filter("lang <> 'de'")
        .select(
            F.col("source").alias("capture_id"),
            F.concat(F.lit("data/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
            F.octet_length("text").cast("long").alias("length"),
            F.sha2("text", 256).alias("sha256"),
        )
    )


def doc_lines(spark, folder):
    text = F.when(F.col("toxic") == 1, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    labelled = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    path = F.concat(F.lit("data/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    good = F.concat(F.upper(F.sha2(text, 256)), F.lit("  "), path)
    return labelled.select(
        F.col("source").alias("capture_id"),
        F.explode(F.array(good, F.concat(F.lit("garbage "), path))).alias("line"),
    )


@query(
    "jn6_reconcile",
    f"""WITH {DOCS}
    SELECT coalesce(l.capture_id, f.capture_id) AS capture_id, 'error' AS level, coalesce(l.path, f.path) AS path,
      CASE WHEN f.path IS NULL THEN 'missing_file' WHEN l.path IS NULL THEN 'unlisted_file' ELSE 'checksum_mismatch' END AS code
    FROM listed_v l FULL JOIN files_v f ON l.capture_id = f.capture_id AND l.path = f.path
    WHERE f.path IS NULL OR l.path IS NULL OR f.digest <> l.digest
    UNION ALL SELECT capture_id, 'warning', 'garbage ' || path, 'unparseable_line' FROM listed_v""",
)
def reconcile(spark, folder):
    return integrity.reconcile(doc_lines(spark, folder), doc_files(spark, folder))


@query(
    "jn6_reconcile_complete_only",
    f"""WITH {DOCS}
    SELECT coalesce(l.capture_id, f.capture_id) AS capture_id, 'error' AS level, coalesce(l.path, f.path) AS path,
      CASE WHEN f.path IS NULL THEN 'missing_file' ELSE 'unlisted_file' END AS code
    FROM listed_v l FULL JOIN files_v f ON l.capture_id = f.capture_id AND l.path = f.path
    WHERE f.path IS NULL OR l.path IS NULL
    UNION ALL SELECT capture_id, 'warning', 'garbage ' || path, 'unparseable_line' FROM listed_v""",
)
def reconcile_complete_only(spark, folder):
    return integrity.reconcile(doc_lines(spark, folder), doc_files(spark, folder), complete_only=True)


@query(
    "jn6_payload_oxum",
    f"""WITH {DOCS} SELECT f.capture_id, coalesce(sum(CASE WHEN l.path IS NOT NULL THEN length END), 0) || '.' || count(*) AS oxum
    FROM files_v f LEFT JOIN listed_v l ON f.capture_id = l.capture_id AND l.path = f.path GROUP BY 1""",
)
def payload_oxum(spark, folder):
    return integrity.payload_oxum(doc_lines(spark, folder), doc_files(spark, folder))


@query(
    "set1_missing_and_extra",
    """WITH a AS (SELECT doc_id FROM labels), b AS (SELECT doc_id FROM documents WHERE lang <> 'de')
    SELECT doc_id, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
    UNION ALL SELECT doc_id, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def missing_and_extra(spark, folder):
    present = table(spark, folder, "documents").filter("lang <> 'de'").select("doc_id")
    return integrity.missing_and_extra(table(spark, folder, "labels"), present, ["doc_id"])


@query(
    "jn7_new_captures",
    """WITH remote AS (SELECT c_name AS name, CASE WHEN c_acctbal >= 0 THEN c_custkey END AS session_id
      FROM customer WHERE c_nationkey <> 0),
    names AS (SELECT c_name AS name FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
    SELECT name, session_id, TRUE AS usable FROM remote r WHERE
      CASE WHEN session_id IS NOT NULL THEN NOT EXISTS
             (SELECT 1 FROM orders o WHERE o.o_custkey = r.session_id AND o_orderstatus = 'F')
           ELSE NOT EXISTS (SELECT 1 FROM names n WHERE n.name = r.name) END""",
)
def new_captures(spark, folder):
    customers = table(spark, folder, "customer")
    remote = customers.select(
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).alias("session_id"),
        (F.col("c_nationkey") != 0).alias("usable"),
    )
    seen = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("session_id"))
    named = customers.filter("c_mktsegment = 'AUTOMOBILE'").select(F.col("c_name").alias("name"))
    return joins.new_captures(remote, seen, named)


MODELS = """models_v AS (SELECT o_custkey AS capture_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS model_id,
    count(*) AS registered, CAST(sum(floor(o_totalprice)) AS BIGINT) AS points FROM orders GROUP BY ALL),
  totals_v AS (SELECT c_custkey AS capture_id, 6 + c_nationkey % 5 AS frames_total FROM customer)"""
POSE = (
    MODELS
    + """,
  best_v AS (SELECT capture_id, max((registered, -model_id, points)) AS b, count(*) AS models FROM models_v GROUP BY 1),
  pose_v AS (SELECT t.capture_id, -b[2] AS model_id, coalesce(b[1], 0) AS images_registered,
      coalesce(b[3], 0) AS sparse_points, coalesce(b[1], 0) / CAST(frames_total AS DOUBLE) AS registered_ratio,
      coalesce(models, 0) AS models, coalesce(models, 0) > 1 AS disconnected
    FROM totals_v t LEFT JOIN best_v USING (capture_id)),
  pose_status_v AS (SELECT *, CASE WHEN models = 0 THEN 'bad' WHEN registered_ratio >= 0.75 THEN 'good'
      WHEN registered_ratio >= 0.35 THEN 'warning' ELSE 'bad' END AS pose_status FROM pose_v)"""
)


def pose(spark, folder):
    models = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("capture_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("model_id"))
        .agg(F.count(F.lit(1)).alias("registered"), F.sum(F.floor("o_totalprice")).alias("points"))
    )
    totals = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("capture_id"), (6 + F.col("c_nationkey") % 5).alias("frames_total")
    )
    return catalog.registration_summary(models, totals)


@query(
    "agg17_registration_summary",
    f"""WITH {POSE} SELECT capture_id, model_id, images_registered, sparse_points, models, disconnected, pose_status,
      round(registered_ratio, 6) AS registered_ratio FROM pose_status_v""",
)
def registration_summary(spark, folder):
    return rounded(pose(spark, folder))


RUNS = (
    POSE
    + ""","""
    + REPORT
    + """,
  kept_v AS (SELECT capture_id, count(CASE WHEN hist_correlation <= 0.99 THEN 1 END) AS frames_used, count(*) AS frames_sampled
    FROM signals_v GROUP BY 1),
  errors_v AS (SELECT o_custkey AS capture_id, CASE WHEN max(o_totalprice) > 400000 THEN repeat('failed ', 60) END AS error
    FROM orders GROUP BY 1),
  runs_v AS (SELECT c.c_custkey AS capture_id, r.vol_median, k.frames_used, k.frames_sampled, p.images_registered,
      p.registered_ratio, substr(e.error, 1, 300) AS error, coalesce(p.pose_status, 'not_run') AS pose_status,
      coalesce(p.pose_status, 'not_run') IN ('good', 'warning') AS registered
    FROM customer c LEFT JOIN report_v r ON r.capture_id = c.c_custkey LEFT JOIN kept_v k ON k.capture_id = c.c_custkey
      LEFT JOIN (SELECT * FROM pose_status_v WHERE models > 0) p ON p.capture_id = c.c_custkey
      LEFT JOIN errors_v e ON e.capture_id = c.c_custkey)"""
)


def runs(spark, folder):
    frames, line = measured(spark, folder)
    report = telemetry.telemetry_report(frames, line=line).select("capture_id", "vol_median")
    kept = frames.groupBy("capture_id").agg(
        F.count_if(F.col("hist_correlation") <= 0.99).alias("frames_used"), F.count(F.lit(1)).alias("frames_sampled")
    )
    posed = pose(spark, folder).filter("models > 0").select(
        "capture_id", "images_registered", "registered_ratio", "pose_status"
    )
    failed = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("capture_id"))
        .agg(F.when(F.max("o_totalprice") > 400000, F.repeat(F.lit("failed "), 60)).alias("error"))
    )
    captures = table(spark, folder, "customer").select(F.col("c_custkey").alias("capture_id"))
    return joins.collect_run_record(captures, report, kept, posed.join(failed, "capture_id", "left"))


@query(
    "jn15_collect_run_record",
    f"""WITH {RUNS} SELECT capture_id, round(vol_median, 6) AS vol_median, frames_used, frames_sampled, images_registered,
      round(registered_ratio, 6) AS registered_ratio, error, pose_status, registered FROM runs_v""",
)
def run_record(spark, folder):
    return rounded(runs(spark, folder))


@query(
    "agg33_run_summary",
    f"""WITH {RUNS} SELECT count(*) AS captures, count(CASE WHEN registered THEN 1 END) AS registered, count(error) AS errors
    FROM runs_v""",
)
def run_summary(spark, folder):
    return catalog.run_summary(runs(spark, folder))


@query(
    "agg33_result_table",
    f"""WITH {RUNS} SELECT capture_id, frames_used, images_registered,
      CASE pose_status WHEN 'good' THEN 'ok' WHEN 'warning' THEN 'warn' ELSE 'bad' END AS status_class FROM runs_v""",
)
def result_table(spark, folder):
    return catalog.result_table(runs(spark, folder), ["capture_id", "frames_used", "images_registered"])


@query(
    "agg32_capture_stage",
    """WITH s AS (SELECT c_custkey AS capture_id, coalesce(max(CASE
        WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 6 WHEN o_orderstatus = 'F' THEN 3
        WHEN o_orderstatus = 'P' AND o_orderpriority LIKE '2%' THEN 5 WHEN o_orderstatus = 'P' THEN 2
        WHEN o_orderpriority LIKE '3%' THEN 4 WHEN o_orderpriority LIKE '4%' THEN 1 ELSE 0 END), 0) AS n
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT capture_id, ['none','masked','prepared','packaged','trained','exported','viewable'][n + 1] AS stage,
      ['prep4d','prep4d','colab4d','train4d','export4d','viewer4d',NULL][n + 1] AS next_command FROM s""",
)
def capture_stage(spark, folder):
    status, priority = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    path = (
        F.when((status == "F") & (priority == "1"), "export/viewer4d/index.html")
        .when(status == "F", "colab_export/dataset4d.zip")
        .when((status == "P") & (priority == "2"), "export/scene.g4d")
        .when(status == "P", "training/scene4d_init.npz")
        .when(priority == "3", "training/scene4d.npz")
        .when(priority == "4", "masks/frame_0001.png")
        .otherwise("masks/readme.txt")
    )
    files = table(spark, folder, "orders").select(F.col("o_custkey").alias("capture_id"), path.alias("path"))
    captures = table(spark, folder, "customer").select(F.col("c_custkey").alias("capture_id"))
    return catalog.capture_stage(captures, files)


@query(
    "src6_flatten_signals",
    """SELECT user_id AS capture_id, sum(CASE WHEN event_type = 'click' THEN 1 END) AS signal_click,
      sum(CASE WHEN event_type = 'view' THEN 1 END) AS signal_view,
      sum(CASE WHEN event_type = 'absent' THEN 1 END) AS signal_absent FROM events GROUP BY 1""",
)
def flatten_signals(spark, folder):
    counted = events(spark, folder).groupBy("capture_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    mapped = counted.groupBy("capture_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("signals"))
    return catalog.flatten_signals(mapped, ["click", "view", "absent"])


@query(
    "set3_merge_warnings",
    f"""WITH {REPORT}
    SELECT capture_id, 0 AS stage, 1 AS position, 'blurred' AS warning FROM report_v WHERE blurry_frame_ratio > 0.15
    UNION ALL SELECT capture_id, 1, 1, 'dark' FROM report_v WHERE too_dark_ratio > 0.10
    UNION ALL SELECT capture_id, 2, 1, 'fast' FROM report_v WHERE too_fast_ratio > 0.12""",
)
def merge_warnings(spark, folder):
    report = telemetry_rows(spark, folder)
    parts = [
        report.filter(test).select("capture_id", F.lit(1).alias("position"), F.lit(text).alias("warning"))
        for test, text in (
            (F.col("blurry_frame_ratio") > 0.15, "blurred"),
            (F.col("too_dark_ratio") > 0.10, "dark"),
            (F.col("too_fast_ratio") > 0.12, "fast"),
        )
    ]
    return catalog.merge_warnings(parts)


@query(
    "set3_advice_set",
    """SELECT DISTINCT user_id AS capture_id, event_type AS recommendation FROM events WHERE value > 20
    UNION SELECT DISTINCT user_id, event_type FROM events WHERE value < 10""",
)
def advice_set(spark, folder):
    stream = events(spark, folder).withColumn("recommendation", F.col("event_type"))
    return catalog.advice_set([stream.filter("value > 20"), stream.filter("value < 10")])


@query(
    "set4_frame_plan",
    """WITH p AS (SELECT DISTINCT user_id AS capture_id, name, lo + user_id % 10 AS s, hi + user_id % 10 AS e
      FROM events, (VALUES ('perch', 0, 19), ('arc', 20, 59), ('reseat', 60, 69), ('hold', 70, 99)) AS p(name, lo, hi)),
    strided AS (SELECT capture_id, name, unnest(list_distinct(list_concat(
        range(s, e + 1, CASE name WHEN 'arc' THEN 5 ELSE 15 END), [e]))) AS frame
      FROM p WHERE name <> 'hold'),
    held AS (SELECT DISTINCT capture_id, name, CAST(round_even(s + i * ((e - s) / 7.0), 0) AS BIGINT) AS frame
      FROM p, range(0, 8) r(i) WHERE name = 'hold'),
    rest AS (SELECT capture_id, unnest(range(66 + capture_id % 10, 73 + capture_id % 10)) AS frame FROM (SELECT DISTINCT capture_id FROM p)),
    rested AS (SELECT r.capture_id, r.frame, p.name FROM rest r JOIN p ON r.capture_id = p.capture_id AND r.frame BETWEEN p.s AND p.e),
    sampled AS (SELECT * FROM strided UNION ALL SELECT * FROM held)
    SELECT capture_id, frame, substr(coalesce(a.name, b.name), 1, 1) || '_' || lpad(CAST(frame AS VARCHAR), 6, '0') || '.jpg' AS file,
      b.name IS NOT NULL AS rest
    FROM sampled a FULL JOIN rested b USING (capture_id, frame)""",
)
def frame_plan(spark, folder):
    spans = phases(spark, folder)
    shift = F.col("capture_id") % 10
    spans = spans.withColumn("start_frame", F.when(F.col("name") == "hold", 70 + shift).otherwise(F.col("start_frame")))
    spans = spans.withColumn("end_frame", F.when(F.col("name") == "hold", 99 + shift).otherwise(F.col("end_frame")))
    captures = spans.select("capture_id").distinct().select(
        "capture_id", F.lit(30.0).alias("fps"), (66 + shift).alias("rest_start"), (72 + shift).alias("rest_end")
    )
    return catalog.frame_plan(spans, captures, keyframes=8, arc_fps=6.0, static_fps=2.0)


NUMBERED = """numbered AS (SELECT user_id AS capture_id, event_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
    count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def event_line(stream):
    return Timeline.measure(stream, ["capture_id"], "t", ["event_id"])


@query(
    "top1_even_sample",
    f"""WITH {NUMBERED} SELECT capture_id, event_id, idx FROM numbered m WHERE n <= 20 OR EXISTS
      (SELECT 1 FROM range(0, 20) r(i) WHERE m.idx = CASE WHEN i = 19 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 19.0)) AS BIGINT) END)""",
)
def even_sample(spark, folder):
    stream = events(spark, folder).select("capture_id", "event_id", "t")
    return sampling.even_sample(stream, event_line(stream), 20).drop("t")


@query(
    "top2_phase_sample",
    f"""WITH {PHASES}
    SELECT capture_id, name, unnest(list_distinct(list_concat(range(start_frame, end_frame + 1, 5), [end_frame]))) AS frame, 'stride' AS how
    FROM phases_v
    UNION ALL SELECT DISTINCT capture_id, name, CAST(round_even(start_frame + i * ((end_frame - start_frame) / 7.0), 0) AS BIGINT), 'even'
    FROM phases_v, range(0, 8) r(i)""",
)
def phase_sample(spark, folder):
    spans = phases(spark, folder)
    start, end = F.col("start_frame"), F.col("end_frame")
    thin = spans.select("capture_id", "name", F.explode(sampling.phase_sample(start, end, F.lit(30.0), 6.0)).alias("frame"), F.lit("stride").alias("how"))
    even = spans.select("capture_id", "name", F.explode(sampling.evenly_spaced(start, end, 8)).alias("frame"), F.lit("even").alias("how"))
    return thin.unionByName(even)


@query(
    "top3_probe_points",
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey
        ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS rn,
        count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
    picks AS (SELECT DISTINCT s.l_suppkey, CASE WHEN i = 99 THEN n - 1 ELSE CAST(round_even(i * ((n - 1) / CAST(99 AS DOUBLE)), 0) AS BIGINT) END AS rn
      FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) s, range(0, 100) r(i))
    SELECT b.l_suppkey, b.l_orderkey, b.l_linenumber, b.l_partkey, b.l_extendedprice FROM b
    WHERE n <= 100 OR EXISTS (SELECT 1 FROM picks p WHERE p.l_suppkey = b.l_suppkey AND p.rn = b.rn)""",
)
def probe_points(spark, folder):
    items = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    line = Timeline.measure(items, ["l_suppkey"], "l_orderkey", ["l_linenumber", "l_partkey", "l_extendedprice"])
    return sampling.probe_points(items, line, 100)


@query(
    "top4_holdout_split",
    f"""WITH {NUMBERED} SELECT capture_id, event_id, idx,
      n >= 16 AND idx % 8 = 0 AND idx > 0 AND idx < n - 1 AS held_out FROM numbered""",
)
def holdout_split(spark, folder):
    stream = events(spark, folder).select("capture_id", "event_id", "t")
    return sampling.holdout_split(stream, event_line(stream)).drop("t")


@query(
    "top10_quota_budget",
    f"WITH {NUMBERED} SELECT capture_id, event_id FROM numbered WHERE idx < 40",
)
def quota_budget(spark, folder):
    stream = events(spark, folder).select("capture_id", "event_id", "t")
    return sampling.quota_budget(stream, event_line(stream), 40).drop("t")


@query(
    "flt7_frames_in_range",
    """SELECT o_orderkey AS frame, o_custkey AS capture_id, o_orderpriority AS file FROM orders
    WHERE o_orderstatus <> 'P' AND o_orderpriority IS NOT NULL AND o_orderkey BETWEEN 1000 AND 9000""",
)
def frames_in_range(spark, folder):
    from rushlight.operators.frames import frames_in_range as pick

    index = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("frame"), F.col("o_custkey").alias("capture_id"),
        F.col("o_orderpriority").alias("file"), (F.col("o_orderstatus") != "P").alias("used"),
    )
    return pick(index, 1000, 9000).drop("used")
