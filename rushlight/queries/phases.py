"""Phase inference on the event stream: one user is one capture, one event one frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushlight.operators import phases as ph
from rushlight.plans.timeline import Timeline
from rushlight.queries.registry import query
from rushlight.queries.views import EVENTS, events, rounded
from rushlight.session import table

PROFILE = (
    EVENTS
    + """,
profile_v AS (SELECT capture_id, event_id, row_number() OVER (PARTITION BY capture_id ORDER BY t, event_id) - 1 AS frame, least(value / 100, 1.0) AS changed_fraction FROM events_v)"""
)


def profile(spark, folder):
    stream = events(spark, folder)
    line = Timeline.measure(stream, ["capture_id"], "t", ["event_id"])
    rows = line.number(stream, "_rn").select(
        "capture_id", "event_id", (F.col("_rn") - 1).alias("frame"), F.least(F.col("value") / 100, F.lit(1.0)).alias("changed_fraction")
    )
    frames = Timeline(("capture_id",), "frame") if not line.splits else Timeline.measure(rows, ["capture_id"], "frame")
    return rows, frames


SMOOTH = """flag_v AS (SELECT *, changed_fraction > 0.25 AS moving, count(*) OVER (PARTITION BY capture_id) AS n FROM profile_v),
votes_v AS (SELECT *, CASE WHEN n < 5 THEN moving ELSE (CAST(moving AS INT)
    + CAST(coalesce(lag(moving, 1) OVER w, first_value(moving) OVER a) AS INT) + CAST(coalesce(lag(moving, 2) OVER w, first_value(moving) OVER a) AS INT)
    + CAST(coalesce(lead(moving, 1) OVER w, last_value(moving) OVER a) AS INT) + CAST(coalesce(lead(moving, 2) OVER w, last_value(moving) OVER a) AS INT)) > 2 END AS smooth
  FROM flag_v WINDOW w AS (PARTITION BY capture_id ORDER BY frame),
    a AS (PARTITION BY capture_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
change_v AS (SELECT *, CASE WHEN smooth = lag(smooth) OVER w THEN 0 ELSE 1 END AS step FROM votes_v WINDOW w AS (PARTITION BY capture_id ORDER BY frame)),
run_v AS (SELECT *, sum(step) OVER (PARTITION BY capture_id ORDER BY frame) AS island FROM change_v),
runs_v AS (SELECT capture_id, CAST(island AS BIGINT) AS island, smooth, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS length FROM run_v GROUP BY ALL)"""


@query("win4_smooth_flags", f"WITH {PROFILE}, {SMOOTH} SELECT event_id, moving, smooth FROM votes_v")
def smooth_flags(spark, folder):
    rows, line = profile(spark, folder)
    made = ph.smooth_flags(rows.withColumn("moving", F.col("changed_fraction") > 0.25), line, "moving")
    return made.select("event_id", "moving", "smooth")


@query("win5_runs", f"WITH {PROFILE}, {SMOOTH} SELECT * FROM runs_v")
def runs(spark, folder):
    rows, line = profile(spark, folder)
    made = ph.smooth_flags(rows.withColumn("moving", F.col("changed_fraction") > 0.25), line, "moving")
    return ph.runs(made, line, "smooth", "frame")


INFERRED = """size_v AS (SELECT capture_id, count(*) AS frames FROM profile_v GROUP BY 1),
arc_v AS (SELECT capture_id, max((length, -start_frame, end_frame)) AS b FROM runs_v WHERE smooth AND length >= 5 GROUP BY 1),
judged_v AS (SELECT capture_id, frames, -b[2] AS arc_start, b[3] AS arc_end,
    CASE WHEN frames < 9 THEN 'too_short' WHEN b IS NULL THEN 'no_sweep' WHEN b[3] >= frames - 4 THEN 'still_moving' END AS refused
  FROM size_v LEFT JOIN arc_v USING (capture_id)),
tail_v AS (SELECT p.* FROM profile_v p JOIN judged_v j USING (capture_id) WHERE refused IS NULL AND frame > arc_end),
limit_v AS (SELECT capture_id, greatest(median(changed_fraction) + 4.0 * CAST(1.4826 AS DOUBLE) * mad(changed_fraction), 0.004) AS threshold FROM tail_v GROUP BY 1),
hot_v AS (SELECT t.*, changed_fraction > threshold AS hot, lead(changed_fraction > threshold) OVER (PARTITION BY t.capture_id ORDER BY frame) AS nxt FROM tail_v t JOIN limit_v l ON t.capture_id = l.capture_id),
subject_v AS (SELECT capture_id, min(frame) AS subject FROM hot_v WHERE hot AND nxt GROUP BY 1),
split_v AS (SELECT j.*, threshold, subject IS NOT NULL AND subject <= frames - 4 AS found, CASE WHEN subject IS NOT NULL AND subject <= frames - 4 THEN subject ELSE arc_end + 1 END AS hold
  FROM judged_v j LEFT JOIN subject_v s ON j.capture_id = s.capture_id LEFT JOIN limit_v l ON j.capture_id = l.capture_id),
phase_v AS (SELECT capture_id, frames, refused, CASE WHEN refused IS NULL AND arc_start > 0 THEN 0 END AS perch_start, CASE WHEN refused IS NULL AND arc_start > 0 THEN arc_start - 1 END AS perch_end,
    CASE WHEN refused IS NULL THEN arc_start END AS arc_start, CASE WHEN refused IS NULL THEN arc_end END AS arc_end,
    CASE WHEN refused IS NULL AND hold > arc_end + 1 THEN arc_end + 1 END AS reseat_start, CASE WHEN refused IS NULL AND hold > arc_end + 1 THEN hold - 1 END AS reseat_end,
    CASE WHEN refused IS NULL THEN hold END AS hold_start, CASE WHEN refused IS NULL THEN frames - 1 END AS hold_end, threshold,
    CASE WHEN refused IS NULL THEN concat_ws('|', 'inferred', CASE WHEN arc_start = 0 THEN 'no_perch' END, CASE WHEN NOT found THEN 'no_subject_motion' END) END AS warnings FROM split_v)"""


def inferred(spark, folder):
    rows, line = profile(spark, folder)
    return rows, ph.infer_phases(rows, line, moving_fraction=0.25, min_arc=5)


@query("win6_infer_phases", f"WITH {PROFILE}, {SMOOTH}, {INFERRED} SELECT * REPLACE (round(threshold, 6) AS threshold) FROM phase_v")
def infer_phases(spark, folder):
    return rounded(inferred(spark, folder)[1])


@query(
    "win7_rest_window",
    f"""WITH {PROFILE}, {SMOOTH}, {INFERRED},
    loud AS (SELECT p.capture_id, max(p.frame) AS loud FROM profile_v p JOIN phase_v h ON p.capture_id = h.capture_id
      WHERE p.frame BETWEEN reseat_start AND reseat_end AND changed_fraction > threshold GROUP BY 1),
    q AS (SELECT h.*, greatest(reseat_start, coalesce(loud + 1, reseat_start)) AS quiet FROM phase_v h LEFT JOIN loud USING (capture_id)),
    w AS (SELECT *, reseat_start IS NOT NULL AND reseat_end - quiet + 1 >= 3 AS tail, hold_start IS NOT NULL AND hold_end - hold_start + 1 >= 3 AS head FROM q)
    SELECT capture_id, CASE WHEN tail THEN greatest(quiet, reseat_end - 6 + 1) WHEN head THEN hold_start END AS rest_start,
      CASE WHEN tail THEN reseat_end WHEN head THEN least(hold_end, hold_start + 5) END AS rest_end,
      CASE WHEN tail THEN 'reseat_tail' WHEN head THEN 'hold_head' ELSE 'missing' END AS rest_source FROM w""",
)
def rest_window(spark, folder):
    rows, found = inferred(spark, folder)
    return ph.rest_window(rows, found.withColumn("fps", F.lit(12.0)))


@query(
    "win18_normalised_time",
    """SELECT o_orderkey, round((o_orderkey - min(o_orderkey) OVER w) / CAST(greatest(max(o_orderkey) OVER w - min(o_orderkey) OVER w, 1) AS DOUBLE), 9) AS time
    FROM orders WINDOW w AS (PARTITION BY o_custkey)""",
)
def normalised_time(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("capture_id"), "o_orderkey")
    return rounded(ph.normalised_time(rows, "capture_id", "o_orderkey").select("o_orderkey", "time"), 9)


@query(
    "win18_time_issues",
    """WITH t AS (SELECT o_custkey AS capture_id, o_orderkey, (o_totalprice - min(o_totalprice) OVER w) / greatest(max(o_totalprice) OVER w - min(o_totalprice) OVER w, 1) AS time
      FROM orders WINDOW w AS (PARTITION BY o_custkey)),
    b AS (SELECT *, lag(time) OVER (PARTITION BY capture_id ORDER BY o_orderkey) AS before FROM t),
    j AS (SELECT capture_id, arg_min(time, o_orderkey) AS first_time, arg_max(time, o_orderkey) AS last_time, count(CASE WHEN time <= before THEN 1 END) AS steps_back FROM b GROUP BY 1)
    SELECT capture_id, round(first_time, 9) AS first_time, round(last_time, 9) AS last_time, steps_back FROM j WHERE first_time <> 0 OR abs(last_time - 1) > 1e-9 OR steps_back > 0""",
)
def time_issues(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("capture_id"), "o_orderkey", "o_totalprice")
    timed = ph.normalised_time(rows, "capture_id", "o_totalprice")
    line = Timeline.measure(rows, ["capture_id"], "o_orderkey")
    return rounded(ph.time_issues(timed, line), 9)
