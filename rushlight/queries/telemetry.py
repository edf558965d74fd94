"""Telemetry queries on the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushlight.operators import robust, telemetry
from rushlight.plans.quantiles import average_rank
from rushlight.plans.timeline import Timeline
from rushlight.queries.registry import query
from rushlight.queries.views import EVENTS, SIGNALS, events, rounded, signals
from rushlight.session import table

RELATIVE = (
    SIGNALS
    + """,
rolled AS (
  SELECT *, quantile_cont(blur_vol, 0.5) OVER w AS mid, count(blur_vol) OVER w AS seen
  FROM signals_v
  WINDOW w AS (PARTITION BY capture_id ORDER BY t, event_id ROWS BETWEEN 30 PRECEDING AND CURRENT ROW)),
relative_v AS (
  SELECT *, CASE WHEN seen >= 9 AND mid > 0 THEN blur_vol / mid ELSE 1.0 END AS blur_relative,
         seen >= 9 AS blur_ready
  FROM rolled)"""
)

REPORT = (
    RELATIVE
    + """,
report_v AS (
  SELECT capture_id, count(*) AS frame_count, avg(blur_vol) AS vol_mean,
    quantile_cont(blur_vol, 0.1) AS vol_p10, quantile_cont(blur_vol, 0.5) AS vol_median,
    avg(CASE WHEN blur_relative < 0.6 THEN 1.0 ELSE 0.0 END) AS blurry_frame_ratio,
    avg(brightness) AS brightness_mean, avg(overexposed_ratio) AS overexposed_ratio,
    avg(underexposed_ratio) AS underexposed_ratio,
    avg(CASE WHEN brightness < 45 THEN 1.0 ELSE 0.0 END) AS too_dark_ratio,
    avg(CASE WHEN brightness > 220 OR overexposed_ratio > 0.12 THEN 1.0 ELSE 0.0 END) AS too_bright_ratio,
    coalesce(avg(motion_diff), 0.0) AS motion_mean,
    coalesce(avg(CASE WHEN motion_diff > 35 THEN 1.0 WHEN motion_diff <= 35 THEN 0.0 END), 0.0) AS too_fast_ratio,
    count(CASE WHEN hist_correlation > 0.992 AND coalesce(motion_diff, 0.0) < 2 THEN 1 END)
      / CAST(greatest(1, count(*) - 1) AS DOUBLE) AS duplicate_ratio
  FROM relative_v GROUP BY capture_id)"""
)

SCORED = (
    REPORT
    + """,
scored AS (
  SELECT *, CAST(greatest(0, least(100, 100 - CAST(trunc(blurry_frame_ratio * 35) AS INT)
    - CAST(trunc(too_dark_ratio * 30) AS INT) - CAST(trunc(too_fast_ratio * 25) AS INT)
    - CAST(trunc(too_bright_ratio * 20) AS INT) - CAST(trunc(duplicate_ratio * 20) AS INT) - 10)) AS INT) AS score
  FROM report_v)"""
)


def relative(spark, folder):
    return measured(spark, folder)[0]


def measured(spark, folder):
    """Frames with their relative blur, and the timeline they were measured with."""
    frames = signals(spark, folder)
    line = Timeline.measure(frames, ["capture_id"], "t", ["event_id"])
    return telemetry.rolling_relative(frames, line, "blur_vol"), line


def report(spark, folder):
    frames, line = measured(spark, folder)
    return telemetry.telemetry_report(frames, line=line)


@query(
    "win1_rolling_relative",
    f"WITH {RELATIVE} SELECT event_id, round(blur_relative, 6) AS blur_relative, blur_ready FROM relative_v",
)
def rolling_relative(spark, folder):
    return rounded(relative(spark, folder).select("event_id", "blur_relative", "blur_ready"))


RATIOS = (
    "vol_mean vol_p10 vol_median blurry_frame_ratio brightness_mean overexposed_ratio underexposed_ratio "
    "too_dark_ratio too_bright_ratio motion_mean too_fast_ratio duplicate_ratio"
).split()


@query(
    "agg3_telemetry_report",
    f"WITH {REPORT} SELECT capture_id, frame_count, " + ", ".join(f"round({r}, 6) AS {r}" for r in RATIOS) + " FROM report_v",
)
def telemetry_report(spark, folder):
    return rounded(report(spark, folder))


@query(
    "agg4_score_report",
    f"""WITH {SCORED}
    SELECT capture_id, score, CASE WHEN score >= 75 THEN 'good' WHEN score >= 45 THEN 'warning' ELSE 'bad' END AS status,
      2 + CAST(blurry_frame_ratio > 0.15 AS INT) + CAST(too_dark_ratio > 0.10 AS INT)
        + CAST(too_bright_ratio > 0.10 AS INT) + CAST(too_fast_ratio > 0.12 AS INT)
        + CAST(duplicate_ratio > 0.25 AS INT) AS n_warnings
    FROM scored""",
)
def score_report(spark, folder):
    scored = telemetry.score_report(report(spark, folder))
    return scored.select("capture_id", "score", "status", F.size("warnings").alias("n_warnings"))


@query(
    "flagship_captures_at_risk",
    f"""WITH {SCORED}
    SELECT capture_id, frame_count, score, round(vol_median, 6) AS vol_median,
      round(blurry_frame_ratio, 6) AS blurry_frame_ratio, round(too_fast_ratio, 6) AS too_fast_ratio,
      CASE WHEN score >= 75 THEN 'good' WHEN score >= 45 THEN 'warning' ELSE 'bad' END AS status,
      array_to_string(list_filter([
        CASE WHEN too_dark_ratio > 0.10 THEN 'Add brighter, more even lighting.' END,
        CASE WHEN too_fast_ratio > 0.12 THEN 'Capture with a slow, continuous orbit.' END,
        CASE WHEN duplicate_ratio > 0.25 THEN 'Keep moving; near-identical frames add no parallax.' END,
        'Lock exposure before starting the capture.', 'Lock white balance before starting the capture.',
        CASE WHEN blurry_frame_ratio > 0.15 THEN 'Move more slowly and avoid sudden turns.' END,
        CASE WHEN too_bright_ratio > 0.10 THEN 'Reduce exposure so bright surfaces retain detail.' END
      ], lambda x: x IS NOT NULL), '|') AS recommendations
    FROM scored""",
)
def captures_at_risk(spark, folder):
    scored = telemetry.score_report(report(spark, folder))
    return rounded(
        scored.select(
            "capture_id", "frame_count", "score", "vol_median", "blurry_frame_ratio", "too_fast_ratio", "status",
            F.concat_ws("|", "recommendations").alias("recommendations"),
        )
    ).orderBy("score", "capture_id")


@query(
    "agg5_robust_sigma",
    """SELECT user_id AS capture_id, round(1.4826 * mad(value), 6) AS sigma FROM events GROUP BY user_id""",
)
def robust_sigma(spark, folder):
    return rounded(robust.robust_sigma(events(spark, folder), ["capture_id"], "value"))


@query(
    "flt3_finite_pairs",
    """SELECT d.doc_id, CAST(n_chars AS DOUBLE) AS n_chars, CAST(quality AS DOUBLE) AS quality
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE n_chars IS NOT NULL AND quality IS NOT NULL""",
)
def finite_pairs(spark, folder):
    both = table(spark, folder, "documents").select("doc_id", "n_chars").join(
        table(spark, folder, "labels").select("doc_id", "quality"), "doc_id"
    )
    return robust.finite_pairs(both, "n_chars", "quality")


@query(
    "flt5_stationary",
    f"""WITH {EVENTS}, m AS (SELECT capture_id, quantile_cont(value, 0.5) AS mid FROM events_v GROUP BY capture_id)
    SELECT event_id, capture_id, value FROM events_v JOIN m USING (capture_id)
    WHERE abs(mid - 35.0) <= 5.0 AND abs(value - mid) <= 15.0 AND value <> 0""",
)
def stationary(spark, folder):
    kept = robust.stationary(
        events(spark, folder), "capture_id", "value", gravity=35.0, capture_tolerance=5.0, sample_tolerance=15.0
    )
    return kept.select("event_id", "capture_id", "value")


@query(
    "win2_average_rank",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity,
      rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity)
        + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS rank
    FROM lineitem""",
)
def average_ranks(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return average_rank(items, ["l_suppkey"], "l_quantity").drop("l_suppkey")
