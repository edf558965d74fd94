"""Time, interval and key joins between capture tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushlight.plans.sizing import small
from rushlight.plans.timeline import Timeline


def _bracket(
    frames: DataFrame, samples: DataFrame, capture: str, t: str, values: list[str], limit: int | None
) -> DataFrame:
    """Frames with the sample at or before (``_prev``) and at or after (``_next``) their time.

    Both streams are stacked and walked in both directions, so the join is one shuffle on the
    capture with no range comparison, and a hot capture is cut into blocks by the timeline.
    """
    payload = [c for c in frames.columns if c not in (capture, t)]
    left = frames.select(capture, t, F.lit(1).alias("_kind"), F.struct(*payload).alias("_row")) if payload else frames.select(
        capture, t, F.lit(1).alias("_kind")
    )
    right = samples.select(
        capture, t, F.lit(0).alias("_kind"), F.struct(F.col(t).alias("t"), *values).alias("_sample")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    line = Timeline.measure(both, [capture], t, ["_kind"], limit=limit)
    walked = line.running(both, {"_prev": ("last", F.col("_sample"))})
    walked = line.reversed().running(walked, {"_next": ("last", F.col("_sample"))})
    kept = walked.filter(F.col("_kind") == 1)
    return kept.select(capture, t, *([F.col("_row.*")] if payload else []), "_prev", "_next")


def interp_join(
    frames: DataFrame, samples: DataFrame, capture: str, t: str, values: list[str], limit: int | None = None
) -> DataFrame:
    """Linearly interpolate ``values`` at every frame time inside its capture's sample span.

    Frames outside the span are left out, never clamped.
    """
    found = _bracket(frames, samples, capture, t, values, limit)
    found = found.filter(F.col("_prev").isNotNull() & F.col("_next").isNotNull())
    span = (F.col("_next.t") - F.col("_prev.t")).cast("double")
    share = F.when(span > 0, (F.col(t) - F.col("_prev.t")) / span).otherwise(F.lit(0.0))
    made = [
        (F.col(f"_prev.{v}") + (F.col(f"_next.{v}") - F.col(f"_prev.{v}")) * share).alias(v) for v in values
    ]
    return found.select(*[c for c in found.columns if c not in ("_prev", "_next")], *made)


def nearest_join(
    frames: DataFrame,
    samples: DataFrame,
    capture: str,
    t: str,
    values: list[str],
    tolerance: int,
    offset: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Pair each frame with the nearest sample within ``tolerance`` of its time.

    ``offset`` names a samples column with the clock offset to add before times are compared.
    The earlier sample wins a tie.
    """
    if offset:
        samples = samples.withColumn(t, F.col(t) + F.col(offset))
    found = _bracket(frames, samples, capture, t, values, limit)
    back = F.col(t) - F.col("_prev.t")
    ahead = F.col("_next.t") - F.col(t)
    pick = F.when(F.col("_next").isNull() | (back <= ahead), F.col("_prev")).otherwise(F.col("_next"))
    return (
        found.withColumn("_pick", pick)
        .withColumn("delta", F.abs(F.col(t) - F.col("_pick.t")))
        .filter(F.col("delta") <= tolerance)
        .select(
            *[c for c in found.columns if c not in ("_prev", "_next")],
            F.col("_pick.t").alias("sample_t"),
            "delta",
            *[F.col(f"_pick.{v}").alias(v) for v in values],
        )
    )


def frame_count_drift(frames: DataFrame, video_frames: DataFrame, capture: str) -> DataFrame:
    """Rows in the metadata log against frames in the video, per capture."""
    logged = frames.groupBy(capture).agg(F.count(F.lit(1)).alias("logged"))
    return logged.join(video_frames, capture, "full_outer").select(
        capture, "logged", "video_frames", (F.col("logged") - F.col("video_frames")).alias("drift")
    )


def frame_timestamps(index: DataFrame, frames: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Recorded time of every extracted frame file, by video frame number.

    ``index``: capture, file, timestamp_sec, fps. ``frames``: capture, frame, t_ns (unique).
    """
    number = F.rint(F.col("timestamp_sec") * F.col("fps")).cast("long")
    wanted = index.filter((F.col("fps") > 0) & F.col("timestamp_sec").isNotNull()).select(
        capture, F.element_at(F.split("file", "/"), -1).alias("name"), number.alias("frame")
    )
    return wanted.join(frames.select(capture, "frame", "t_ns"), [capture, "frame"])


# Recording order of the phases and their file-name letters.
PHASE_ORDER = ("perch", "arc", "reseat", "hold")
PHASE_PREFIX = {"perch": "p", "arc": "a", "reseat": "r", "hold": "h"}


def phase_rank(name: Column) -> Column:
    rank = F.when(name == PHASE_ORDER[0], 0)
    for i, phase in enumerate(PHASE_ORDER[1:], 1):
        rank = rank.when(name == phase, i)
    return rank


def phase_of(frames: DataFrame, phases: DataFrame, capture: str, frame: str) -> DataFrame:
    """Attach the first phase, in recording order, whose inclusive span holds the frame.

    Spans are gathered per capture (one per phase name), so the join never multiplies rows.
    """
    spans = phases.groupBy(capture).agg(
        F.array_sort(
            F.collect_set(F.struct(phase_rank(F.col("name")).alias("rank"), "name", "start_frame", "end_frame"))
        ).alias("_spans")
    )
    joined = frames.join(small(spans), capture, "left")
    inside = F.filter(
        "_spans", lambda s: (F.col(frame) >= s["start_frame"]) & (F.col(frame) <= s["end_frame"])
    )
    return joined.withColumn("phase", F.try_element_at(inside, F.lit(1))["name"]).drop("_spans")


def phase_durations(phases: DataFrame, fps: str = "fps") -> DataFrame:
    count = F.col("end_frame") - F.col("start_frame") + 1
    return phases.withColumn("frame_count", count).withColumn(
        "duration_sec", F.when(F.col(fps) > 0, count / F.col(fps)).otherwise(F.lit(0.0))
    )


def new_captures(remote: DataFrame, known_sessions: DataFrame, known_names: DataFrame) -> DataFrame:
    """Usable remote captures not imported yet: by session id, or by name where there is none.

    ``remote``: name, session_id (nullable), usable. The branches are split because an anti
    join keeps every row whose key is NULL.
    """
    usable = remote.filter("usable")
    with_id = usable.filter(F.col("session_id").isNotNull()).join(
        small(known_sessions.select("session_id").distinct()), "session_id", "left_anti"
    )
    without = usable.filter(F.col("session_id").isNull()).join(
        small(known_names.select("name").distinct()), "name", "left_anti"
    )
    return with_id.unionByName(without)


REGISTERED_STATES = ("good", "warning")  # Fixed values.
ERROR_LENGTH = 300  # Fixed value.


def collect_run_record(
    captures: DataFrame, telemetry: DataFrame, frames: DataFrame, pose: DataFrame, capture: str = "capture_id"
) -> DataFrame:
    """One row per capture from three per-capture tables; a missing side is data, not a failure."""
    joined = captures.join(telemetry, capture, "left").join(frames, capture, "left").join(pose, capture, "left")
    joined = joined.withColumn("pose_status", F.coalesce("pose_status", F.lit("not_run"))).withColumn(
        "registered", F.col("pose_status").isin(*REGISTERED_STATES)
    )
    if "error" in joined.columns:
        joined = joined.withColumn("error", F.substring("error", 1, ERROR_LENGTH))
    return joined
