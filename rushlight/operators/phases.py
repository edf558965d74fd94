"""Recording phases inferred from image change, and times within the hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rushlight.operators.robust import MAD_TO_SIGMA, median_and_mad
from rushlight.plans.sizing import settle, small
from rushlight.plans.timeline import Timeline

# Fixed values.
SMOOTH_WIDTH = 5
MOVING_FRACTION = 0.30
MIN_ARC_FRAMES = 8
MIN_HOLD_FRAMES = 4
MIN_SUBJECT_FRACTION = 0.004
SUBJECT_SIGMAS = 4.0
MIN_REST_FRAMES = 3
MAX_REST_SECONDS = 0.5
DEFAULT_FPS = 30.0


def smooth_flags(frames: DataFrame, line: Timeline, flag: str, name: str = "smooth", width: int = SMOOTH_WIDTH) -> DataFrame:
    """Median of ``width`` flags, the ends repeated; a shorter capture is left as it is."""
    half = width // 2
    keys = list(line.keys)
    order = F.struct(F.col(line.axis), *[F.col(t) for t in line.ties])
    ends = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(flag, order).alias("_first"), F.max_by(flag, order).alias("_last")
    )
    marked = frames.withColumn("_f", F.col(flag).cast("int"))

    def build(ordered, framed):
        back = [F.coalesce(F.lag("_f", i).over(ordered), F.lit(-1)) for i in range(1, half + 1)]
        ahead = [F.coalesce(F.lead("_f", i).over(ordered), F.lit(-1)) for i in range(1, half + 1)]
        return {
            "_sum": F.sum("_f").over(framed),
            "_lost_back": sum((F.when(b < 0, 1).otherwise(0) for b in back[1:]), F.when(back[0] < 0, 1).otherwise(0)),
            "_lost_ahead": sum((F.when(a < 0, 1).otherwise(0) for a in ahead[1:]), F.when(ahead[0] < 0, 1).otherwise(0)),
        }

    rolled = line.rolling(marked, half, half, build).join(small(ends), keys)
    votes = (
        F.col("_sum")
        + F.col("_lost_back") * F.col("_first").cast("int")
        + F.col("_lost_ahead") * F.col("_last").cast("int")
    )
    value = F.when(F.col("_n") < width, F.col(flag)).otherwise(votes > half)
    return rolled.withColumn(name, value).drop("_f", "_sum", "_lost_back", "_lost_ahead", "_n", "_first", "_last")


def runs(frames: DataFrame, line: Timeline, flag: str, frame: str) -> DataFrame:
    """Maximal runs of one flag value: start, end and length."""
    marked = line.islands(frames, F.col(flag))
    return marked.groupBy(*line.keys, "island", flag).agg(
        F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"), F.count(F.lit(1)).alias("length")
    )


def subject_threshold(tail: DataFrame, capture: str, change: str, fits: bool | None = None) -> DataFrame:
    """Change above which something moved in a still frame: robust, with a floor."""
    robust = median_and_mad(tail, [capture], change, fits=fits)
    raised = F.col("median") + SUBJECT_SIGMAS * MAD_TO_SIGMA * F.col("mad")
    return robust.select(capture, F.greatest(raised, F.lit(MIN_SUBJECT_FRACTION)).alias("threshold"))


def infer_phases(
    profile: DataFrame,
    line: Timeline,
    capture: str = "capture_id",
    change: str = "changed_fraction",
    frame: str = "frame",
    moving_fraction: float = MOVING_FRACTION,
    min_arc: int = MIN_ARC_FRAMES,
    min_hold: int = MIN_HOLD_FRAMES,
) -> DataFrame:
    """Phase bounds per capture from its change profile (frames numbered from 0).

    One row per capture with inclusive bounds, NULL for a missing phase, ``warnings``, and
    ``refused`` naming the reason when no split exists.
    """
    c = F.col
    flagged = profile.withColumn("_moving", c(change) > moving_fraction)
    smooth = smooth_flags(flagged, line, "_moving", "_smooth")
    sizes = profile.groupBy(capture).agg(F.count(F.lit(1)).alias("frames"))
    sweeps = runs(smooth, line, "_smooth", frame).filter(c("_smooth") & (c("length") >= min_arc))
    # the longest sweep, the first on ties
    arcs = sweeps.groupBy(capture).agg(
        F.max(F.struct("length", (-c("start_frame")).alias("_s"), "end_frame")).alias("_a")
    ).select(capture, (-c("_a._s")).alias("arc_start"), c("_a.end_frame").alias("arc_end"))
    judged = sizes.join(arcs, capture, "left").withColumn(
        "refused",
        F.when(c("frames") < min_arc + min_hold, "too_short")
        .when(c("arc_start").isNull(), "no_sweep")
        .when(c("arc_end") >= c("frames") - min_hold, "still_moving"),
    )
    judged = settle(judged)  # one row per capture, used three times below
    split = judged.filter(c("refused").isNull())
    tail = profile.select(capture, frame, change, *[t for t in line.ties if t not in (capture, frame, change)]).join(
        small(split.select(capture, "arc_end")), capture
    ).filter(c(frame) > c("arc_end"))
    limits = settle(subject_threshold(tail, capture, change, line.fits or None))
    hot = tail.join(small(limits), capture).withColumn("_hot", c(change) > c("threshold"))
    paired = line.rolling(hot, 0, 1, lambda ordered, _: {"_next": F.lead("_hot").over(ordered)})
    starts = paired.filter(c("_hot") & c("_next")).groupBy(capture).agg(F.min(frame).alias("_subject"))
    whole = judged.join(starts, capture, "left").join(limits.select(capture, "threshold"), capture, "left")
    found = c("_subject").isNotNull() & (c("_subject") <= c("frames") - min_hold)
    hold = F.when(found, c("_subject")).otherwise(c("arc_end") + 1)
    good = c("refused").isNull()
    warned = F.array_compact(
        F.array(F.lit("inferred"), F.when(c("arc_start") == 0, "no_perch"), F.when(~found, "no_subject_motion"))
    )
    return whole.withColumn("_hold", hold).select(
        capture,
        "frames",
        "refused",
        F.when(good & (c("arc_start") > 0), F.lit(0)).alias("perch_start"),
        F.when(good & (c("arc_start") > 0), c("arc_start") - 1).alias("perch_end"),
        F.when(good, c("arc_start")).alias("arc_start"),
        F.when(good, c("arc_end")).alias("arc_end"),
        F.when(good & (c("_hold") > c("arc_end") + 1), c("arc_end") + 1).alias("reseat_start"),
        F.when(good & (c("_hold") > c("arc_end") + 1), c("_hold") - 1).alias("reseat_end"),
        F.when(good, c("_hold")).alias("hold_start"),
        F.when(good, c("frames") - 1).alias("hold_end"),
        F.when(good, c("threshold")).alias("threshold"),
        F.when(good, F.concat_ws("|", warned)).alias("warnings"),
    )


def rest_window(
    profile: DataFrame, phases: DataFrame, capture: str = "capture_id", change: str = "changed_fraction", frame: str = "frame", fps: str = "fps"
) -> DataFrame:
    """The still span before the subject moves: quiet tail of the reseat, else head of the hold.

    ``phases``: capture, reseat_start, reseat_end, hold_start, hold_end, threshold, fps.
    """
    c = F.col
    longest = F.greatest(
        F.lit(MIN_REST_FRAMES),
        F.rint(F.coalesce(F.when(c(fps) > 0, c(fps).cast("double")), F.lit(DEFAULT_FPS)) * MAX_REST_SECONDS).cast("int"),
    )
    inside = profile.select(capture, frame, change).join(
        small(phases.select(capture, "reseat_start", "reseat_end", "threshold")), capture
    ).filter(c(frame).between(c("reseat_start"), c("reseat_end")))
    # the quiet tail starts after the last frame that is not quiet
    loud = inside.groupBy(capture).agg(F.max(F.when(c(change) > c("threshold"), c(frame))).alias("_loud"))
    joined = phases.join(loud, capture, "left")
    quiet_from = F.greatest(c("reseat_start"), F.coalesce(c("_loud") + 1, c("reseat_start")))
    tail_start = F.greatest(quiet_from, c("reseat_end") - longest + 1)
    in_tail = c("reseat_start").isNotNull() & (c("reseat_end") - quiet_from + 1 >= MIN_REST_FRAMES)
    in_head = c("hold_start").isNotNull() & (c("hold_end") - c("hold_start") + 1 >= MIN_REST_FRAMES)
    return joined.select(
        capture,
        F.when(in_tail, tail_start).when(in_head, c("hold_start")).alias("rest_start"),
        F.when(in_tail, c("reseat_end"))
        .when(in_head, F.least(c("hold_end"), c("hold_start") + longest - 1))
        .alias("rest_end"),
        F.when(in_tail, "reseat_tail").when(in_head, "hold_head").otherwise("missing").alias("rest_source"),
    )


def normalised_time(frames: DataFrame, capture: str, frame: str) -> DataFrame:
    """Position of each frame between the first and last of its capture, 0 to 1."""
    ends = frames.groupBy(capture).agg(F.min(frame).alias("_lo"), F.max(frame).alias("_hi"))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1))
    return frames.join(small(ends), capture).withColumn("time", (F.col(frame) - F.col("_lo")) / span).drop("_lo", "_hi")


def time_issues(frames: DataFrame, line: Timeline, time: str = "time") -> DataFrame:
    """Captures whose times do not run from 0 to 1, strictly rising in the order of the line."""
    keys = list(line.keys)
    order = F.struct(F.col(line.axis), *[F.col(t) for t in line.ties])
    stepped = line.rolling(frames, 1, 0, lambda ordered, _: {"_before": F.lag(time).over(ordered)})
    judged = stepped.groupBy(*keys).agg(
        F.min_by(time, order).alias("first_time"),
        F.max_by(time, order).alias("last_time"),
        F.count_if(F.col(time) <= F.col("_before")).alias("steps_back"),
    )
    off = (F.col("first_time") != 0) | (F.abs(F.col("last_time") - 1) > 1e-9) | (F.col("steps_back") > 0)
    return judged.filter(off)
