"""Capture-level summaries: stages, registration, run tables, warnings, frame plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushlight.operators.joins import PHASE_PREFIX, phase_of
from rushlight.operators.sampling import evenly_spaced, phase_sample

# Stages in order, the artefact that proves each one, and the next command.
STAGES = ("none", "masked", "prepared", "packaged", "trained", "exported", "viewable")
STAGE_PATTERNS = {
    "masked": r"^masks/[^/]+\.png$",
    "prepared": r"^training/scene4d_init\.npz$",
    "packaged": r"^colab_export/dataset4d\.zip$",
    "trained": r"^training/scene4d\.npz$",
    "exported": r"^export/scene\.g4d$",
    "viewable": r"^export/viewer4d/index\.html$",
}
NEXT_COMMAND = {
    "none": "prep4d",
    "masked": "prep4d",
    "prepared": "colab4d",
    "packaged": "train4d",
    "trained": "export4d",
    "exported": "viewer4d",
}
GOOD_REGISTRATION = 0.75
WARNING_REGISTRATION = 0.35


def capture_stage(captures: DataFrame, files: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Furthest stage proved by the files present; a recorded status never decides."""
    reached = F.lit(0)
    for stage in STAGES[1:]:
        reached = F.when(F.col("path").rlike(STAGE_PATTERNS[stage]), STAGES.index(stage)).otherwise(reached)
    # later stages are tested last, so the outermost match is the furthest one
    best = files.groupBy(capture).agg(F.max(reached).alias("_stage"))
    names = F.array(*[F.lit(s) for s in STAGES])
    commands = F.array(*[F.lit(NEXT_COMMAND.get(s)) for s in STAGES])
    return (
        captures.select(capture)
        .join(best, capture, "left")
        .withColumn("_stage", F.coalesce("_stage", F.lit(0)))
        .select(
            capture,
            F.element_at(names, F.col("_stage") + 1).alias("stage"),
            F.element_at(commands, F.col("_stage") + 1).alias("next_command"),
        )
    )


def registration_status(ratio: Column) -> Column:
    return (
        F.when(ratio >= GOOD_REGISTRATION, "good").when(ratio >= WARNING_REGISTRATION, "warning").otherwise("bad")
    )


def registration_summary(models: DataFrame, captures: DataFrame, capture: str = "capture_id") -> DataFrame:
    """The model with most registered images per capture, first in model order on ties.

    ``models``: capture, model_id, registered, points. ``captures``: capture, frames_total.
    A capture without a model is a bad row, not a failure.
    """
    best = models.groupBy(capture).agg(
        F.max(F.struct("registered", (-F.col("model_id")).alias("_order"), "points", "model_id")).alias("_best"),
        F.count(F.lit(1)).alias("models"),
    )
    joined = captures.join(best, capture, "left")
    registered = F.coalesce("_best.registered", F.lit(0))
    ratio = F.when(F.col("frames_total") > 0, registered / F.col("frames_total")).otherwise(F.lit(0.0))
    return joined.select(
        capture,
        F.col("_best.model_id").alias("model_id"),
        registered.alias("images_registered"),
        F.coalesce("_best.points", F.lit(0)).alias("sparse_points"),
        ratio.alias("registered_ratio"),
        F.coalesce("models", F.lit(0)).alias("models"),
        F.when(F.col("_best").isNull(), "bad").otherwise(registration_status(ratio)).alias("pose_status"),
        (F.coalesce("models", F.lit(0)) > 1).alias("disconnected"),
    )


def run_summary(rows: DataFrame) -> DataFrame:
    """Captures, registered and failed runs in one row."""
    return rows.agg(
        F.count(F.lit(1)).alias("captures"),
        F.count_if(F.coalesce("registered", F.lit(False))).alias("registered"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def result_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Selected columns with a status class per capture."""
    status = F.col("pose_status")
    return rows.select(
        *columns, F.when(status == "good", "ok").when(status == "warning", "warn").otherwise("bad").alias("status_class")
    )


def flatten_signals(rows: DataFrame, names: list[str], signals: str = "signals") -> DataFrame:
    """Map entries as flat ``signal_<name>`` columns."""
    return rows.select(
        *[c for c in rows.columns if c != signals],
        *[F.try_element_at(F.col(signals), F.lit(n)).alias(f"signal_{n}") for n in names],
    )


def merge_warnings(parts: list[DataFrame], capture: str = "capture_id") -> DataFrame:
    """Stack per-stage warnings keeping stage order; ``position`` numbers them per capture."""
    staged = [p.select(capture, "position", "warning", F.lit(i).alias("stage")) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, staged)


def advice_set(parts: list[DataFrame], capture: str = "capture_id") -> DataFrame:
    """Distinct recommendations of all stages."""
    return reduce(DataFrame.unionByName, [p.select(capture, "recommendation") for p in parts]).distinct()


def frame_plan(
    phases: DataFrame, captures: DataFrame, keyframes: int, arc_fps: float, static_fps: float, capture: str = "capture_id"
) -> DataFrame:
    """Which source frames enter the reconstruction, and under which name.

    ``captures``: capture, fps, rest_start, rest_end. Sampled phases come first in recording
    order, then the whole rest window; the first to claim a frame names it.
    """
    c = F.col
    spans = phases.join(captures.select(capture, "fps"), capture)
    fps = F.coalesce(F.when(c("fps") > 0, c("fps").cast("double")), F.lit(30.0))
    start, end = c("start_frame").cast("long"), c("end_frame").cast("long")
    chosen = (
        F.when(c("name") == "hold", evenly_spaced(start, end, keyframes))
        .when(c("name") == "arc", phase_sample(start, end, fps, arc_fps))
        .otherwise(phase_sample(start, end, fps, static_fps))
    )
    prefix = F.lit(None).cast("string")
    for name, letter in PHASE_PREFIX.items():
        prefix = F.when(c("name") == name, letter).otherwise(prefix)
    # phases may be re-declared wide: a later phase overwrites the name of an earlier one
    sampled = spans.select(capture, F.explode(chosen).alias("frame"), "name", prefix.alias("_p"))
    by_phase = sampled.groupBy(capture, "frame").agg(
        F.max_by("_p", F.when(c("name") == "hold", 3).when(c("name") == "reseat", 2).when(c("name") == "arc", 1).otherwise(0)).alias("_p")
    )
    rest = captures.filter(c("rest_start").isNotNull()).select(
        capture, F.explode(F.sequence(c("rest_start").cast("long"), c("rest_end").cast("long"))).alias("frame")
    )
    rest = phase_of(rest, phases, capture, "frame").withColumn("name", F.coalesce("phase", F.lit("reseat")))
    rest = rest.select(capture, "frame", prefix.alias("_r"))
    plan = by_phase.join(rest, [capture, "frame"], "full_outer")
    return plan.select(
        capture,
        "frame",
        F.concat(F.coalesce("_p", "_r"), F.lit("_"), F.lpad(c("frame").cast("string"), 6, "0"), F.lit(".jpg")).alias("file"),
        c("_r").isNotNull().alias("rest"),
    )
