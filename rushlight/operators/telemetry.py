"""Per-frame signals, per-capture telemetry and its score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushlight.plans.quantiles import exact_percentiles
from rushlight.plans.timeline import Timeline

# Thresholds and weights that decide the published ratios and score.
ROLLING_WINDOW = 31
ROLLING_WARMUP = 9
BLURRY_BELOW = 0.60
DARK_BELOW = 45
BRIGHT_ABOVE = 220
OVEREXPOSED_ABOVE = 0.12
FAST_ABOVE = 35.0
DUPLICATE_CORRELATION = 0.992
DUPLICATE_MAX_DIFF = 2.0
SCORE_WEIGHTS = {
    "blurry_frame_ratio": 35,
    "too_dark_ratio": 30,
    "too_fast_ratio": 25,
    "too_bright_ratio": 20,
    "duplicate_ratio": 20,
}
NO_POSES_PENALTY = 10
GOOD_FROM = 75
WARNING_FROM = 45
WARN_ABOVE = {
    "blurry_frame_ratio": 0.15,
    "too_dark_ratio": 0.10,
    "too_bright_ratio": 0.10,
    "too_fast_ratio": 0.12,
    "duplicate_ratio": 0.25,
}
# Texts shown to users.
WARNINGS = {
    "has_poses": "No camera pose metadata found. COLMAP will be required.",
    "has_intrinsics": "No camera intrinsics metadata found.",
    "blurry_frame_ratio": " of sampled frames are markedly softer than this clip's median.",
    "too_dark_ratio": "A significant portion of sampled frames is underexposed.",
    "too_bright_ratio": "Highlights are clipping in a significant portion of frames.",
    "too_fast_ratio": "Camera movement may be too fast for stable reconstruction.",
    "duplicate_ratio": "Many sampled frames are near-duplicates.",
}
ADVICE = {
    "blurry_frame_ratio": "Move more slowly and avoid sudden turns.",
    "too_dark_ratio": "Add brighter, more even lighting.",
    "too_bright_ratio": "Reduce exposure so bright surfaces retain detail.",
    "too_fast_ratio": "Capture with a slow, continuous orbit.",
    "duplicate_ratio": "Keep moving; near-identical frames add no parallax.",
    "exposure_locked": "Lock exposure before starting the capture.",
    "white_balance_locked": "Lock white balance before starting the capture.",
}


def rolling_relative(
    df: DataFrame,
    line: Timeline,
    value: str,
    name: str = "blur_relative",
    window: int = ROLLING_WINDOW,
    warmup: int = ROLLING_WARMUP,
) -> DataFrame:
    """Value over the median of the last ``window`` values, 1.0 while warming up."""

    def build(_, framed) -> dict[str, Column]:
        middle = F.percentile(F.col(value), F.lit(0.5)).over(framed)
        seen = F.count(F.col(value)).over(framed)
        return {
            name: F.when((seen >= warmup) & (middle > 0), F.col(value) / middle).otherwise(F.lit(1.0)),
            "blur_ready": seen >= warmup,
        }

    return line.rolling(df, window - 1, 0, build)


def _share(test: Column) -> Column:
    return F.avg(test.cast("double"))


def telemetry_report(
    signals: DataFrame, capture: str = "capture_id", blur_threshold: float = BLURRY_BELOW, line: Timeline | None = None
) -> DataFrame:
    """One row per capture over ``blur_vol, blur_relative, brightness, overexposed_ratio,
    underexposed_ratio, motion_diff, hist_correlation``. A measured ``line`` spares a size check."""
    c = F.col
    duplicate = (c("hist_correlation") > DUPLICATE_CORRELATION) & (
        F.coalesce(c("motion_diff"), F.lit(0.0)) < DUPLICATE_MAX_DIFF
    )
    shares = signals.groupBy(capture).agg(
        F.count(F.lit(1)).alias("frame_count"),
        F.avg("blur_vol").alias("vol_mean"),
        _share(c("blur_relative") < blur_threshold).alias("blurry_frame_ratio"),
        F.avg("brightness").alias("brightness_mean"),
        F.avg("overexposed_ratio").alias("overexposed_ratio"),
        F.avg("underexposed_ratio").alias("underexposed_ratio"),
        _share(c("brightness") < DARK_BELOW).alias("too_dark_ratio"),
        _share((c("brightness") > BRIGHT_ABOVE) | (c("overexposed_ratio") > OVEREXPOSED_ABOVE)).alias(
            "too_bright_ratio"
        ),
        F.coalesce(F.avg("motion_diff"), F.lit(0.0)).alias("motion_mean"),
        F.coalesce(_share(c("motion_diff") > FAST_ABOVE), F.lit(0.0)).alias("too_fast_ratio"),
        (F.count(F.when(duplicate, 1)) / F.greatest(F.lit(1), F.count(F.lit(1)) - 1)).alias("duplicate_ratio"),
    )
    spread = exact_percentiles(
        signals, [capture], {"vol_p10": ("blur_vol", 0.1), "vol_median": ("blur_vol", 0.5)}, fits=line.fits if line else None
    )
    return shares.join(spread, capture)


def score_report(report: DataFrame) -> DataFrame:
    """Attach ``score``, ``status``, ``warnings`` and sorted ``recommendations``.

    Missing metadata columns (``has_poses`` and the like) count as absent.
    """
    for flag in ("has_poses", "has_intrinsics", "exposure_locked", "white_balance_locked"):
        if flag not in report.columns:
            report = report.withColumn(flag, F.lit(False))
    c = F.col

    def unset(flag: str) -> Column:
        return ~F.coalesce(c(flag).cast("boolean"), F.lit(False))

    over = {name: c(name) > bound for name, bound in WARN_ABOVE.items()}
    blurry = F.concat(F.format_string("%d%%", F.bround(c("blurry_frame_ratio") * 100).cast("int")), F.lit(WARNINGS["blurry_frame_ratio"]))
    warnings = [F.when(unset(f), F.lit(WARNINGS[f])) for f in ("has_poses", "has_intrinsics")]
    warnings += [
        F.when(test, blurry if name == "blurry_frame_ratio" else F.lit(WARNINGS[name])) for name, test in over.items()
    ]
    advice = [F.when(test, F.lit(ADVICE[name])) for name, test in over.items()]
    advice += [F.when(unset(f), F.lit(ADVICE[f])) for f in ("exposure_locked", "white_balance_locked")]

    score = F.lit(100)
    for name, weight in SCORE_WEIGHTS.items():
        score = score - (c(name) * weight).cast("int")
    score = score - F.when(unset("has_poses"), NO_POSES_PENALTY).otherwise(0)
    return (
        report.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)))
        .withColumn(
            "status",
            F.when(c("score") >= GOOD_FROM, "good").when(c("score") >= WARNING_FROM, "warning").otherwise("bad"),
        )
        .withColumn("warnings", F.array_compact(F.array(*warnings)))
        .withColumn("recommendations", F.array_sort(F.array_distinct(F.array_compact(F.array(*advice)))))
    )
