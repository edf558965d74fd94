"""Inertial streams: sweep, orbit, rest, rates, gaps and locks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushlight.plans.recurrence import ema
from rushlight.plans.timeline import Timeline

# The phone detectors' thresholds.
RATE_WINDOW = 32
RATE_BIN_DEG_S = 0.5
RATE_BINS = 256
MAX_STEP_NS = 20_000_000
SWEEP_RAD_S = 0.05
ORBIT_M_S2 = 0.15
GRAVITY_ALPHA = 0.05
CONE_SAFETY = 0.8
LOCKS_VERIFIED_MIN = 0.999
REST_WINDOW = 64


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def angular_rate(gyro: DataFrame, line: Timeline, speed: str, window: int = RATE_WINDOW) -> DataFrame:
    """Mean of the last ``window`` angular speeds."""
    return line.rolling(gyro, window - 1, 0, lambda _, framed: {"angular_rate": F.avg(speed).over(framed)})


def rolling_rms(df: DataFrame, line: Timeline, value: str, name: str, window: int = REST_WINDOW) -> DataFrame:
    return line.rolling(
        df, window - 1, 0, lambda _, framed: {name: F.sqrt(F.avg(F.col(value) * F.col(value)).over(framed))}
    )


def phase_spans(frames: DataFrame, line: Timeline, phase: str, t: str) -> DataFrame:
    """Contiguous runs of one phase with the first and last frame of each."""
    keys = list(line.keys)
    runs = line.islands(frames, F.col(phase))
    order = F.struct(F.col(line.axis), *[F.col(c) for c in line.ties])
    made = [F.count(F.lit(1)).alias("frames"), F.min(t).alias("t_first"), F.max(t).alias("t_last")]
    for column in ("frame", "capture_frame"):
        if column in frames.columns:
            made += [
                F.min_by(column, order).alias(f"{column}_first"),
                F.max_by(column, order).alias(f"{column}_last"),
            ]
    return runs.groupBy(*keys, "island", phase).agg(*made)


def frame_gaps(frames: DataFrame, line: Timeline, counter: str) -> DataFrame:
    """Frames dropped before each row, read off the hardware counter."""
    return line.rolling(
        frames, 1, 0, lambda ordered, _: {"gap": F.coalesce(F.col(counter) - F.lag(counter).over(ordered) - 1, F.lit(0))}
    )


def stream_health(samples: DataFrame, keys: list[str], t: str, per_second: int = 1_000_000_000) -> DataFrame:
    """Samples and achieved rate per stream; a stream with no duration has rate 0."""
    elapsed = F.max(t) - F.min(t)
    n = F.count(F.lit(1))
    return samples.groupBy(*keys).agg(
        n.alias("samples"),
        F.when(elapsed > 0, (n * per_second / elapsed)).otherwise(F.lit(0.0)).cast("int").alias("rate_hz"),
    )


def dropped_frames(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Frames lost per capture from ``frame_gaps`` rows."""
    return gaps.groupBy(*keys).agg(
        F.sum(F.greatest(F.col("gap"), F.lit(0))).alias("dropped"), F.count_if(F.col("gap") > 0).alias("gaps")
    )


def lock_report(frames: DataFrame, keys: list[str], actual: str, requested: str, wb_ok: Column | None = None) -> DataFrame:
    """Did the exposure and white balance stay where they were set?

    A frame matches when it is within a fiftieth (integer division) of the request. Nothing
    checked is unknown, not unlocked.
    """
    checked = F.col(actual).isNotNull() & F.col(requested).isNotNull()
    away = F.abs(F.col(actual) - F.col(requested)) > F.floor(F.col(requested) / 50)
    made = frames.groupBy(*keys).agg(
        F.count_if(checked).alias("checked"),
        F.count_if(checked & ~away).alias("matched"),
        *([F.bool_and(F.coalesce(wb_ok, F.lit(True))).alias("white_balance_locked")] if wb_ok is not None else []),
    )
    ratio = F.when(F.col("checked") > 0, F.col("matched") / F.col("checked"))
    return made.withColumn("locks_verified_ratio", ratio).withColumn(
        "exposure_locked", F.when(F.col("checked") > 0, F.col("matched") >= LOCKS_VERIFIED_MIN * F.col("checked"))
    )


def rate_bin(rate_deg: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(RATE_BINS - 1), (F.abs(rate_deg) / RATE_BIN_DEG_S).cast("int")))


def sweep_rate_median(samples: DataFrame, keys: list[str], rate_deg: str) -> DataFrame:
    """Centre of the half-degree bin where the count first passes half the samples."""
    bins = samples.groupBy(*keys, rate_bin(F.col(rate_deg)).alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    line = Timeline(tuple(keys), "bin")  # at most RATE_BINS rows per key
    summed = line.running(bins, {"_upto": ("sum", F.col("_n"))})
    totals = bins.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    passed = summed.join(totals, keys).filter(F.col("_upto") > F.floor(F.col("_all") / 2))
    return passed.groupBy(*keys).agg(
        ((F.min("bin") + 0.5) * RATE_BIN_DEG_S).alias("median_rate"), F.max("_all").alias("samples")
    )


def gravity_from_rotation(x: Column, y: Column, z: Column, w: Column | None = None) -> Column:
    """Unit gravity direction in device axes from a rotation vector."""
    rest = 1 - (x * x + y * y + z * z)
    s = F.coalesce(w, F.sqrt(F.greatest(rest, F.lit(0.0)))) if w is not None else F.sqrt(F.greatest(rest, F.lit(0.0)))
    gx, gy, gz = -2 * (x * z - s * y), -2 * (y * z + s * x), -(1 - 2 * (x * x + y * y))
    size = norm(gx, gy, gz)
    return F.when(size > 0, F.struct((gx / size).alias("x"), (gy / size).alias("y"), (gz / size).alias("z")))


def with_gravity(samples: DataFrame, line: Timeline) -> DataFrame:
    """Attach the gravity direction known at each sample.

    ``samples``: capture, time, sensor ('rotation', 'accel', 'gyro'), x, y, z and optionally w.
    The latest rotation vector decides; until one arrives, the smoothed accelerometer does.
    """
    accel = samples.filter("sensor = 'accel'")
    smooth = ema(accel, line, {"_gx": "x", "_gy": "y", "_gz": "z"}, GRAVITY_ALPHA)
    others = samples.filter("sensor <> 'accel'")
    both = others.unionByName(smooth, allowMissingColumns=True)
    rank = F.when(F.col("sensor") == "rotation", 0).when(F.col("sensor") == "accel", 1).otherwise(2)
    w = F.col("w") if "w" in samples.columns else None
    size = norm(F.col("_gx"), F.col("_gy"), F.col("_gz"))
    low = F.when(
        size > 0,
        F.struct((-F.col("_gx") / size).alias("x"), (-F.col("_gy") / size).alias("y"), (-F.col("_gz") / size).alias("z")),
    )
    turned = F.when(F.col("sensor") == "rotation", gravity_from_rotation(F.col("x"), F.col("y"), F.col("z"), w))
    both = both.withColumn("_rank", rank)
    whole = line.tied("_rank", *line.ties).running(both, {"_turned": ("last", turned), "_low": ("last", low)})
    return whole.select(
        *samples.columns,
        F.coalesce("_turned", "_low").alias("gravity"),
        F.col("_turned").isNotNull().alias("from_rotation"),
    )


def yaw_samples(samples: DataFrame, line: Timeline, max_step: int = MAX_STEP_NS) -> DataFrame:
    """Sweeping gyro samples with their yaw rate (rad/s) and step (s)."""
    t = line.axis
    gyro = with_gravity(samples, line).filter("sensor = 'gyro'")
    stepped = line.rolling(gyro, 1, 0, lambda ordered, _: {"_step": F.col(t) - F.lag(t).over(ordered)})
    g = F.col("gravity")
    yaw = F.col("x") * g["x"] + F.col("y") * g["y"] + F.col("z") * g["z"]
    return (
        stepped.withColumn("yaw", yaw)
        .filter((F.col("_step") > 0) & (F.col("_step") <= max_step) & (F.abs("yaw") >= SWEEP_RAD_S))
        .withColumn("dt", F.col("_step") / 1e9)
        .drop("_step")
    )


def sweep(samples: DataFrame, line: Timeline, max_step: int = MAX_STEP_NS, target_deg: float = 60.0) -> DataFrame:
    """Integrated yaw per capture: range, sides, return error, implied cone, median rate.

    Every capture has a row; one that never sweeps has swept nothing: zeros, and no rate.
    """
    (capture,), t = line.keys, line.axis
    moving = yaw_samples(samples, line, max_step)
    turned = line.running(moving, {"heading": ("sum", F.col("yaw") * F.col("dt"))})
    whole = turned.groupBy(capture).agg(
        F.degrees(F.greatest(F.max("heading"), F.lit(0.0))).alias("left_deg"),
        F.degrees(F.greatest(-F.min("heading"), F.lit(0.0))).alias("right_deg"),
        F.abs(F.degrees(F.max_by("heading", t))).alias("return_error_deg"),
        ((F.max(t) - F.min(t)) / 1e9).alias("duration_sec"),
    )
    rates = sweep_rate_median(moving.withColumn("_rate", F.degrees("yaw")), [capture], "_rate")
    left, right, half = F.col("left_deg"), F.col("right_deg"), target_deg / 2
    nothing = {c: 0.0 for c in ("left_deg", "right_deg", "return_error_deg", "duration_sec", "median_rate")}
    every = samples.select(capture).distinct().withColumnRenamed(capture, "_all")
    whole = every.join(whole, F.col("_all").eqNullSafe(F.col(capture)), "left").drop(capture)
    whole = whole.join(rates, F.col("_all").eqNullSafe(F.col(capture)), "left").drop(capture).withColumnRenamed("_all", capture)
    return whole.fillna(nothing).select(
        capture,
        left,
        right,
        (left + right).alias("swept_deg"),
        "return_error_deg",
        (F.least(left, right) * CONE_SAFETY).alias("implied_cone_deg"),
        "duration_sec",
        F.col("median_rate").alias("median_rate_deg_s"),
        F.when((left < half) & (left <= right), -1).when(right < half, 1).otherwise(0).alias("suggested_direction"),
    )


def orbit_or_pan(samples: DataFrame, line: Timeline) -> DataFrame:
    """Accelerometer samples that curve against those that turn in place.

    Without a rotation vector the question is unanswered, and an orbit is assumed.
    """
    (capture,) = line.keys
    accel = with_gravity(samples, line).filter("sensor = 'accel'")
    g, x, y, z = F.col("gravity"), F.col("x"), F.col("y"), F.col("z")
    along = x * g["x"] + y * g["y"] + z * g["z"]
    across = norm(x - along * g["x"], y - along * g["y"], z - along * g["z"])
    seen = F.col("from_rotation")
    counted = accel.groupBy(capture).agg(
        F.count_if(seen & (across > ORBIT_M_S2)).alias("orbit_samples"),
        F.count_if(seen & (across <= ORBIT_M_S2)).alias("pan_samples"),
    )
    rotated = samples.filter("sensor = 'rotation'").select(capture).distinct().withColumn("orbit_measured", F.lit(True))
    return (
        samples.select(capture)
        .distinct()
        .join(counted, capture, "left")
        .join(rotated, capture, "left")
        .select(
            capture,
            F.coalesce("orbit_samples", F.lit(0)).alias("orbit_samples"),
            F.coalesce("pan_samples", F.lit(0)).alias("pan_samples"),
            F.coalesce("orbit_measured", F.lit(False)).alias("orbit_measured"),
        )
        .withColumn("orbit_likely", ~F.col("orbit_measured") | (F.col("orbit_samples") > F.col("pan_samples")))
    )


def first_deviations(frames: DataFrame, line: Timeline, kinds: dict[str, tuple[str, Column]]) -> DataFrame:
    """First row per capture and kind that deviates.

    ``kinds``: name -> (value column, deviates). In ``deviates`` the column ``first_<value>``
    is the first non-null value of the capture.
    """
    keys = list(line.keys)
    order = F.struct(F.col(line.axis), *[F.col(c) for c in line.ties])
    values = sorted({value for value, _ in kinds.values()})
    firsts = frames.groupBy(*keys).agg(
        *[F.min_by(F.col(v), F.when(F.col(v).isNotNull(), order)).alias(f"first_{v}") for v in values]
    )
    joined = frames.join(firsts, keys)
    fired = F.array_compact(
        F.array(*[F.when(test, F.struct(F.lit(kind).alias("kind"), F.col(v).cast("string").alias("value"))) for kind, (v, test) in kinds.items()])
    )
    each = joined.select(*keys, line.axis, *line.ties, F.explode(fired).alias("_d"))
    return each.groupBy(*keys, "_d.kind").agg(
        F.min(line.axis).alias(line.axis), F.min_by("_d.value", order).alias("value")
    )
