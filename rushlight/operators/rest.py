"""Rest detector, sweep ticks and lock events as windows over each capture; the live forms are in ``streaming``."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushlight.operators.motion import (
    CONE_SAFETY,
    GRAVITY_ALPHA,
    MAX_STEP_NS,
    ORBIT_M_S2,
    REST_WINDOW,
    SWEEP_RAD_S,
    norm,
    rolling_rms,
    with_gravity,
)
from rushlight.plans.recurrence import ema, gated_ema
from rushlight.plans.timeline import Timeline

# Rest detector.
GYRO_REST_RAD_S = 0.03
ACCEL_REST_M_S2 = 0.25
MAX_TILT_DEG = 1.0
BIAS_ALPHA = 0.002


def _vector(df_columns: tuple[str, str, str]) -> Column:
    return F.when(F.col(df_columns[0]).isNotNull(), F.struct(*[F.col(c).alias(n) for c, n in zip(df_columns, "xyz")]))


def _between(a: Column, b: Column) -> Column:
    """Degrees between two vectors; 0 where one has no length."""
    size = norm(a["x"], a["y"], a["z"]) * norm(b["x"], b["y"], b["z"])
    cosine = (a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]) / size
    return F.when(size > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))).otherwise(0.0)


def stillness(samples: DataFrame, line: Timeline) -> DataFrame:
    """One row per gyro and accel sample: is the capture at rest, since when, and was its pose disturbed?

    ``samples``: capture, time (ns), sensor ('gyro', 'accel' or 'mark'), x, y, z. A mark freezes the gravity direction
    then known; what follows, up to the next mark, is judged against it. Gyro bias is learned before the first mark from
    samples near it (``gated_ema``). Everything else is running values: gravity by smoothing, the spread of the
    last samples by rolling frames, spans between marks by running counts.
    """
    (capture,), t = line.keys, line.axis
    kept = list(dict.fromkeys([capture, t, *line.ties, "sensor", "x", "y", "z"]))
    accel = ema(samples.filter("sensor = 'accel'"), line, {"_gx": "x", "_gy": "y", "_gz": "z"}, GRAVITY_ALPHA)
    others = samples.filter("sensor in ('gyro', 'mark')")
    both = accel.unionByName(others, allowMissingColumns=True).select(*kept, _vector(("_gx", "_gy", "_gz")).alias("_own"))
    known = line.running(both, {"_gravity": ("last", F.col("_own"))})
    frozen = (F.col("sensor") == "mark") & F.col("_gravity").isNotNull()
    spans = line.running(
        known, {"_span": ("sum", frozen.cast("int")), "_reference": ("last", F.when(frozen, F.col("_gravity")))}
    ).filter("sensor <> 'mark'")
    held = F.col("_span") > 0
    inside = replace(line, keys=(capture, "_span"))

    gyro = spans.filter("sensor = 'gyro'").drop("_own", "_gravity", "_reference")
    gyro = gated_ema(gyro, line, {"_bx": "x", "_by": "y", "_bz": "z"}, BIAS_ALPHA, 2 * GYRO_REST_RAD_S, ~held)
    gyro = gyro.withColumn("_speed", norm(F.col("x") - F.col("_bx"), F.col("y") - F.col("_by"), F.col("z") - F.col("_bz")))
    gyro = rolling_rms(gyro, line, "_speed", "_gyro_rms")
    gyro = inside.rolling(gyro, 1, 0, lambda ordered, _: {"_step": F.col(t) - F.lag(t).over(ordered)})
    turned = F.when(held & (F.col("_step") > 0) & (F.col("_step") <= MAX_STEP_NS), F.col("_speed") * F.col("_step") / 1e9)

    g = F.col("_own")
    shaken = spans.filter("sensor = 'accel'").withColumn(
        "_shake", F.abs(norm(F.col("x"), F.col("y"), F.col("z")) - norm(g["x"], g["y"], g["z"]))
    )
    shaken = rolling_rms(shaken, line, "_shake", "_accel_rms")
    tilted = F.when(held, _between(g, F.col("_reference")))

    columns = [capture, t, *line.ties, "_span"]
    rows = gyro.select(*columns, "_gyro_rms", turned.alias("_turned")).unionByName(
        shaken.select(*columns, "_accel_rms", tilted.alias("_tilt")), allowMissingColumns=True
    )
    rows = line.running(rows, {"gyro_rms": ("last", F.col("_gyro_rms")), "accel_rms": ("last", F.col("_accel_rms"))})
    quiet = F.coalesce((F.col("gyro_rms") < GYRO_REST_RAD_S) & (F.col("accel_rms") < ACCEL_REST_M_S2), F.lit(False))
    rows = rows.withColumn("at_rest", quiet)
    rows = line.rolling(rows, 1, 0, lambda ordered, _: {"_was": F.coalesce(F.lag("at_rest").over(ordered), F.lit(False))})
    rows = line.running(rows, {"_since": ("last", F.when(F.col("at_rest") & ~F.col("_was"), F.col(t)))})
    upset = held & (~F.col("at_rest") | F.coalesce(F.col("_tilt") > MAX_TILT_DEG, F.lit(False)))
    rows = inside.running(
        rows,
        {
            "tilt_deg": ("last", F.col("_tilt")),
            "max_tilt_deg": ("max", F.col("_tilt")),
            "_upset": ("max", upset.cast("int")),
            "_residual": ("sum", F.coalesce(F.col("_turned"), F.lit(0.0))),
        },
    )
    zero = F.lit(0.0)
    return rows.select(
        capture,
        t,
        *line.ties,
        F.coalesce("gyro_rms", zero).alias("gyro_rms"),
        F.coalesce("accel_rms", zero).alias("accel_rms"),
        F.coalesce("tilt_deg", zero).alias("tilt_deg"),
        F.coalesce("max_tilt_deg", zero).alias("max_tilt_deg"),
        "at_rest",
        F.when(F.col("at_rest"), F.floor((F.col(t) - F.col("_since")) / 1_000_000)).otherwise(0).cast("long").alias("rest_for_ms"),
        (F.col("_upset") > 0).alias("disturbed"),
        F.degrees("_residual").alias("residual_deg"),
    )


def sweep_ticks(samples: DataFrame, line: Timeline, max_step: int = MAX_STEP_NS) -> DataFrame:
    """One row per gyro sample: heading and sides swept so far, and whether the capture orbits or pans."""
    (capture,), t = line.keys, line.axis
    pointed = with_gravity(samples, line)
    g, x, y, z = F.col("gravity"), F.col("x"), F.col("y"), F.col("z")
    along = x * g["x"] + y * g["y"] + z * g["z"]
    across = norm(x - along * g["x"], y - along * g["y"], z - along * g["z"])
    measured = (F.col("sensor") == "accel") & F.col("from_rotation")
    rank = F.when(F.col("sensor") == "rotation", 0).when(F.col("sensor") == "accel", 1).otherwise(2)
    counted = line.tied("_rank", *line.ties).running(
        pointed.withColumn("_rank", rank),
        {
            "orbit_samples": ("sum", (measured & (across > ORBIT_M_S2)).cast("long")),
            "pan_samples": ("sum", (measured & (across <= ORBIT_M_S2)).cast("long")),
        },
    )
    gyro = counted.filter("sensor = 'gyro'").drop("_rank")
    gyro = line.rolling(gyro, 1, 0, lambda ordered, _: {"_step": F.col(t) - F.lag(t).over(ordered)})
    sweeping = (F.col("_step") > 0) & (F.col("_step") <= max_step) & (F.abs(along) >= SWEEP_RAD_S)
    turn = F.when(sweeping, along * F.col("_step") / 1e9).otherwise(0.0)
    turned = line.running(gyro, {"_heading": ("sum", turn)})
    reached = line.running(turned, {"_low": ("min", F.col("_heading")), "_high": ("max", F.col("_heading"))})
    left, right = F.degrees(F.greatest("_high", F.lit(0.0))), F.degrees(F.greatest(-F.col("_low"), F.lit(0.0)))
    return reached.select(
        capture,
        t,
        *line.ties,
        (-F.degrees("_heading")).alias("heading_deg"),
        left.alias("left_deg"),
        right.alias("right_deg"),
        (left + right).alias("swept_deg"),
        (F.least(left, right) * CONE_SAFETY).alias("implied_cone_deg"),
        "orbit_samples",
        "pan_samples",
        (~F.col("from_rotation") | (F.col("orbit_samples") > F.col("pan_samples"))).alias("orbit_likely"),
    )


def lock_events(frames: DataFrame, line: Timeline) -> DataFrame:
    """First deviation of each kind per capture, with the exposures checked and matched by then.

    ``frames``: capture, time, ``physical_id``, ``exposure_ns``, ``requested_ns``, ``awb_manual`` (false where another
    mode than the manual one is in force), ``crop``. Lens and crop are compared with the capture's first known ones.
    """
    (capture,), t = line.keys, line.axis
    order = F.struct(F.col(t), *[F.col(c) for c in line.ties])
    known = {c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(f"_first_{c}") for c in ("physical_id", "crop")}
    firsts = frames.groupBy(F.col(capture).alias("_capture")).agg(*known.values())
    checked = F.col("exposure_ns").isNotNull() & F.col("requested_ns").isNotNull()
    drift = checked & (F.abs(F.col("exposure_ns") - F.col("requested_ns")) > F.floor(F.col("requested_ns") / 50))
    drift = F.coalesce(drift, F.lit(False))
    counted = line.running(
        frames.withColumn("_checked", checked.cast("long")).withColumn("_matched", (checked & ~drift).cast("long")),
        {"checked": ("sum", F.col("_checked")), "matched": ("sum", F.col("_matched"))},
    )
    joined = counted.join(firsts, F.col(capture).eqNullSafe(F.col("_capture")))

    def fired(kind: str, test: Column, detail: Column, before: bool = False) -> Column:
        own = (F.col("_checked"), F.col("_matched")) if before else (F.lit(0), F.lit(0))
        return F.when(
            test,
            F.struct(
                F.lit(kind).alias("kind"), detail.alias("detail"),
                (F.col("checked") - own[0]).alias("checked"), (F.col("matched") - own[1]).alias("matched"),
            ),
        )

    def changed(column: str) -> tuple[Column, Column]:
        first = F.col(f"_first_{column}")
        return F.col(column) != first, F.concat(first, F.lit(" -> "), F.col(column))

    wanted = F.concat(F.lit("requested "), F.col("requested_ns"), F.lit(" ns, got "), F.col("exposure_ns"))
    kinds = F.array(
        fired("lens_switch", *changed("physical_id"), before=True),  # the lens is looked at before the exposure
        fired("exposure_drift", drift, wanted),
        fired("awb_not_manual", ~F.col("awb_manual"), F.lit("requested OFF")),
        fired("crop_changed", *changed("crop")),
    )
    each = joined.select(capture, order.alias("_order"), F.explode(F.array_compact(kinds)).alias("_e"))
    first = each.groupBy(capture, F.col("_e.kind").alias("kind")).agg(F.min_by(F.struct("_order", "_e"), "_order").alias("_f"))
    return first.select(
        capture, F.col(f"_f._order.{t}").alias(t), "kind", F.col("_f._e.detail").alias("detail"),
        F.col("_f._e.checked").alias("checked"), F.col("_f._e.matched").alias("matched"),
    )
