"""Robust statistics and the filters that precede a statistic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushlight.plans.quantiles import exact_percentiles
from rushlight.plans.sizing import fits_one_task

# Normal-consistency factor, standard gravity and its tolerances.
MAD_TO_SIGMA = 1.4826
GRAVITY = 9.81
GRAVITY_TOLERANCE = 1.0
STATIONARY_TOLERANCE = 1.5


def median_and_mad(
    df: DataFrame, keys: list[str], value: str, limit: int | None = None, fits: bool | None = None
) -> DataFrame:
    """Per key: ``median`` and ``mad`` (median absolute deviation), exact."""
    fits = fits_one_task(df, keys, limit) if fits is None else fits
    middle = exact_percentiles(df, keys, {"median": (value, 0.5)}, limit, fits)
    apart = df.join(middle, keys).withColumn("_apart", F.abs(F.col(value) - F.col("median")))
    return middle.join(exact_percentiles(apart, keys, {"mad": ("_apart", 0.5)}, limit, fits), keys)


def robust_sigma(df: DataFrame, keys: list[str], value: str, limit: int | None = None) -> DataFrame:
    return median_and_mad(df, keys, value, limit).select(
        *keys, F.coalesce(F.lit(MAD_TO_SIGMA) * F.col("mad"), F.lit(0.0)).alias("sigma")
    )


def as_number(column: str, kind: str) -> Column:
    """Booleans become 0/1, numbers stay, anything else that is not a number becomes NULL."""
    if kind == "boolean":
        return F.col(column).cast("int").cast("double")
    return F.expr(f"try_cast(`{column}` AS DOUBLE)")


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Keep rows where both sides are finite numbers; both come back as doubles."""
    kinds = dict(df.dtypes)
    made = df.withColumn(x, as_number(x, kinds[x])).withColumn(y, as_number(y, kinds[y]))
    return made.filter(is_finite(F.col(x)) & is_finite(F.col(y)))


def stationary(
    imu: DataFrame,
    capture: str,
    norm: str,
    gravity: float = GRAVITY,
    capture_tolerance: float = GRAVITY_TOLERANCE,
    sample_tolerance: float = STATIONARY_TOLERANCE,
    limit: int | None = None,
) -> DataFrame:
    """Samples whose acceleration is close to their capture's median, in captures whose median
    is close to gravity."""
    middle = exact_percentiles(imu, [capture], {"_middle": (norm, 0.5)}, limit)
    middle = middle.filter(F.abs(F.col("_middle") - gravity) <= capture_tolerance)
    return (
        imu.join(middle, capture)
        .filter((F.abs(F.col(norm) - F.col("_middle")) <= sample_tolerance) & (F.col(norm) != 0))
        .drop("_middle")
    )
