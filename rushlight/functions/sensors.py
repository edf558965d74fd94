"""Clock and blur expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAUSIBLE_NS = 5_000_000_000  # Fixed value: a clock further off than this is not the sensor's.


def blur_pixels(omega: Column, exposure_seconds: Column, focal_pixels: Column) -> Column:
    """Predicted smear in pixels; 0 for inputs that are not positive."""
    valid = (exposure_seconds > 0) & (focal_pixels > 0)
    return F.when(valid, F.abs(omega) * exposure_seconds * focal_pixels).otherwise(F.lit(0.0))


def classify_sensor_clock(t: Column, boottime: Column, monotonic: Column) -> Column:
    """Which clock a sensor timestamp is on, and what to add to reach the camera's clock."""
    to_boot, to_mono = F.abs(boottime - t), F.abs(monotonic - t)
    is_boot = (to_boot < to_mono) & (to_boot < PLAUSIBLE_NS)
    is_mono = ~is_boot & (to_mono < PLAUSIBLE_NS)
    clock = F.when(is_boot, "BOOTTIME").when(is_mono, "MONOTONIC").otherwise("UNKNOWN")
    offset = F.when(is_mono, boottime - monotonic).otherwise(F.lit(0)).cast("long")
    return F.struct(clock.alias("clock"), offset.alias("offset_ns"))


def alignable(camera_source: Column, clock: Column) -> Column:
    return F.coalesce(camera_source == "REALTIME", F.lit(False)) & (clock != "UNKNOWN")
