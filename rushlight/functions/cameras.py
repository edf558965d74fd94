"""Camera intrinsics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAUSIBLE_TOLERANCE = 0.08  # Fixed value.
INTRINSIC_FIELDS = ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "width", "height")
# Fixed format: the capture app's calibration document.
DEVICE_SCHEMA = (
    "intrinsic_calibration struct<fx double, fy double, cx double, cy double>, "
    "pre_correction_active_array struct<width double, height double>, distortion_kappa array<double>"
)


def plausible_intrinsics(k: Column, tolerance: float = PLAUSIBLE_TOLERANCE) -> Column:
    """Principal point near the frame centre and positive focal lengths."""
    return (
        (F.abs(k["cx"] - k["width"] / 2) <= tolerance * k["width"])
        & (F.abs(k["cy"] - k["height"] / 2) <= tolerance * k["height"])
        & (k["fx"] > 0)
        & (k["fy"] > 0)
    )


def rotate_intrinsics(k: Column, rotation: Column) -> Column:
    """Intrinsics of the frame turned clockwise by 0, 90, 180 or 270 degrees; NULL otherwise."""
    turn = F.pmod(rotation.cast("int"), F.lit(360))
    quarter = turn.isin(90, 270)
    w, h = k["width"], k["height"]
    cx = (
        F.when(turn == 90, h - k["cy"]).when(turn == 180, w - k["cx"]).when(turn == 270, k["cy"]).otherwise(k["cx"])
    )
    cy = F.when(turn == 90, k["cx"]).when(turn == 180, h - k["cy"]).when(turn == 270, w - k["cx"]).otherwise(k["cy"])

    def swapped(name: str, other: str) -> Column:
        return F.when(quarter, k[other]).otherwise(k[name]).alias(name)

    made = F.struct(
        swapped("fx", "fy"),
        swapped("fy", "fx"),
        cx.alias("cx"),
        cy.alias("cy"),
        k["k1"].alias("k1"),
        k["k2"].alias("k2"),
        swapped("p1", "p2"),
        swapped("p2", "p1"),
        swapped("width", "height"),
        swapped("height", "width"),
    )
    return F.when(turn.isin(0, 90, 180, 270), made)


def device_intrinsics(document: Column, frame_width: Column, frame_height: Column, rotation: Column) -> Column:
    """Frame-pixel intrinsics from the device calibration; NULL where none was reported.

    The recording keeps the sensor's full width and crops rows evenly, so the scale comes from
    the width and the crop from the height.
    """
    d = F.from_json(document, DEVICE_SCHEMA)
    cal, active, kappa = d["intrinsic_calibration"], d["pre_correction_active_array"], d["distortion_kappa"]
    sideways = F.pmod(rotation.cast("int"), F.lit(180)) == 90
    width = F.when(sideways, frame_height).otherwise(frame_width).cast("double")
    height = F.when(sideways, frame_width).otherwise(frame_height).cast("double")
    scale = width / active["width"]
    crop = F.greatest(F.lit(0.0), (active["height"] - height / scale) / 2)

    def distortion(i: int) -> Column:
        return F.coalesce(F.get(kappa, F.lit(i)), F.lit(0.0))

    flat = F.struct(
        (cal["fx"] * scale).alias("fx"),
        (cal["fy"] * scale).alias("fy"),
        (cal["cx"] * scale).alias("cx"),
        ((cal["cy"] - crop) * scale).alias("cy"),
        distortion(0).alias("k1"),
        distortion(1).alias("k2"),
        distortion(3).alias("p1"),  # the third term is not a tangential one and is left out
        distortion(4).alias("p2"),
        width.alias("width"),
        height.alias("height"),
    )
    known = cal.isNotNull() & (active["width"] > 0) & (active["height"] > 0) & (width > 0) & (height > 0)
    return F.when(known, rotate_intrinsics(flat, rotation))
