"""Grid, quaternion and weight codes of the packed scene."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rushlight.functions.geometry import Quat, quat_normalise

# Fixed formats: code ranges and record sizes.
GRID_LEVELS = 65535
GRID_SPAN_FLOOR = 1e-9
TRAJECTORY_SPAN_FLOOR = 1e-6
SMALLEST_THREE_HALF = 511
INV_SQRT2 = 0.7071067811865476
SNORM16 = 32767
WEIGHT_TOTAL = 255
GEOMETRY_BYTES = 16
COLOUR_BYTES = 4
TRAJECTORY_BYTES = 14
NODE_BYTES = 12
SH_C0 = 0.28209479177387814


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def quantise_grid(value: Column, origin: Column, span: Column, levels: int = GRID_LEVELS, floor: float = GRID_SPAN_FLOOR) -> Column:
    """Grid code of a value; half-way values go to the even code."""
    share = (value - origin) / F.greatest(span, F.lit(floor))
    return F.rint(clip(share, 0.0, 1.0) * levels).cast("int")


def dequantise_grid(code: Column, origin: Column, span: Column, levels: int = GRID_LEVELS) -> Column:
    return origin + code.cast("double") / levels * span


def grid_step(span: Column, levels: int = GRID_LEVELS) -> Column:
    return span / levels


def largest_component(q: Quat) -> Column:
    """Index of the component with the greatest magnitude, the first on ties."""
    sizes = F.array(*[F.abs(c) for c in q])
    return (F.array_position(sizes, F.array_max(sizes)) - 1).cast("int")


def pack_quat32(q: Quat) -> Column:
    """Two index bits and three 10-bit codes; the dropped component is made positive."""
    unit = F.array(*quat_normalise(q))
    largest = largest_component(quat_normalise(q))
    sign = F.when(F.get(unit, largest) < 0, -1.0).otherwise(1.0)
    word = F.shiftleft(largest.cast("long"), 30)
    for place, shift in enumerate((20, 10, 0)):
        at = F.when(largest > place, F.lit(place)).otherwise(F.lit(place + 1))
        code = F.rint(clip(F.get(unit, at) * sign / INV_SQRT2, -1.0, 1.0) * SMALLEST_THREE_HALF) + SMALLEST_THREE_HALF
        word = word.bitwiseOR(F.shiftleft(code.cast("long"), shift))
    return word


def unpack_quat32(word: Column) -> Quat:
    largest = F.shiftright(word, 30).bitwiseAND(3).cast("int")
    kept = [
        (F.shiftright(word, shift).bitwiseAND(1023).cast("double") - SMALLEST_THREE_HALF) / SMALLEST_THREE_HALF * INV_SQRT2
        for shift in (20, 10, 0)
    ]
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - kept[0] * kept[0] - kept[1] * kept[1] - kept[2] * kept[2]))
    parts = []
    for i in range(4):
        before = kept[i - 1] if i > 0 else rest
        after = kept[i] if i < 3 else rest
        parts.append(F.when(largest == i, rest).when(largest < i, before).otherwise(after))
    return quat_normalise(tuple(parts))


def pack_quat_snorm16(q: Quat) -> tuple[Column, ...]:
    """Four signed 16-bit codes that keep the quaternion's sign."""
    return tuple(clip(F.rint(c * SNORM16), -SNORM16, SNORM16).cast("int") for c in quat_normalise(q))


def unpack_quat_snorm16(codes: tuple[Column, ...]) -> Quat:
    return quat_normalise(tuple(c.cast("double") / SNORM16 for c in codes))


def quantise_weights(weights: Column) -> Column:
    """Byte weights that sum to exactly 255, by largest remainder; ties go to the lower index.

    A row without weight gives everything to its first influence.
    """
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    safe = F.transform(
        weights,
        lambda w, i: F.when(total > 1e-12, w / F.greatest(total, F.lit(1e-12))).otherwise(
            F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        )
        * WEIGHT_TOTAL,
    )
    floors = F.transform(safe, lambda s: F.floor(s).cast("int"))
    left = F.lit(WEIGHT_TOTAL) - F.aggregate(floors, F.lit(0), lambda a, f: a + f)
    ranked = F.array_sort(F.transform(safe, lambda s, i: F.struct((F.floor(s) - s).alias("f"), i.alias("i"))))
    order = F.transform(ranked, lambda r: r["i"])
    return F.transform(
        floors, lambda f, i: f + F.when(F.array_position(order, i) <= left, 1).otherwise(0)
    )


def dequantise_weights(codes: Column) -> Column:
    return F.transform(codes, lambda c: c.cast("double") / WEIGHT_TOTAL)


def geometry_words(position: tuple[Column, ...], log_scale: tuple[Column, ...], quat: Column) -> tuple[Column, ...]:
    """Four 32-bit words from six 16-bit codes and a packed quaternion."""

    def pair(low: Column, high: Column) -> Column:
        return low.cast("long").bitwiseOR(F.shiftleft(high.cast("long"), 16))

    return (
        pair(position[0], position[1]),
        pair(position[2], log_scale[0]),
        pair(log_scale[1], log_scale[2]),
        quat,
    )


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(x, -30.0, 30.0)))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def colour_byte(dc: Column, rounded: bool = False) -> Column:
    """Colour coefficient to 0..255: truncated, or to the nearest for 4-D scenes."""
    if rounded:
        return clip((F.lit(0.5) + SH_C0 * dc) * 255.0 + 0.5, 0.0, 255.0).cast("int")
    return (clip(F.lit(0.5) + SH_C0 * dc, 0.0, 1.0) * 255).cast("int")


def encode_colour(rgb: Column) -> Column:
    return (rgb - 0.5) / SH_C0


def loss_mask_weight(mask: Column) -> Column:
    return 0.1 + 0.9 * (mask / 255.0)


def clip_seconds(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, F.greatest(frames - 1, F.lit(0)) / fps).otherwise(F.lit(0.0))


def payload_bytes(gaussians: Column, dynamic: Column, frames: Column, nodes: Column, influences: Column) -> dict[str, Column]:
    """Bytes of the packed scene by part, in total and per gaussian."""
    parts = {
        "geometry_bytes": gaussians * GEOMETRY_BYTES,
        "colour_bytes": gaussians * COLOUR_BYTES,
        "skin_bytes": dynamic * influences * 2,
        "trajectory_bytes": frames * nodes * TRAJECTORY_BYTES,
        "node_bytes": nodes * NODE_BYTES,
    }
    total = sum(list(parts.values())[1:], list(parts.values())[0])
    return parts | {"total_bytes": total, "bytes_per_gaussian": total / F.greatest(gaussians, F.lit(1))}


def snorm8(q: Quat) -> tuple[Column, ...]:
    """Quaternion bytes of the 32-byte record: 128 is zero, truncated."""
    return tuple(clip(c * 128 + 128, 0.0, 255.0).cast("int") for c in q)
