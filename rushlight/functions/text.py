"""Text parsing and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROGRESS_PATTERN = r"(?i)(?:iter(?:ation)?|step)\D{0,4}(\d{2,7})"  # Fixed pattern.
PROGRESS_CEILING = 95  # Fixed value.


def number(text: Column) -> Column:
    return text.try_cast("double")


def parse_rate(rate: Column) -> Column:
    """``30000/1001`` or ``29.97`` to a number; a zero denominator or bad text is NULL."""
    parts = F.split(rate, "/", 2)
    below = number(F.get(parts, F.lit(1)))
    return F.when(F.instr(rate, "/") > 0, F.when(below != 0, number(F.get(parts, F.lit(0))) / below)).otherwise(number(rate))


def quarter_turns(rotation: Column) -> Column:
    """Container rotation as 0..359 degrees; unreadable is 0."""
    return F.coalesce(F.pmod(F.rint(rotation.cast("string").try_cast("double")).cast("int"), F.lit(360)), F.lit(0))


def display_size(width: Column, height: Column, rotation: Column) -> Column:
    """Frame size after rotation: transposed at odd quarter turns."""
    sideways = F.pmod(rotation, F.lit(180)) == 90
    return F.struct(
        F.when(sideways, height).otherwise(width).alias("width"),
        F.when(sideways, width).otherwise(height).alias("height"),
    )


def parse_progress(line: Column, total: Column) -> Column:
    """Percent done from a trainer log line, at most 95; NULL where no step is named."""
    found = F.regexp_extract(line, PROGRESS_PATTERN, 1)
    value = F.when(found != "", found.cast("long"))
    return F.when(
        (value > 0) & (value <= total),
        F.least(F.lit(PROGRESS_CEILING), (value / total * PROGRESS_CEILING).cast("int")),
    )


def human_size(count: Column) -> Column:
    gib, mib = float(1 << 30), float(1 << 20)
    return (
        F.when(count >= gib, F.format_string("%.1f GB", F.bround(count / gib, 1)))
        .when(count >= mib, F.format_string("%.0f MB", F.rint(count / mib)))
        .otherwise(F.format_string("%.0f KB", F.rint(count / 1024.0)))
    )


def short_label(stem: Column) -> Column:
    """``A_good_30000`` to ``A good · 30,000 steps``."""
    steps = F.regexp_extract(stem, r"^(?:.*_)?(\d+)$", 1)
    name = F.translate(F.regexp_extract(stem, r"^(.*)_\d+$", 1), "_", " ")
    spoken = F.concat(name, F.lit(" · "), F.format_number(steps.try_cast("long"), 0), F.lit(" steps"))
    return F.when(steps != "", spoken).otherwise(F.translate(stem, "_", " "))
