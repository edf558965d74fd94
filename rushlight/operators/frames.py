"""Frame telemetry and greedy frame selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rushlight.functions import pixels
from rushlight.operators.telemetry import rolling_relative
from rushlight.plans.sizing import settle
from rushlight.plans.timeline import Timeline

# Extraction rules.
SELECT_BLURRY_BELOW = 0.60
SELECT_CORRELATION = 0.996
SELECT_MAX_DIFF = 2.0
FIRST_FILE_NUMBER = 1


def frames_in_range(index: DataFrame, first: int, last: int, frame: str = "frame") -> DataFrame:
    """Used frames that have a file and lie in the inclusive range."""
    return index.filter(F.col("used") & F.col("file").isNotNull() & F.col(frame).between(first, last))


def frame_signals(frames: DataFrame) -> DataFrame:
    """Per-frame statistics from ``gray, height, width``; the plane stays for pair statistics."""
    return frames.withColumn("_s", pixels.frame_statistics()).select("*", "_s.*").drop("_s")


def motion_signals(signals: DataFrame, line: Timeline) -> DataFrame:
    """Add motion and histogram correlation against the previous frame."""
    stepped = line.rolling(
        signals, 1, 0, lambda ordered, _: {"_bg": F.lag("gray").over(ordered), "_bh": F.lag("hist").over(ordered)}
    )
    return stepped.withColumn("_p", pixels.pair_statistics("gray", "hist", "_bg", "_bh")).select("*", "_p.*").drop(
        "_p", "_bg", "_bh"
    )


def change_profile(frames: DataFrame, line: Timeline) -> DataFrame:
    """Share of changed pixels and mean change against the previous frame, at analysis size."""
    small = frames.withColumn("_plane", pixels.analysis_frame()).drop("gray")
    stepped = line.rolling(small, 1, 0, lambda ordered, _: {"_before": F.lag("_plane").over(ordered)})
    return stepped.withColumn("_c", pixels.changed_share("_plane", "_before")).select("*", "_c.*").drop(
        "_c", "_plane", "_before"
    )


def sampled_frames(frames: DataFrame, target_fps: float, frame: str = "frame", fps: str = "fps") -> DataFrame:
    """Every n-th frame for a target rate; n is at least 1, half-way rates round to even."""
    every = F.greatest(F.lit(1), F.rint(F.col(fps) / target_fps).cast("int"))
    return frames.filter(F.col(frame) % F.coalesce(every, F.lit(1)) == 0)


def _chain(rows: DataFrame, capture: str, correlation: float, max_diff: float) -> DataFrame:
    """Greedy pass along each (capture, block): keep a candidate unless it repeats the last kept.

    A row with ``seed`` set is the frame kept before the block; it only fills the state.
    """
    kind = dict(rows.dtypes)[capture]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, gray, hist = None, None, None
        for batch in batches:
            out = []
            for key, block, rn, g, h, seed, open_ in zip(
                batch[capture], batch["_block"], batch["_rn"], batch["gray"], batch["hist"], batch["_seed"], batch["_open"], strict=True
            ):
                if (key, block) != current:
                    current, gray, hist = (key, block), None, None
                now, bins = np.frombuffer(g, np.uint8), np.asarray(h)
                if seed:
                    gray, hist = now, bins
                    continue
                motion = alike = None
                if gray is not None:
                    motion = pixels.mean_difference(now, gray) if len(now) == len(gray) else None
                    alike = pixels.correlation(bins, hist)
                repeats = alike is not None and motion is not None and alike > correlation and motion < max_diff
                keep = bool(open_) and not repeats
                if keep:
                    gray, hist = now, bins
                out.append((key, block, rn, motion, alike, bool(open_) and repeats, keep))
            yield pd.DataFrame(out, columns=[capture, "_block", "_rn", "motion_diff", "hist_correlation", "duplicate", "kept"]).astype(
                {"motion_diff": "float64", "hist_correlation": "float64"}
            )

    schema = f"{capture} {kind}, _block long, _rn long, motion_diff double, hist_correlation double, duplicate boolean, kept boolean"
    return rows.repartition(capture, "_block").sortWithinPartitions(capture, "_block", "_rn").mapInPandas(walk, schema)


def select_frames(
    signals: DataFrame,
    line: Timeline,
    max_frames: int = 0,
    blur_threshold: float = SELECT_BLURRY_BELOW,
    correlation: float = SELECT_CORRELATION,
    max_diff: float = SELECT_MAX_DIFF,
    block_rows: int | None = None,
) -> DataFrame:
    """Verdict for every sampled frame: blurred, duplicate of the last kept frame, or kept.

    The duplicate rule looks at the last *kept* frame, so it runs along a capture in order. A
    capture too long for one task is cut into blocks that run at the same time, each from a
    guess of the frame kept before it. A block whose guess was wrong runs again from the frame
    its predecessor really kept, until no guess changes; two runs that keep the same frame agree
    from there on, so this settles fast, and it is exact whenever it stops.
    """
    (capture,) = line.keys
    scored = rolling_relative(signals, line, "blur_vol")
    blurred = F.col("blur_ready") & (F.col("blur_relative") < blur_threshold)
    numbered = line.number(scored.withColumn("blurred", blurred).withColumn("_open", ~blurred), "_rn")
    split = bool(line.splits) or block_rows is not None
    size = block_rows or line.block_rows
    block = F.floor((F.col("_rn") - 1) / size) if split else F.lit(0)
    rows = numbered.withColumn("_block", block.cast("long")).withColumn("_seed", F.lit(False))
    needed = [capture, "_block", "_rn", "gray", "hist", "_seed", "_open"]
    if not split:
        verdicts = _chain(rows.select(*needed), capture, correlation, max_diff)
    else:
        verdicts = _settled(rows.select(*needed), capture, correlation, max_diff)
    judged = rows.drop("gray", "hist", "_seed", "_open").join(verdicts.drop("_block"), [capture, "_rn"])
    order = Timeline.measure(judged, [capture], "_rn") if line.splits else Timeline((capture,), "_rn")
    counted = order.running(judged, {"_kept": ("sum", F.col("kept").cast("int"))})
    if max_frames:
        # a full budget stops the reader: the frame that fills it is the last one in the index
        counted = counted.filter((F.col("_kept") < max_frames) | ((F.col("_kept") == max_frames) & F.col("kept")))
    number = F.lpad((F.col("_kept") - 1 + FIRST_FILE_NUMBER).cast("string"), 6, "0")
    return counted.withColumn(
        "file", F.when(F.col("kept"), F.concat(F.lit("frames/images/frame_"), number, F.lit(".jpg")))
    ).drop("_rn", "_block", "_kept")


def _settled(rows: DataFrame, capture: str, correlation: float, max_diff: float) -> DataFrame:
    rows = settle(rows)
    verdicts = settle(_chain(rows, capture, correlation, max_diff))
    entries = None
    while True:
        ends = verdicts.groupBy(capture, "_block").agg(F.max(F.when(F.col("kept"), F.col("_rn"))).alias("_end"))
        # a block that keeps nothing hands on what it was given
        upto = Timeline((capture,), "_block").running(ends, {"_given": ("last", F.col("_end"))})
        wanted = upto.select(capture, (F.col("_block") + 1).alias("_block"), F.col("_given").alias("_entry")).filter(
            F.col("_entry").isNotNull()
        )
        blocks = ends.select(capture, "_block")
        wanted = blocks.join(wanted, [capture, "_block"], "left")
        before = blocks.withColumn("_old", F.lit(None).cast("long")) if entries is None else entries.withColumnRenamed("_entry", "_old")
        wanted = settle(wanted)
        changed = settle(
            wanted.join(before, [capture, "_block"], "left")
            .filter(~F.col("_entry").eqNullSafe(F.col("_old")))
            .select(capture, "_block", "_entry")
        )
        if changed.isEmpty():
            return verdicts
        entries = wanted
        seeds = (
            rows.drop("_block", "_seed")
            .join(changed.withColumnRenamed("_entry", "_rn"), [capture, "_rn"])
            .withColumn("_seed", F.lit(True))
        )
        again = rows.join(changed.select(capture, "_block"), [capture, "_block"], "left_semi").unionByName(seeds)
        fresh = _chain(again, capture, correlation, max_diff)
        verdicts = settle(
            verdicts.join(changed.select(capture, "_block"), [capture, "_block"], "left_anti").unionByName(fresh)
        )
