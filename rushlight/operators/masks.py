"""Moving-region masks of fixed-camera captures.

Frames are cut into bands of rows, so the background, the noise floor and the thresholding work
on pieces of bounded size that spread over the cluster whatever capture they belong to. Only the
clean-up sees a whole frame, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rushlight.operators.robust import MAD_TO_SIGMA
from rushlight.plans.quantiles import percentiles_of_counts
from rushlight.plans.sizing import settle, small
from rushlight.plans.timeline import Timeline

# Fixed values.
NOISE_MULTIPLE = 6.0
MIN_THRESHOLD_LEVELS = 6.0
MEDIAN_FRAMES = 32
MEDIAN_LEAST = 3
FALLBACK_FRAMES = 5
MIN_COMPONENT_SHARE = 5e-4
MIN_COMPONENT_PIXELS = 4
DILATE_SHARE = 0.02
CROWDED_SHARE = 0.60
BAND_ROWS = 64


def bands(frames: DataFrame, capture: str = "capture_id", band_rows: int = BAND_ROWS) -> DataFrame:
    """``capture, frame, height, width, band, piece``: bands of rows of each grey plane."""
    start = F.col("band") * F.lit(band_rows) * F.col("width")
    piece = F.substring(F.col("gray"), (start + 1).cast("int"), (F.lit(band_rows) * F.col("width")).cast("int"))
    last = F.ceil(F.col("height") / band_rows).cast("int") - 1
    cut = frames.withColumn("band", F.explode(F.sequence(F.lit(0), last)))
    return cut.select(capture, "frame", "height", "width", "band", piece.alias("piece"))


def evenly_chosen(frames: DataFrame, line: Timeline, count: int, least: int = 0) -> DataFrame:
    """Rows at ``count`` rounded positions spread over each capture."""
    keys = list(line.keys)
    sizes = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    take = F.least(F.lit(max(least, count)), F.col("_n").cast("int"))
    step = (F.col("_n") - 1) / F.greatest(take - 1, F.lit(1))
    spread = F.transform(F.sequence(F.lit(0), take - 1), lambda i: F.rint(i * step).cast("long"))
    wanted = sizes.select(*keys, F.explode(F.array_distinct(spread)).alias("_at"))
    return line.number(frames, "_rn").withColumn("_at", F.col("_rn") - 1).join(wanted, [*keys, "_at"], "left_semi").drop("_rn", "_at")


def temporal_median(chosen: DataFrame, capture: str = "capture_id", band_rows: int = BAND_ROWS) -> DataFrame:
    """Per-pixel median of the chosen frames (at most ``MEDIAN_FRAMES``), as float32 bands."""
    kind = dict(chosen.dtypes)[capture]

    def middle(rows: pd.DataFrame) -> pd.DataFrame:
        stack = np.stack([np.frombuffer(p, np.uint8) for p in rows["piece"]])
        return pd.DataFrame(
            {
                capture: rows[capture].iloc[:1],
                "band": rows["band"].iloc[:1],
                "background": [np.median(stack, axis=0).astype(np.float32).tobytes()],
                "median_frames": [len(stack)],
            }
        )

    schema = f"{capture} {kind}, band int, background binary, median_frames int"
    return bands(chosen, capture, band_rows).groupBy(capture, "band").applyInPandas(middle, schema)


def residual_counts(pieces: DataFrame, capture: str = "capture_id") -> DataFrame:
    """How often each residual (grey minus background) occurs; residuals are halves of a level."""
    kind = dict(pieces.dtypes)[capture]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, rows in batch.groupby(capture, sort=False, dropna=False):
                total = np.zeros(1021, dtype=np.int64)
                for piece, back in zip(rows["piece"], rows["background"], strict=True):
                    apart = np.frombuffer(piece, np.uint8).astype(np.float64) - np.frombuffer(back, np.float32)
                    total += np.bincount(np.rint(apart * 2).astype(np.int64) + 510, minlength=1021)
                seen = np.nonzero(total)[0]
                yield pd.DataFrame({capture: None if pd.isna(key) else key, "residual": (seen - 510) / 2.0, "n": total[seen]})

    counted = pieces.select(capture, "piece", "background").mapInPandas(count, f"{capture} {kind}, residual double, n long")
    return counted.groupBy(capture, "residual").agg(F.sum("n").alias("n"))


def noise_sigma(counts: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Robust sigma of the residuals from their counts."""
    counts = settle(counts)
    middle = percentiles_of_counts(counts, [capture], "residual", "n", {"_m": 0.5}, fits=True)  # at most 1021 rows
    apart = counts.join(small(middle), capture).withColumn("_a", F.abs(F.col("residual") - F.col("_m")))
    folded = apart.groupBy(capture, "_a").agg(F.sum("n").alias("n"))
    mad = percentiles_of_counts(folded, [capture], "_a", "n", {"_mad": 0.5}, fits=True)
    return mad.select(capture, (F.lit(MAD_TO_SIGMA) * F.col("_mad")).alias("noise_sigma"))


def deviation_masks(frames: DataFrame, background: DataFrame, thresholds: DataFrame, capture: str = "capture_id", band_rows: int = BAND_ROWS) -> DataFrame:
    """Bands of 0/1 bytes: pixels further from the background than the capture's threshold."""
    pieces = bands(frames, capture, band_rows).join(background.drop("median_frames"), [capture, "band"])
    pieces = pieces.join(small(thresholds), capture)

    @F.pandas_udf("binary")
    def over(piece: pd.Series, back: pd.Series, limit: pd.Series) -> pd.Series:
        return pd.Series(
            [
                (np.abs(np.frombuffer(p, np.uint8) - np.frombuffer(b, np.float32)) > t).astype(np.uint8).tobytes()
                for p, b, t in zip(piece, back, limit, strict=True)
            ]
        )

    return pieces.select(
        capture, "frame", "height", "width", "band", over("piece", "background", "threshold").alias("mask")
    )


def _shifted_all(mask: np.ndarray, combine, border: int) -> np.ndarray:
    p = np.pad(mask, 1, constant_values=border)
    out = None
    for dy in range(3):
        for dx in range(3):
            part = p[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
            out = part.copy() if out is None else combine(out, part)
    return out


def _without_specks(mask: np.ndarray, least: int) -> np.ndarray:
    """Drop 8-connected components smaller than ``least`` pixels.

    Rows are cut into runs of set pixels; runs of neighbouring rows that touch share a label, and labels sink to
    the smallest of their component. All steps are on whole arrays of runs.
    """
    high, wide = mask.shape
    edges = np.diff(np.pad(mask.astype(bool), ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]  # one past the last pixel; runs are in the order of rows and columns
    if not len(row):
        return mask.copy()
    step = wide + 2
    above = (row - 1) * step
    first = np.searchsorted(row * step + end, above + start, side="left")
    last = np.searchsorted(row * step + start, above + end, side="right")
    count = np.maximum(last - first, 0)
    lower = np.repeat(np.arange(len(row)), count)
    upper = np.repeat(first, count) + np.arange(len(lower)) - np.repeat(np.cumsum(count) - count, count)
    label = np.arange(len(row))
    while True:
        least_of = np.minimum(label[lower], label[upper])
        sunk = label.copy()
        np.minimum.at(sunk, label[lower], least_of)
        np.minimum.at(sunk, label[upper], least_of)
        sunk = sunk[sunk]
        sunk = sunk[sunk[label]]
        if (sunk == label).all():
            break
        label = sunk
    size = np.bincount(label, end - start, minlength=len(row))
    change = np.zeros((high, step), np.int32)
    keep = size[label] >= least
    np.add.at(change, (row[keep], start[keep]), 1)
    np.add.at(change, (row[keep], end[keep]), -1)
    return (np.cumsum(change, axis=1)[:, :wide] > 0).astype(mask.dtype)


def _disc(radius: int) -> list[tuple[int, int]]:
    """Row offset and half width of an elliptical brush."""
    return [(dy, round(radius * np.sqrt(max(radius * radius - dy * dy, 0)) / radius)) for dy in range(-radius, radius + 1)]


def clean_plane(mask: np.ndarray) -> np.ndarray:
    """Open, drop specks, dilate; sizes follow the frame."""
    high, wide = mask.shape
    least = max(MIN_COMPONENT_PIXELS, round(MIN_COMPONENT_SHARE * high * wide))
    radius = max(1, round(DILATE_SHARE * high))
    opened = _shifted_all(_shifted_all(mask, np.minimum, 1), np.maximum, 0)
    kept = _without_specks(opened, least)
    if not kept.any():
        return kept
    out = np.zeros(kept.shape, dtype=bool)
    upto = np.concatenate([np.zeros((high, 1), np.int32), np.cumsum(kept, axis=1, dtype=np.int32)], axis=1)
    column = np.arange(wide)
    for dy, half in _disc(radius):
        # set where the brush row meets any pixel: a difference of running counts
        met = upto[:, np.minimum(column + half + 1, wide)] > upto[:, np.maximum(column - half, 0)]
        out[max(0, dy) : high + min(0, dy)] |= met[max(0, -dy) : high - max(0, dy)]
    return out.astype(kept.dtype)


def clean_masks(pieces: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Whole cleaned masks, one frame per group: ``capture, frame, height, width, mask, fraction``."""
    kind, frame_kind = dict(pieces.dtypes)[capture], dict(pieces.dtypes)["frame"]

    def clean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("band")
        high, wide = int(rows["height"].iloc[0]), int(rows["width"].iloc[0])
        plane = np.frombuffer(b"".join(rows["mask"]), np.uint8).reshape(high, wide)
        done = clean_plane(plane)
        return pd.DataFrame(
            {
                capture: rows[capture].iloc[:1],
                "frame": rows["frame"].iloc[:1],
                "height": [high],
                "width": [wide],
                "mask": [done.tobytes()],
                "fraction": [float(done.mean())],
            }
        )

    schema = f"{capture} {kind}, frame {frame_kind}, height int, width int, mask binary, fraction double"
    # small planes make few bytes and much work: a fixed number of tasks is not merged for its size
    spark = pieces.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return pieces.repartition(tasks, capture, "frame").groupBy(capture, "frame").applyInPandas(clean, schema)


def union_mask(masks: DataFrame, capture: str = "capture_id", band_rows: int = BAND_ROWS) -> DataFrame:
    """OR of all masks of a capture, band by band.

    A batch is combined before the shuffle, and the rest streams through the task of its band, so
    a capture of any length needs one band of memory and its bands run side by side.
    """
    kind = dict(masks.dtypes)[capture]
    columns = [capture, "height", "width", "band", "piece"]
    schema = f"{capture} {kind}, height int, width int, band int, piece binary"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (key, band), rows in batch.groupby([capture, "band"], sort=False, dropna=False):
                joined = np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in rows["piece"]])
                key = None if pd.isna(key) else key
                out.append((key, rows["height"].iloc[0], rows["width"].iloc[0], band, joined.tobytes()))
            yield pd.DataFrame(out, columns=columns)

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                key = (None if pd.isna(row[0]) else row[0], row[3])
                piece = np.frombuffer(row[4], np.uint8)
                if current is None or key != current[0]:
                    if current is not None:
                        yield pd.DataFrame([(*current[1], held.tobytes())], columns=columns)
                    current, held = (key, row[:4]), piece.copy()
                else:
                    held |= piece
        if current is not None:
            yield pd.DataFrame([(*current[1], held.tobytes())], columns=columns)

    cut = bands(masks.withColumnRenamed("mask", "gray"), capture, band_rows).drop("frame").select(*columns)
    first = cut.mapInPandas(partial, schema)
    return first.repartition(capture, "band").sortWithinPartitions(capture, "band").mapInPandas(final, schema)


def mask_pixels(union: DataFrame, capture: str = "capture_id", band_rows: int = BAND_ROWS) -> DataFrame:
    """Set pixels of a union mask as rows, for point labelling."""
    kind = dict(union.dtypes)[capture]

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, wide, band, piece in zip(batch[capture], batch["width"], batch["band"], batch["piece"], strict=True):
                at = np.nonzero(np.frombuffer(piece, np.uint8))[0]
                yield pd.DataFrame({capture: key, "row": at // wide + band * band_rows, "col": at % wide})

    return union.mapInPandas(spread, f"{capture} {kind}, row int, col int")


def solver_masks(masks: DataFrame) -> DataFrame:
    """Masks for the external solver: 0 where the subject moves, 255 where it may look."""
    return masks.withColumn("mask", _inverted("mask"))


def _inverted(column: str):
    @F.pandas_udf("binary")
    def flip(m: pd.Series) -> pd.Series:
        return pd.Series([np.where(np.frombuffer(v, np.uint8) > 0, 0, 255).astype(np.uint8).tobytes() for v in m])

    return flip(F.col(column))


def dynamic_mask(
    frames: DataFrame,
    rest: DataFrame,
    line: Timeline,
    capture: str = "capture_id",
    clean: bool = True,
    band_rows: int = BAND_ROWS,
) -> dict[str, DataFrame]:
    """Masks, their union and a report per capture.

    ``frames`` are the hold frames, ``rest`` the frames where nothing moved. A capture without
    rest frames measures its noise on a few hold frames; one with fewer than three hold frames is
    refused in the report.
    """
    counts = frames.groupBy(capture).agg(F.count(F.lit(1)).alias("frames"))
    enough = counts.filter(F.col("frames") >= MEDIAN_LEAST)
    usable = frames.join(enough.select(capture), capture, "left_semi")
    background = settle(temporal_median(evenly_chosen(usable, line, MEDIAN_FRAMES, MEDIAN_LEAST), capture, band_rows))
    with_rest = rest.select(capture).distinct()
    fallback = evenly_chosen(usable, line, FALLBACK_FRAMES).join(with_rest, capture, "left_anti")
    columns = [capture, "frame", "gray", "height", "width"]
    quiet = rest.select(*columns).unionByName(fallback.select(*columns))
    pieces = bands(quiet, capture, band_rows).join(background, [capture, "band"])
    sigma = noise_sigma(residual_counts(pieces, capture), capture)
    limits = settle(sigma).withColumn("threshold", F.greatest(F.lit(NOISE_MULTIPLE) * F.col("noise_sigma"), F.lit(MIN_THRESHOLD_LEVELS)))
    raw = deviation_masks(usable, background, limits.select(capture, "threshold"), capture, band_rows)
    if clean:
        masks = clean_masks(raw, capture)
    else:
        whole = raw.groupBy(capture, "frame").agg(
            F.first("height").alias("height"), F.first("width").alias("width"),
            F.array_sort(F.collect_list(F.struct("band", "mask"))).alias("_b"),
        )
        plane = F.aggregate("_b", F.lit(b""), lambda a, b: F.concat(a, b["mask"]))
        masks = whole.withColumn("mask", plane).drop("_b")
        set_pixels = F.length(F.replace(F.hex("mask"), F.lit("00"), F.lit(""))) / 2
        masks = masks.withColumn("fraction", set_pixels / (F.col("height") * F.col("width")))
    masks = settle(masks)
    union = settle(union_mask(masks, capture, band_rows))
    covered = union.select(capture, (F.length(F.replace(F.hex("piece"), F.lit("00"), F.lit(""))) / 2).alias("_set"), "height", "width")
    union_share = covered.groupBy(capture).agg(
        (F.sum("_set") / (F.max("height") * F.max("width"))).alias("union_fraction")
    )
    spread = masks.groupBy(capture).agg(
        F.avg("fraction").alias("dynamic_fraction_mean"), F.max("fraction").alias("dynamic_fraction_max")
    )
    used = background.groupBy(capture).agg(F.max("median_frames").alias("median_frames"))
    share = F.col("union_fraction")
    report = (
        counts.join(limits, capture, "left")
        .join(used, capture, "left")
        .join(spread, capture, "left")
        .join(union_share, capture, "left")
        .join(with_rest.withColumn("_rest", F.lit(True)), capture, "left")
        .withColumn("noise_source", F.when(F.col("_rest"), "rest_window").otherwise("hold_frames"))
        .withColumn(
            "warning",
            F.when(F.col("frames") < MEDIAN_LEAST, "too_few_frames")
            .when(share == 0, "empty")
            .when(share > CROWDED_SHARE, "crowded"),
        )
        .drop("_rest")
    )
    return {"masks": masks, "union": union, "report": report, "background": background}


def image_pair_quality(pairs: DataFrame, keys: list[str], pred: str = "pred", target: str = "target", weight: str | None = None, mask: str | None = None) -> DataFrame:
    """PSNR and weighted L1 per pair from pixel rows in [0, 1].

    ``mask`` weighs the squared error of a three-channel image by its pixel; ``weight`` the
    absolute error.
    """
    apart = F.col(pred) - F.col(target)
    square = apart * apart
    if mask is None:
        mse = F.avg(square)
    else:
        # pixel rows carry one channel each, so three rows share a mask value
        mse = F.sum(square * F.col(mask)) / F.greatest(F.sum(F.col(mask)), F.lit(1e-8))
    if weight is None:
        l1 = F.avg(F.abs(apart))
    else:
        l1 = F.sum(F.abs(apart) * F.col(weight)) / F.greatest(F.sum(F.col(weight)), F.lit(1e-8))
    return pairs.groupBy(*keys).agg(
        (-10.0 * F.log10(F.greatest(mse, F.lit(1e-12)))).alias("psnr"), l1.alias("l1")
    )
