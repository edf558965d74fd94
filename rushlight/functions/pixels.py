"""Arrow-batched pixel statistics; a task holds one batch of frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# Levels, bins, analysis size.
OVEREXPOSED_LEVEL = 245
UNDEREXPOSED_LEVEL = 20
HISTOGRAM_BINS = 32
CHANGE_LEVELS = 8
ANALYSIS_LONG_SIDE = 192
FLAT_HISTOGRAM = 2.220446049250313e-16

SIGNAL_TYPE = (
    "blur_vol double, brightness double, overexposed_ratio double, underexposed_ratio double, hist array<double>"
)


def as_image(gray: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(gray, dtype=np.uint8).reshape(int(height), int(width))


def laplacian_variance(image: np.ndarray) -> float:
    p = np.pad(image.astype(np.float64), 1, mode="reflect")
    edges = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    return float(edges.var())


def histogram(image: np.ndarray) -> np.ndarray:
    """Grey histogram at unit length."""
    counts = np.bincount((image // (256 // HISTOGRAM_BINS)).ravel(), minlength=HISTOGRAM_BINS).astype(np.float64)
    size = np.sqrt((counts * counts).sum())
    return counts / size if size > 0 else counts


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson correlation of two histograms; 1 when either is flat."""
    n = len(a)
    spread = ((a * a).sum() - a.sum() ** 2 / n) * ((b * b).sum() - b.sum() ** 2 / n)
    if abs(spread) <= FLAT_HISTOGRAM:
        return 1.0
    return float(((a * b).sum() - a.sum() * b.sum() / n) / np.sqrt(spread))


def mean_difference(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a.astype(np.int16) - b.astype(np.int16)).mean())


def frame_statistics(gray: str = "gray", height: str = "height", width: str = "width"):
    """Sharpness, exposure and histogram of a grey plane."""

    @F.pandas_udf(SIGNAL_TYPE)
    def measure(g: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        rows = []
        for data, high, wide in zip(g, h, w, strict=True):
            image = as_image(data, high, wide)
            rows.append(
                (
                    laplacian_variance(image),
                    float(image.mean()),
                    float((image >= OVEREXPOSED_LEVEL).mean()),
                    float((image <= UNDEREXPOSED_LEVEL).mean()),
                    histogram(image).tolist(),
                )
            )
        return pd.DataFrame(rows, columns=["blur_vol", "brightness", "overexposed_ratio", "underexposed_ratio", "hist"])

    return measure(F.col(gray), F.col(height), F.col(width))


def pair_statistics(gray: str, hist: str, before_gray: str, before_hist: str):
    """Motion and histogram correlation against another frame; NULL where it is missing."""

    @F.pandas_udf("motion_diff double, hist_correlation double")
    def measure(g: pd.Series, h: pd.Series, bg: pd.Series, bh: pd.Series) -> pd.DataFrame:
        motion, alike = [], []
        for a, ha, b, hb in zip(g, h, bg, bh, strict=True):
            same = b is not None and len(a) == len(b)
            motion.append(mean_difference(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)) if same else None)
            alike.append(correlation(np.asarray(ha), np.asarray(hb)) if hb is not None else None)
        return pd.DataFrame({"motion_diff": pd.Series(motion, dtype="float64"), "hist_correlation": pd.Series(alike, dtype="float64")})

    return measure(F.col(gray), F.col(hist), F.col(before_gray), F.col(before_hist))


def area_weights(size: int, target: int) -> np.ndarray:
    """Rows of shares: how much of each source pixel an output pixel covers."""
    edges = np.linspace(0, size, target + 1)
    low, high = edges[:-1, None], edges[1:, None]
    at = np.arange(size)[None, :]
    cover = np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None)
    return cover / cover.sum(axis=1, keepdims=True)


def analysis_plane(image: np.ndarray, long_side: int = ANALYSIS_LONG_SIDE) -> np.ndarray:
    """Shrunk to the analysis size and lightly blurred, so sensor noise does not look like motion."""
    high, wide = image.shape
    longest = max(high, wide)
    if longest > long_side:
        scale = long_side / longest
        rows, cols = max(1, round(high * scale)), max(1, round(wide * scale))
        shrunk = area_weights(high, rows) @ image.astype(np.float64) @ area_weights(wide, cols).T
        image = np.clip(np.rint(shrunk), 0, 255).astype(np.uint8)
    p = np.pad(image.astype(np.int64), 1, mode="reflect") if min(image.shape) > 1 else np.pad(image.astype(np.int64), 1, mode="edge")
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    both = rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]
    return ((both + 8) // 16).astype(np.uint8)


def analysis_frame(gray: str = "gray", height: str = "height", width: str = "width", long_side: int = ANALYSIS_LONG_SIDE):
    @F.pandas_udf("binary")
    def shrink(g: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([analysis_plane(as_image(a, b, c), long_side).tobytes() for a, b, c in zip(g, h, w, strict=True)])

    return shrink(F.col(gray), F.col(height), F.col(width))


def changed_share(plane: str, before: str, levels: int = CHANGE_LEVELS):
    """Share of pixels that changed by more than ``levels``, and the mean change; 0 for the first."""

    @F.pandas_udf("changed_fraction double, mean_abs_diff double")
    def measure(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for now, then in zip(a, b, strict=True):
            if then is None:
                rows.append((0.0, 0.0))
                continue
            apart = np.abs(np.frombuffer(now, np.uint8).astype(np.int16) - np.frombuffer(then, np.uint8))
            rows.append((float((apart > levels).mean()), float(apart.mean())))
        return pd.DataFrame(rows, columns=["changed_fraction", "mean_abs_diff"])

    return measure(F.col(plane), F.col(before))


SSIM_C1, SSIM_C2 = 0.01**2, 0.03**2  # Fixed values.
SSIM_WINDOW, SSIM_SIGMA = 11, 1.5  # Fixed values.


def structural_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Mean SSIM of two planes in [0, 1]; the window shrinks to fit and the border is zero."""
    size = min(SSIM_WINDOW, *a.shape)
    size = max(size - 1 if size % 2 == 0 else size, 3)
    at = np.arange(size) - size // 2
    tap = np.exp(-(at**2) / (2 * SSIM_SIGMA**2))
    tap /= tap.sum()

    def smooth(x: np.ndarray) -> np.ndarray:
        p = np.pad(x, size // 2)
        rows = sum(t * p[i : i + x.shape[0], :] for i, t in enumerate(tap))
        return sum(t * rows[:, i : i + x.shape[1]] for i, t in enumerate(tap))

    ma, mb = smooth(a), smooth(b)
    va, vb, cov = smooth(a * a) - ma * ma, smooth(b * b) - mb * mb, smooth(a * b) - ma * mb
    score = ((2 * ma * mb + SSIM_C1) * (2 * cov + SSIM_C2)) / ((ma * ma + mb * mb + SSIM_C1) * (va + vb + SSIM_C2))
    return float(score.mean())


def pair_ssim(a: str, b: str, height: str, width: str):
    """SSIM of two grey planes of one size."""

    @F.pandas_udf("double")
    def measure(x: pd.Series, y: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(
            [
                structural_similarity(as_image(p, r, c) / 255.0, as_image(q, r, c) / 255.0)
                for p, q, r, c in zip(x, y, h, w, strict=True)
            ]
        )

    return measure(F.col(a), F.col(b), F.col(height), F.col(width))
