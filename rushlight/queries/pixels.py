"""Pixel operators on the vectors read as 8x8 grey frames, one label per capture."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushlight.functions.pixels import pair_ssim
from rushlight.operators import frames as fr
from rushlight.operators import masks
from rushlight.plans.timeline import Timeline
from rushlight.queries.registry import query
from rushlight.queries.views import rounded
from rushlight.session import table

GREY = """grey_v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(round_even(greatest(0, least(1, CAST(e AS DOUBLE) + 0.5)) * 255, 0) AS INT)) AS g FROM embeddings)"""
PIXELS = f"""{GREY}, numbered_v AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, count(*) OVER (PARTITION BY label) AS n FROM grey_v),
pixels_v AS (SELECT label, vec_id, frame, n, i // 8 AS y, i % 8 AS x, g[i + 1] AS v, g FROM numbered_v, range(0, 64) r(i))"""


def grey(spark, folder):
    return grey_planes(table(spark, folder, "embeddings"))


def grey_planes(rows):
    level = F.transform(
        "embedding",
        lambda e: F.lpad(F.hex(F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), e.cast("double") + 0.5)) * 255).cast("int")), 2, "0"),
    )
    return rows.select(
        F.col("label").alias("capture_id"), F.col("vec_id").alias("frame"), F.unhex(F.array_join(level, "")).alias("gray"),
        F.lit(8).alias("height"), F.lit(8).alias("width"),
    )


def line_of(rows):
    return Timeline.measure(rows, ["capture_id"], "frame")


def mirror(i):
    """Index of a neighbour past the border, reflected without repeating the edge."""
    return f"abs(CASE WHEN {i} > 7 THEN 14 - ({i}) ELSE {i} END)"


def at(y, x):
    return f"g[{mirror(y)} * 8 + {mirror(x)} + 1]"


HIST = """bins_v AS (SELECT vec_id, v // 8 AS bin, count(*) AS c FROM pixels_v GROUP BY ALL),
hist_v AS (SELECT vec_id, bin, c / sqrt(sum(CAST(c AS DOUBLE) * c) OVER (PARTITION BY vec_id)) AS h FROM bins_v)"""


@query(
    "agg1_frame_signals",
    f"""WITH {PIXELS}, {HIST}, l AS (SELECT *, {at("y - 1", "x")} + {at("y + 1", "x")} + {at("y", "x - 1")} + {at("y", "x + 1")} - 4 * v AS lap FROM pixels_v)
    SELECT vec_id AS frame, round(sqrt(var_pop(lap)), 6) AS blur_root, round(avg(v), 6) AS brightness,
      round(avg(CASE WHEN v >= 245 THEN 1.0 ELSE 0 END), 6) AS overexposed_ratio, round(avg(CASE WHEN v <= 20 THEN 1.0 ELSE 0 END), 6) AS underexposed_ratio,
      round(any_value(hs), 6) AS hist_sum FROM l JOIN (SELECT vec_id, sum(h) AS hs FROM hist_v GROUP BY 1) USING (vec_id) GROUP BY 1""",
)
def frame_signals(spark, folder):
    made = fr.frame_signals(grey(spark, folder)).select(
        "frame", F.sqrt("blur_vol").alias("blur_root"), "brightness", "overexposed_ratio", "underexposed_ratio",
        F.aggregate("hist", F.lit(0.0), lambda a, h: a + h).alias("hist_sum"),
    )
    return rounded(made)


PREVIOUS = """prev_v AS (SELECT vec_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM grey_v)"""


def correlation_sql(pairs):
    """CTEs ``corr_v(a, b, c)`` and ``motion_v(a, b, m)`` for the frame pairs of a CTE (a, b)."""
    return f"""own_v AS (SELECT vec_id, sum(h) AS s, sum(h * h) AS q FROM hist_v GROUP BY 1),
    crossed_v AS (SELECT p.a, p.b, sum(coalesce(y.h, 0) * x.h) AS xy FROM {pairs} p JOIN hist_v x ON x.vec_id = p.a LEFT JOIN hist_v y ON y.vec_id = p.b AND y.bin = x.bin GROUP BY ALL),
    corr_v AS (SELECT a, b, CASE WHEN abs((o.q - o.s * o.s / 32) * (w.q - w.s * w.s / 32)) <= 2.220446049250313e-16 THEN 1.0
      ELSE (xy - o.s * w.s / 32) / sqrt((o.q - o.s * o.s / 32) * (w.q - w.s * w.s / 32)) END AS c FROM crossed_v JOIN own_v o ON o.vec_id = a JOIN own_v w ON w.vec_id = b),
    motion_v AS (SELECT p.a, p.b, avg(abs(x.v - y.v)) AS m FROM {pairs} p JOIN pixels_v x ON x.vec_id = p.a JOIN pixels_v y ON y.vec_id = p.b AND y.y = x.y AND y.x = x.x GROUP BY ALL)"""


@query(
    "agg2_motion_signals",
    f"""WITH {PIXELS}, {HIST}, {PREVIOUS}, pairs AS (SELECT vec_id AS a, before AS b FROM prev_v WHERE before IS NOT NULL), {correlation_sql("pairs")}
    SELECT vec_id AS frame, round(m, 6) AS motion_diff, round(c, 6) AS hist_correlation FROM prev_v LEFT JOIN corr_v c ON c.a = vec_id LEFT JOIN motion_v m ON m.a = vec_id""",
)
def motion_signals(spark, folder):
    rows = grey(spark, folder)
    made = fr.motion_signals(fr.frame_signals(rows), line_of(rows))
    return rounded(made.select("frame", "motion_diff", "hist_correlation"))


SMOOTHED = " + ".join(
    f"{wy * wx} * {at(f'y + {dy - 1}', f'x + {dx - 1}')}" for dy, wy in enumerate((1, 2, 1)) for dx, wx in enumerate((1, 2, 1))
)


@query(
    "win3_change_profile",
    f"""WITH {PIXELS}, s AS (SELECT label, vec_id, y, x, ({SMOOTHED} + 8) // 16 AS s FROM pixels_v),
    d AS (SELECT vec_id, abs(s - lag(s) OVER (PARTITION BY label, y, x ORDER BY vec_id)) AS d FROM s)
    SELECT vec_id AS frame, round(avg(CASE WHEN coalesce(d, 0) > 8 THEN 1.0 ELSE 0 END), 6) AS changed_fraction, round(avg(coalesce(d, 0)), 6) AS mean_abs_diff FROM d GROUP BY 1""",
)
def change_profile(spark, folder):
    rows = grey(spark, folder)
    return rounded(fr.change_profile(rows, line_of(rows)).select("frame", "changed_fraction", "mean_abs_diff"))


KEEP = """cand AS MATERIALIZED (SELECT label, vec_id, blurred, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM blur_v)"""
BLUR = f"""vol_v AS (SELECT label, vec_id, var_pop({at("y - 1", "x")} + {at("y + 1", "x")} + {at("y", "x - 1")} + {at("y", "x + 1")} - 4 * v) AS vol FROM pixels_v GROUP BY ALL),
mid_v AS (SELECT *, quantile_cont(vol, 0.5) OVER w AS mid, count(*) OVER w AS seen FROM vol_v WINDOW w AS (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 30 PRECEDING AND CURRENT ROW)),
blur_v AS (SELECT label, vec_id, seen >= 9 AND mid > 0 AND vol / mid < 0.9 AS blurred FROM mid_v)"""


SELECT_WALK = f"""WITH RECURSIVE {PIXELS}, {HIST}, {BLUR}, {KEEP},
    pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM blur_v a JOIN blur_v b ON a.label = b.label AND b.vec_id < a.vec_id), {correlation_sql("pairs")},
    dup_v AS MATERIALIZED (SELECT c.a, c.b, c.c > 0.2 AND m.m < 40 AS dup FROM corr_v c JOIN motion_v m ON c.a = m.a AND c.b = m.b),
    walk AS (SELECT label, rn, vec_id, NOT blurred AS kept, CASE WHEN blurred THEN NULL ELSE vec_id END AS last FROM cand WHERE rn = 1
      UNION ALL SELECT c.label, c.rn, c.vec_id, NOT c.blurred AND NOT coalesce(d.dup, FALSE),
        CASE WHEN NOT c.blurred AND NOT coalesce(d.dup, FALSE) THEN c.vec_id ELSE w.last END
      FROM walk w JOIN cand c ON c.label = w.label AND c.rn = w.rn + 1 LEFT JOIN dup_v d ON d.a = c.vec_id AND d.b = w.last)"""


@query(
    "win8_select_frames",
    f"""{SELECT_WALK},
    numbered AS (SELECT *, sum(CASE WHEN kept THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY rn) AS k FROM walk)
    SELECT n.vec_id AS frame, blurred, NOT blurred AND NOT kept AS duplicate, kept,
      CASE WHEN kept THEN 'frames/images/frame_' || lpad(CAST(k AS VARCHAR), 6, '0') || '.jpg' END AS file
    FROM numbered n JOIN blur_v b ON b.vec_id = n.vec_id WHERE k < 12 OR (k = 12 AND kept)""",
)
def select_frames(spark, folder):
    rows = grey(spark, folder)
    made = fr.select_frames(fr.frame_signals(rows), line_of(rows), max_frames=12, blur_threshold=0.9, correlation=0.2, max_diff=40.0)
    return made.select("frame", "blurred", "duplicate", "kept", "file")


CHOSEN = """take_v AS (SELECT *, least(32, n) AS take FROM numbered_v),
picked_v AS (SELECT DISTINCT t.label, t.vec_id FROM take_v t, range(0, 32) r(i) WHERE i < take AND t.frame = CAST(round_even(i * ((n - 1) / CAST(greatest(take - 1, 1) AS DOUBLE)), 0) AS BIGINT)),
back_v AS (SELECT label, y, x, median(v) AS bg, count(*) AS median_frames FROM pixels_v JOIN picked_v USING (label, vec_id) GROUP BY ALL)"""


@query(
    "agg6_temporal_median",
    f"WITH {PIXELS}, {CHOSEN} SELECT label AS capture_id, y, x, bg, median_frames FROM back_v",
)
def temporal_median(spark, folder):
    rows = grey(spark, folder)
    chosen = masks.evenly_chosen(rows, line_of(rows), masks.MEDIAN_FRAMES, masks.MEDIAN_LEAST)
    background = masks.temporal_median(chosen, band_rows=3)

    def unpack(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for key, band, piece, n in zip(batch["capture_id"], batch["band"], batch["background"], batch["median_frames"], strict=True):
                values = np.frombuffer(piece, np.float32)
                place = np.arange(len(values))
                yield pd.DataFrame({"capture_id": key, "y": place // 8 + band * 3, "x": place % 8, "bg": values.astype(float), "median_frames": n})

    return background.mapInPandas(unpack, "capture_id int, y long, x long, bg double, median_frames long")


NOISE = """resid_v AS (SELECT p.label, v - bg AS r FROM pixels_v p JOIN back_v b USING (label, y, x) WHERE p.vec_id % 10 < 3),
sigma_v AS (SELECT label, 1.4826 * mad(r) AS sigma FROM resid_v GROUP BY 1),
over_v AS (SELECT p.label, p.vec_id, p.y, p.x, abs(v - bg) > greatest(sigma, 6) AS m FROM pixels_v p JOIN back_v b USING (label, y, x) JOIN sigma_v USING (label))"""


@query(
    "agg7_deviation_masks",
    f"""WITH {PIXELS}, {CHOSEN}, {NOISE} SELECT vec_id AS frame, CAST(sum(CASE WHEN m THEN 1 ELSE 0 END) AS BIGINT) AS set_pixels FROM over_v GROUP BY 1""",
)
def deviation_masks(spark, folder):
    rows = grey(spark, folder)
    background = masks.temporal_median(masks.evenly_chosen(rows, line_of(rows), 32, 3), band_rows=3)
    quiet = rows.filter(F.col("frame") % 10 < 3)
    counts = masks.residual_counts(masks.bands(quiet, band_rows=3).join(background, ["capture_id", "band"]))
    limits = masks.noise_sigma(counts).select("capture_id", F.greatest(F.col("noise_sigma"), F.lit(6.0)).alias("threshold"))
    made = masks.deviation_masks(rows, background, limits, band_rows=3)
    count = F.length(F.replace(F.hex("mask"), F.lit("00"), F.lit(""))) / 2
    return made.groupBy("frame").agg(F.sum(count).cast("long").alias("set_pixels"))


@query(
    "set2_union_mask",
    f"""WITH {PIXELS} SELECT label AS capture_id, y AS row, x AS col FROM pixels_v WHERE v > 180 GROUP BY ALL""",
)
def union_mask(spark, folder):
    rows = grey(spark, folder)
    bright = F.transform(F.split(F.regexp_replace(F.hex("gray"), "(..)", "$1 "), " "), lambda h: F.when(F.conv(h, 16, 10).cast("int") > 180, "01").otherwise("00"))
    marked = rows.withColumn("mask", F.unhex(F.substring(F.array_join(bright, ""), 1, 128))).drop("gray")
    return masks.mask_pixels(masks.union_mask(marked, band_rows=3), band_rows=3)


@query("agg7_dynamic_mask")
def dynamic_mask(spark, folder):
    rows = grey(spark, folder)
    rest = rows.filter(F.col("frame") % 10 < 3)
    return masks.dynamic_mask(rows, rest, line_of(rows))["report"]


@query("agg8_clean_mask")
def clean_mask(spark, folder):
    rows = grey(spark, folder)
    rest = rows.filter(F.col("frame") % 10 < 3)
    return masks.dynamic_mask(rows, rest, line_of(rows))["masks"].select("capture_id", "frame", "fraction")


@query(
    "agg30_image_pair_quality",
    f"""WITH {PIXELS}, {PREVIOUS}, p AS (SELECT a.vec_id, a.v / 255.0 AS p, b.v / 255.0 AS t, CAST(0.1 AS DOUBLE) + 0.9 * (a.y + 1) / 8.0 AS w
      FROM prev_v v JOIN pixels_v a ON a.vec_id = v.vec_id JOIN pixels_v b ON b.vec_id = v.before AND b.y = a.y AND b.x = a.x)
    SELECT vec_id AS frame, round(-10 * log10(greatest(avg(pow(p - t, 2)), 1e-12)), 6) AS psnr, round(sum(abs(p - t) * w) / sum(w), 6) AS l1 FROM p GROUP BY 1""",
)
def pair_quality(spark, folder):
    rows = grey(spark, folder)
    stepped = line_of(rows).rolling(rows, 1, 0, lambda ordered, _: {"before": F.lag("gray").over(ordered)}).filter("before IS NOT NULL")

    def levels(column):
        return F.transform(F.split(F.regexp_replace(F.hex(column), "(..)(?!$)", "$1 "), " "), lambda h: F.conv(h, 16, 10).cast("int") / 255.0)

    each = stepped.select("frame", F.posexplode(F.arrays_zip(levels("gray").alias("pred"), levels("before").alias("target"))).alias("i", "p"))
    pixels = each.select("frame", "p.pred", "p.target", (0.1 + 0.9 * (F.floor(F.col("i") / 8) + 1) / 8.0).alias("w"))
    return rounded(masks.image_pair_quality(pixels, ["frame"], weight="w"))


@query("agg30_pair_ssim")
def ssim(spark, folder):
    rows = grey(spark, folder)
    stepped = line_of(rows).rolling(rows, 1, 0, lambda ordered, _: {"before": F.lag("gray").over(ordered)}).filter("before IS NOT NULL")
    return rounded(stepped.select("frame", pair_ssim("gray", "before", "height", "width").alias("ssim")))
