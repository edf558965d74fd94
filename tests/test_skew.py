"""Splitting hot keys into blocks never changes a result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rushlight.operators import joins, motion, neighbours, phases, poses, splats, study
from rushlight.operators import frames as fr
from rushlight.plans.quantiles import average_rank, exact_percentiles
from rushlight.plans.recurrence import ema
from rushlight.plans.timeline import Timeline

KEYS = ["capture_id"]


@pytest.fixture(scope="module")
def stream(spark):
    """Capture 1 holds most of the rows; values repeat; some are NULL."""
    rng = np.random.default_rng(5)
    n = 900
    capture = np.where(rng.random(n) < 0.7, 1, rng.integers(2, 9, n))
    frame = pd.DataFrame({"capture_id": capture, "t": np.sort(rng.integers(0, 5000, n)), "id": np.arange(n), "v": rng.integers(0, 40, n) / 4.0})
    frame["flag"] = rng.random(n) < 0.5
    rows = spark.createDataFrame(frame).withColumn("w", F.when(F.col("id") % 3 == 0, F.col("v")))
    return rows.repartition(5).cache()


def same(left, right, order):
    a, b = (df.toPandas()[sorted(df.columns)].sort_values(order, ignore_index=True) for df in (left, right))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-12)


def lines(stream, limit=37):
    plain = Timeline.measure(stream, KEYS, "t", ["id"])
    split = Timeline.measure(stream, KEYS, "t", ["id"], limit=limit)
    assert plain.fits and len(split.splits) > 5
    return plain, split


@pytest.mark.parametrize("backwards", [False, True])
def test_number_rolling_running(stream, backwards):
    plain, split = lines(stream)
    if backwards:
        plain, split = plain.reversed(), split.reversed()

    def build(ordered, framed):
        return {"m": F.percentile("v", F.lit(0.5)).over(framed), "c": F.count("v").over(framed), "b": F.lag("v", 2).over(ordered), "a": F.lead("v").over(ordered)}

    same(plain.number(stream), split.number(stream), ["id"])
    same(plain.rolling(stream, 10, 3, build), split.rolling(stream, 10, 3, build), ["id"])
    made = {"s": ("sum", F.col("w")), "n": ("count", F.col("w")), "lo": ("min", F.col("w")), "hi": ("max", F.col("w")), "last": ("last", F.col("w"))}
    same(plain.running(stream, made), split.running(stream, made), ["id"])


def test_islands_and_smoothing(stream):
    plain, split = lines(stream)
    same(plain.islands(stream, F.col("flag")), split.islands(stream, F.col("flag")), ["id"])
    same(phases.smooth_flags(stream, plain, "flag"), phases.smooth_flags(stream, split, "flag"), ["id"])


def test_ema_matches_loop(stream):
    plain, split = lines(stream)
    same(ema(stream, plain, {"g": "v"}, 0.05), ema(stream, split, {"g": "v"}, 0.05), ["id"])
    got = ema(stream, split, {"g": "v"}, 0.05).toPandas().sort_values(["capture_id", "t", "id"])
    for _, rows in got.groupby("capture_id"):
        g, want = None, []
        for v in rows["v"]:
            g = v if g is None else g + 0.05 * (v - g)
            want.append(g)
        np.testing.assert_allclose(rows["g"], want, rtol=1e-10)


def test_percentiles_and_ranks(stream):
    wanted = {"p10": ("v", 0.1), "p50": ("w", 0.5), "p98": ("v", 0.98)}
    same(exact_percentiles(stream, KEYS, wanted), exact_percentiles(stream, KEYS, wanted, limit=20), KEYS)
    same(exact_percentiles(stream, [], wanted), exact_percentiles(stream, [], wanted, limit=20), ["p10"])
    same(average_rank(stream, KEYS, "v"), average_rank(stream, KEYS, "v", limit=20), ["id"])


def test_interp_join(stream):
    frames = stream.filter("id % 2 = 0").select("capture_id", "id", "t")
    samples = stream.filter("id % 2 = 1").groupBy("capture_id", "t").agg(F.avg("v").alias("v"))
    same(joins.interp_join(frames, samples, "capture_id", "t", ["v"]), joins.interp_join(frames, samples, "capture_id", "t", ["v"], limit=25), ["id"])
    got = joins.interp_join(frames, samples, "capture_id", "t", ["v"], limit=25).toPandas()
    s = samples.toPandas().sort_values("t")
    for capture, rows in got.groupby("capture_id"):
        own = s[s["capture_id"] == capture]
        np.testing.assert_allclose(rows["v"], np.interp(rows["t"], own["t"], own["v"]))
        assert rows["t"].between(own["t"].min(), own["t"].max()).all()


@pytest.mark.parametrize("block", [8, 40])
def test_knn_brute_force(spark, block):
    rng = np.random.default_rng(block)
    cloud = rng.normal(size=(150, 3))
    far = rng.normal(size=(12, 3)) * 50 + 300
    copies = np.repeat(cloud[:1], 90, axis=0)  # a third of all rows is one point
    at = np.vstack([cloud, far, copies, cloud[5:7]])
    frame = pd.DataFrame(at, columns=list("xyz")).assign(gid=np.arange(len(at)), scene_id="a")
    frame = pd.concat([frame, pd.DataFrame({"x": [1.0, 2.0, 9.0], "y": 0.0, "z": 0.0, "gid": [900, 901, 902], "scene_id": ["b", "b", "c"]})])
    got = neighbours.knn_mean_sq_dist(spark.createDataFrame(frame), 3, block_rows=block).toPandas().set_index("gid")["mean_sq_dist"]
    assert len(got) == len(frame)
    for _, rows in frame.groupby("scene_id"):
        p = rows[list("xyz")].to_numpy()
        d = ((p[:, None] - p[None]) ** 2).sum(-1)
        np.fill_diagonal(d, np.inf)
        take = min(3, len(p) - 1)
        want = np.maximum(np.sort(d, axis=1)[:, :take].mean(axis=1), 1e-14) if take else np.full(len(p), 1e-14)
        np.testing.assert_allclose(got[rows["gid"]], want, rtol=1e-9)


def test_select_frames_blocks(spark):
    rng = np.random.default_rng(1)
    frames, image = [], rng.integers(0, 255, (12, 16), dtype=np.uint8)
    for i in range(60):
        if i % 4 == 0:
            image = rng.integers(0, 255, (12, 16), dtype=np.uint8)
        blurred = np.full_like(image, 90) if i % 17 == 16 else image
        frames.append((1 if i < 45 else 2, i, bytearray(blurred.tobytes()), 12, 16))
    rows = fr.frame_signals(spark.createDataFrame(frames, "capture_id int, frame long, gray binary, height int, width int"))
    line = Timeline.measure(rows, KEYS, "frame")
    keep = ["capture_id", "frame", "blurred", "duplicate", "kept", "file"]
    whole = fr.select_frames(rows, line).select(keep)
    same(whole, fr.select_frames(rows, line, block_rows=3).select(keep), ["capture_id", "frame"])
    assert 10 <= whole.filter("kept").count() < 30
    few = fr.select_frames(rows, line, max_frames=2).filter("kept")
    assert few.groupBy("capture_id").count().agg(F.max("count")).first()[0] == 2


def test_median_pose_rounds(spark):
    rng = np.random.default_rng(3)
    q = np.array([1.0, 0, 0, 0]) + rng.normal(size=(40, 4)) * 0.02
    q[7] = [0.5, 0.8, 0, 0]
    q[::3] *= -1
    frame = pd.DataFrame(q, columns=["qw", "qx", "qy", "qz"]).assign(tx=rng.normal(size=40), ty=1.0, tz=2.0, image_id=np.arange(40), capture_id=np.arange(40) % 2)
    aligned = poses.centres(spark.createDataFrame(frame)).withColumns({c: F.abs("uw") / F.col("uw") * F.col(c) for c in ("ux", "uy", "uz")}).withColumn("uw", F.abs("uw"))
    aligned = aligned.filter("uw > 0").select("capture_id", "uw", "ux", "uy", "uz")
    made = poses._median_by_rounds(aligned, "capture_id").toPandas().set_index("capture_id")
    for capture, rows in aligned.toPandas().groupby("capture_id"):
        # a median is where the unit pulls of all rows cancel but for its own direction
        middle, q = made.loc[capture, list(poses.MEDIAN)].to_numpy(float), rows[["uw", "ux", "uy", "uz"]].to_numpy()
        pull = (q / np.linalg.norm(q - middle, axis=1)[:, None]).sum(axis=0)
        np.testing.assert_allclose(pull / np.linalg.norm(pull), middle, atol=1e-9)


def test_resampling_keeps_rows_whole(spark):
    rows = spark.range(4000).select((F.col("id") % 2).alias("scene_id"), F.col("id").alias("gid"), F.when(F.col("id") % 10 == 0, 0.001).otherwise(0.2 + (F.col("id") % 7) / 10.0).alias("opacity"))
    made = splats.resample_by_weight(rows, cap=2050).toPandas()
    assert not made.duplicated(["scene_id", "gid"]).any() and len(made) == 2 * 2050
    assert (made["opacity"] >= 0.005).all() and made["grown"].sum() == 100
    old = made[~made["grown"]]
    assert set(range(4000)) == set(old["gid"])
    copied = old[old["gid"] % 10 == 0]
    assert (copied["parent"] % 10 != 0).all()
    share = copied["parent"].map(lambda g: 0.2 + (g % 7) / 10).mean()
    assert 0.5 < share < 0.75  # weighted picks favour opaque parents (plain mean is 0.5)


def test_yaw_integration(spark):
    t = np.arange(0, 4_000_000_000, 10_000_000)
    rate = np.where(t < 1_000_000_000, 0.5, np.where(t < 3_000_000_000, -0.5, 0.5))
    gyro = pd.DataFrame({"capture_id": 1, "t_ns": t, "sensor": "gyro", "x": 0.0, "y": 0.0, "z": -rate})
    turn = pd.DataFrame({"capture_id": 1, "t_ns": [0], "sensor": "rotation", "x": 0.0, "y": 0.0, "z": 0.0})
    rows = spark.createDataFrame(pd.concat([turn, gyro]))
    for limit in (None, 50):
        line = Timeline.measure(rows, KEYS, "t_ns", limit=limit)
        got = motion.sweep(rows, line).first()
        np.testing.assert_allclose([got["left_deg"], got["right_deg"], got["return_error_deg"]], [28.4, 28.9, 0.3], atol=0.6)
        assert got["median_rate_deg_s"] == 28.75


def test_auc_and_spearman_values(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 20, 200).astype(float)
    y = x + rng.normal(size=200) * 8
    rows = spark.createDataFrame(pd.DataFrame({"signal": "s", "id": range(200), "x": x, "y": y, "label": (y > 10).astype(int)}))
    got = study.spearman(rows, permutations=50).first()
    rx, ry = pd.Series(x).rank(), pd.Series(y).rank()
    assert abs(got["rho"] - np.corrcoef(rx, ry)[0, 1]) < 1e-12 and got["p_value"] == pytest.approx(1 / 51)
    pos, neg = x[y > 10], x[y <= 10]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert study.auc(rows, "x", "label").first()["auc"] == pytest.approx(want)
    one = study.auc(rows.withColumn("label", F.lit(1)), "x", "label").first()["auc"]
    assert np.isnan(one)


def test_permutations_in_blocks(spark):
    """Ranks cut into blocks of seven places give the p-value of whole permutations."""
    from rushlight.plans.permute import places, round_keys

    rng = np.random.default_rng(2)
    x = rng.integers(0, 9, 40).astype(float)
    y = x * 0.3 + rng.normal(size=40)
    rows = spark.createDataFrame(pd.DataFrame({"signal": "s", "id": range(40), "x": x, "y": y}))
    rx, ry = pd.Series(x).rank().to_numpy(), pd.Series(y).rank().to_numpy()
    moved = places(40, round_keys(3, np.arange(700)), np.arange(40))
    assert (np.sort(moved, 1) == np.arange(40)).all()
    rho = [np.corrcoef(rx, ry[m])[0, 1] for m in moved]
    want = (1 + sum(abs(r) >= abs(np.corrcoef(rx, ry)[0, 1]) - 1e-12 for r in rho)) / 701
    for block in (7, 1 << 18):
        got = study.spearman(rows, permutations=700, seed=3, rank_block=block).first()
        assert got["p_value"] == pytest.approx(want) and got["permutations"] == 700


def test_farthest_points_in_blocks(spark):
    """Few points sent per block and pass, ties and copies: the seeds of a plain walk, in far fewer jobs than seeds."""
    from rushlight.operators import splats

    rng = np.random.default_rng(4)
    place = np.round(rng.normal(size=(600, 3)), 1)
    place[50:60] = place[40]
    scene = np.where(np.arange(600) < 500, 1, 2)
    scene[595:] = 3  # too few
    rows = spark.createDataFrame([(int(s), i, *map(float, p)) for i, (s, p) in enumerate(zip(scene, place))], "scene_id int, gid int, x double, y double, z double")
    want = []
    for s in (1, 2):
        ids = np.flatnonzero(scene == s)
        p = place[ids]
        score, near = ((p - p.mean(0)) ** 2).sum(1), np.full(len(ids), np.inf)
        for node in range(min(256, len(ids))):
            best = int(np.lexsort((ids, -score))[0])
            want.append((s, node, int(ids[best])))
            near = np.minimum(near, ((p - p[best]) ** 2).sum(1))
            score = near
    for how in ({"block_points": 100, "top": 40}, {}):
        got = splats.farthest_points(rows, **how)
        assert [tuple(r) for r in got.select("scene_id", "node", "gid").orderBy("scene_id", "node").collect()] == want


def test_correlations_alone_move_counted_values_only(spark):
    import numpy as np

    from rushlight.plans.sizing import tables_made

    rows = spark.range(60_000).select(
        F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("signal"), "id",
        F.pmod(F.col("id") * 7, F.lit(11)).cast("double").alias("x"), F.pmod(F.col("id") * F.col("id"), F.lit(101)).cast("double").alias("y"),
    )
    with tables_made() as made:
        got = {r.signal: r for r in study.spearman(rows, permutations=0).collect()}
    assert made and max(spark.read.parquet(path).count() for path in made) <= 202
    frame = rows.toPandas()
    for signal, part in frame.groupby("signal"):
        want = np.corrcoef(part["x"].rank(), part["y"].rank())[0, 1]
        assert got[signal].n == len(part) and abs(got[signal].rho - want) < 1e-9


def test_a_place_is_worked_out_once_for_many_blocks(spark, monkeypatch):
    """Ranks in 14 blocks: one unit for each block and chunk of permutations, none for each pair of blocks."""
    from rushlight.plans.sizing import tables_made

    rows = spark.range(98).select(F.lit("s").alias("signal"), "id", (F.col("id") % 9).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    asked = []
    monkeypatch.setattr(study, "UNIT_TASKS", type("Seen", (int,), {"__gt__": lambda s, o: asked.append(o) or int(s) > o, "__lt__": lambda s, o: asked.append(o) or int(s) < o})(4096))
    with tables_made():
        study.spearman(rows, permutations=100, rank_block=7)
    assert asked and max(asked) == 14


def test_cleaning_small_planes_spreads(spark):
    from rushlight.operators import masks

    rows = [(1, f, 8, 8, 0, bytes(bytearray([int(8 <= i < 40) for i in range(64)]))) for f in range(40)]
    pieces = spark.createDataFrame(rows, "capture_id int, frame long, height int, width int, band int, mask binary")
    made = masks.clean_masks(pieces.repartition("capture_id"))
    used = made.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert sum(r["count"] for r in used) == 40 and len(used) > 4
