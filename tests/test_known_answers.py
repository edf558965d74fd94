"""Known answers: fixtures with a result that is known in advance."""

import hashlib
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rushlight.functions import cameras, pixels, text
from rushlight.functions import encoding as enc
from rushlight.functions import geometry as g
from rushlight.operators import masks, poses, study
from rushlight.plans.timeline import Timeline
from rushlight.sources import manifests, models, sensors, splats
from rushlight.streaming import folds
from rushlight.streaming.detectors import Stillness


def rotation(q):
    w, x, y, z = q / np.linalg.norm(q)
    return np.array(
        [
            [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
            [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
            [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
        ]
    )


def test_device_intrinsics(spark):
    document = json.dumps(
        {
            "intrinsic_calibration": {"fx": 2760.6787, "fy": 2758.1523, "cx": 2030.8940, "cy": 1550.8883},
            "pre_correction_active_array": {"width": 4080, "height": 3060},
            "distortion_kappa": [0.0796, -0.1144, 0.0451, 0, 0],
        }
    )
    rows = spark.createDataFrame([(document, 0), ("{}", 0), (document, 45)], "d string, r int")
    got = rows.select(cameras.device_intrinsics(F.col("d"), F.lit(1920), F.lit(1080), F.col("r")).alias("k")).collect()
    k = got[0]["k"]
    assert (round(k["fx"], 2), round(k["fy"], 2), round(k["cx"], 2), round(k["cy"], 2)) == (1299.14, 1297.95, 955.71, 549.83)
    assert got[1]["k"] is None and got[2]["k"] is None


def test_gravity_up(spark):
    """Accelerometer readings made from a known up direction give it back."""
    rng = np.random.default_rng(2)
    up = np.array([0.2, 0.9, -0.3]) / np.linalg.norm([0.2, 0.9, -0.3])
    mount = np.diag([1.0, -1.0, -1.0])
    images, index, frames, imu = [], [], [], []
    for i in range(12):
        q = rng.normal(size=4)
        q /= np.linalg.norm(q)
        t = 1_000_000_000 + i * 33_000_000
        reading = mount.T @ (rotation(q) @ up) * 9.81
        images.append((1, f"set/frame_{i:03d}.jpg", *map(float, q)))
        index.append((1, f"frames/frame_{i:03d}.jpg", i / 30.0, 30.0))
        frames.append((1, i, t))
        imu += [(1, t + d, [float(v) for v in reading]) for d in (-2_000_000, 0, 2_000_000)]
    got = poses.gravity_up(
        spark.createDataFrame(index, "capture_id int, file string, timestamp_sec double, fps double"),
        spark.createDataFrame(frames, "capture_id int, frame long, t_ns long"),
        spark.createDataFrame(imu, "capture_id int, t_ns long, v array<double>"),
        spark.createDataFrame(images, "capture_id int, name string, qw double, qx double, qy double, qz double"),
    ).first()
    np.testing.assert_allclose([got["up_x"], got["up_y"], got["up_z"]], up, atol=1e-9)
    assert got["frames"] == 12 and got["consistency"] > 0.9999 and got["mounting"] == 0


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 2)) * [3.0, 0.2] + [10, 1]
    y = (x[:, 0] - 10 + rng.normal(size=80) * 3 > 0).astype(float)
    got = study.fit_logistic(spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y})), ["a", "b"], "y").collect()
    mean, scale = x.mean(0), x.std(0)
    d = np.hstack([np.ones((80, 1)), (x - mean) / scale])
    beta, ridge = np.zeros(3), np.diag([0.0, 1, 1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-d @ beta))
        beta = beta + np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]) + ridge, d.T @ (y - p) - ridge @ beta)
    raw = beta[1:] / scale
    want = [beta[0] - (beta[1:] * mean / scale).sum(), *raw]
    np.testing.assert_allclose([r["coefficient"] for r in got], want, rtol=1e-6)
    assert got[0]["converged"] and not got[0]["separable"]
    one = study.fit_logistic(spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, y int"), ["a"], "y").first()
    assert one["coefficient"] == 0 and not one["converged"]


def test_quaternion_codes_stay_in_budget(spark):
    rng = np.random.default_rng(6)
    q = rng.normal(size=(3000, 4))
    rows = spark.createDataFrame(pd.DataFrame(q / np.linalg.norm(q, axis=1, keepdims=True), columns=list("wxyz")))
    own = g.vec("w", "x", "y", "z")
    packed = rows.withColumn("word", enc.pack_quat32(own)).withColumns(g.named(enc.pack_quat_snorm16(own), "a", "b", "c", "d"))
    worst = packed.agg(
        F.max(g.angular_error_degrees(own, enc.unpack_quat32(F.col("word")))).alias("small"),
        F.max(g.angular_error_degrees(own, enc.unpack_quat_snorm16(g.vec("a", "b", "c", "d")))).alias("wide"),
        F.max("word").alias("word"),
    ).first()
    assert worst["small"] < 0.25 and worst["wide"] < 0.0036 and worst["word"] < 1 << 32


def test_text_functions(spark):
    rows = spark.createDataFrame([("30000/1001", 5 << 30), ("0/0", 3 << 20), ("x", 2048)], "rate string, size long")
    got = rows.select(text.parse_rate(F.col("rate")).alias("r"), text.human_size(F.col("size")).alias("s"), text.short_label(F.lit("A_good_30000")).alias("l")).collect()
    assert [r["s"] for r in got] == ["5.0 GB", "3 MB", "2 KB"] and got[0]["l"] == "A good · 30,000 steps"
    assert got[0]["r"] == pytest.approx(29.97002997) and got[1]["r"] is None and got[2]["r"] is None


def test_readers(spark, tmp_path):
    pack = tmp_path / "cap1"
    pack.mkdir()
    lines = [{"type": sensors.ACCELEROMETER, "t_ns": t, "v": [0.0, 0.0, 9.8]} for t in (1, 2, 3)]
    lines += [{"type": "android.sensor.gyroscope", "t_ns": 4, "v": [0, 0, 0]}, {"type": sensors.ACCELEROMETER, "t_ns": 5, "v": [0, 0]}]
    (pack / "imu.jsonl").write_text("\n".join(json.dumps(v) for v in lines) + "\n{broken\n")
    assert sensors.read_imu(spark, f"{tmp_path}/*/imu.jsonl").count() == 3
    (pack / "frames.jsonl").write_text('{"frame":1,"t_ns":10}\n{"frame":1,"t_ns":30}\n{"frame":2,"t_ns":20}\n')
    got = {r["frame"]: r["t_ns"] for r in sensors.read_frames(spark, f"{tmp_path}/*/frames.jsonl").collect()}
    assert got == {1: 30, 2: 20}
    (pack / "events.jsonl").write_text('{"t_ns":7,"event":"lens_switch","detail":"a"}\n')
    assert sensors.read_events(spark, f"{tmp_path}/*/events.jsonl").first()["fields"] == {"detail": "a"}
    (pack / "manifest.json").write_text('{"session_id": "s1"')
    assert manifests.read_manifests(spark, f"{tmp_path}/*/manifest.json").first()["error"] == "invalid_json"
    (pack / "checksums").mkdir()
    (pack / "checksums" / "x").write_text("no")
    listed = {r["path"]: r for r in manifests.inventory(spark, str(tmp_path)).collect()}
    assert set(listed) == {"imu.jsonl", "frames.jsonl", "events.jsonl", "manifest.json"}
    body = (pack / "manifest.json").read_bytes()
    assert listed["manifest.json"]["sha256"] == hashlib.sha256(body).hexdigest() and listed["manifest.json"]["length"] == len(body)


def test_sparse_text(spark, tmp_path):
    folder = tmp_path / "cap" / "0"
    folder.mkdir(parents=True)
    (folder / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 500 501 320 240\n")
    (folder / "images.txt").write_text("# i\n1 1 0 0 0 1 2 3 1 a b.jpg\n10.5 20.5 -1\n")
    (folder / "points3D.txt").write_text("\n7 1 2 3 10 20 30 0.5\n")
    tables = models.read_sparse_text(spark, f"{tmp_path}/*/*")
    image = tables["images"].first()
    assert tables["images"].count() == 1 and image["name"] == "a b.jpg" and image["capture_id"] == "cap" and image["model_id"] == "0"
    assert tables["cameras"].first()["params"]["fy"] == 501 and tables["points"].first()["b"] == 30
    frame = models.posed_frames(tables["images"], tables["cameras"]).first()
    np.testing.assert_allclose(frame["matrix"], [[1, 0, 0, -1], [0, -1, 0, -2], [0, 0, -1, -3], [0, 0, 0, 1]], atol=1e-12)
    document = json.loads(models.transforms_documents(models.posed_frames(tables["images"], tables["cameras"])).first()["frame_json"])
    assert set(document) == {"file_path", "transform_matrix", "colmap_im_id"}


@pytest.mark.parametrize("order", ["<", ">"])
def test_splat_source_and_sink(spark, tmp_path, order):
    rng = np.random.default_rng(1)
    names = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "f_rest_0", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
    values = rng.normal(size=(500, len(names))).astype(np.float32)
    head = ["ply", f"format binary_{'little' if order == '<' else 'big'}_endian 1.0", "element vertex 500", *(f"property float {n}" for n in names), "end_header"]
    path = tmp_path / "scene.ply"
    path.write_bytes(("\n".join(head) + "\n").encode() + values.astype(f"{order}f4").tobytes())
    rows = splats.read_splat_table(spark, str(path), bytes_per_partition=8000)
    assert rows.rdd.getNumPartitions() == 4 and "f_rest_0" not in rows.columns
    got = rows.toPandas().sort_values("gid")
    np.testing.assert_array_equal(got[["x", "opacity", "rot_3"]], values[:, [0, 7, 14]])
    assert (got["sh_bands"] == 1).all()
    from rushlight.operators.splats import decode_splats

    ready = decode_splats(rows.drop("sh_bands")).withColumn("position", F.col("gid"))
    records = splats.splat_records(ready)
    splats.write_splat_rows(records, ["position"], str(tmp_path / "out"))
    raw = b"".join(f.read_bytes() for f in sorted((tmp_path / "out").glob("part-*.splat")))
    assert len(raw) == 500 * 32
    np.testing.assert_array_equal(np.frombuffer(raw, splats.RECORD)["xyz"], values[:, :3])
    back = splats.read_splat_rows(spark, str(tmp_path / "out"), bytes_per_partition=1000)
    assert back.rdd.getNumPartitions() >= 16
    np.testing.assert_array_equal(back.orderBy("position").select("x", "y", "z").toPandas(), values[:, :3])
    splats.write_splat_rows(records, ["position"], str(tmp_path / "out"), mode="append")
    assert splats.read_splat_rows(spark, str(tmp_path / "out")).agg(F.max("position")).first()[0] == 999


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    fields = ["x", "y", "z", "sx", "sy", "sz", "r", "g", "b", "a", "b0", "b1", "b2", "b3"]
    rows = spark.range(4000).select(*[(F.col("id") % 200).cast("float" if f in fields[:6] else "int").alias(f) for f in fields], "id")
    folder = tmp_path / "out"
    splats.write_splat_rows(rows.filter("id < 10"), ["id"], str(folder))
    broken = rows.withColumn("x", F.when(F.col("id") == 3999, F.raise_error(F.lit("lost")).cast("float")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="lost"):
        splats.write_splat_rows(broken, ["y", "z", "id"], str(folder))
    assert splats.read_splat_rows(spark, str(folder)).count() == 10
    assert not [f for f in folder.iterdir() if not f.name.startswith("part-")]


def test_files_of_many_layouts(spark, tmp_path):
    def save(name, fields, rows, filler=0):
        head = ["ply", "format binary_little_endian 1.0", *["comment " + "x" * 70] * filler, f"element vertex {len(rows)}", *(f"property {k} {n}" for n, k, _ in fields), "end_header"]
        (tmp_path / name).write_bytes(("\n".join(head) + "\n").encode() + np.array(rows, [(n, t) for n, _, t in fields]).tobytes())

    must = [(n, "float", "<f4") for n in ("x", "y", "z", "opacity", "scale_0")]
    save("a.ply", must, [(1, 2, 3, 4, 5)] * 3)
    save("b.ply", [("extra", "uchar", "u1"), *must], [(9, 1, 2, 3, 4, 6)] * 2, filler=30_000)  # a header of two megabytes
    save("c.ply", [*must, ("extra", "double", "<f8")], [(1, 2, 3, 4, 7, 0.5)])
    save("d.ply", must, [])
    rows = splats.read_splat_table(spark, str(tmp_path), bytes_per_partition=1 << 19)
    got = sorted((r.scene_id, r.gid, r.scale_0, r.extra) for r in rows.collect())
    assert got == [("a", 0, 5, None), ("a", 1, 5, None), ("a", 2, 5, None), ("b", 0, 6, 9), ("b", 1, 6, 9), ("c", 0, 7, 0.5)]
    (tmp_path / "e.ply").write_text("no such thing")
    with pytest.raises(ValueError, match="1 files cannot be read"):
        splats.read_splat_table(spark, str(tmp_path))


def test_text_splat_refused(tmp_path):
    path = tmp_path / "a.ply"
    path.write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n1\n")
    with pytest.raises(ValueError, match="not binary"):
        splats.read_header(str(path))


def test_mask_clean_up():
    plane = np.zeros((60, 80), np.uint8)
    plane[20:40, 30:50] = 1
    plane[5:8, 5:8] = 1  # 9 pixels survive the opening and the size limit
    plane[50, 70] = 1  # a speck
    done = masks.clean_plane(plane)
    assert done[20:40, 30:50].all() and done[6, 6] and not done[50, 70]
    assert done[19, 35] and not done[17, 35] and not done[10, 20]


def test_pixel_statistics():
    flat = np.full((8, 8), 250, np.uint8)
    assert pixels.laplacian_variance(flat) == 0
    h = pixels.histogram(flat)
    assert h[31] == 1 and pixels.correlation(h, h) == pytest.approx(1)
    assert pixels.correlation(np.zeros(32), h) == 1.0
    assert pixels.structural_similarity(flat / 255, flat / 255) == pytest.approx(1)
    assert pixels.analysis_plane(np.full((400, 800), 9, np.uint8)).shape == (96, 192)


def test_phase_script():
    state, seen = folds.phase_start(), []
    for t in range(0, 40000, 100):
        rest = not 2500 < t < 15000
        rows = pd.DataFrame([{"capture_id": 1, "t_ms": t, "at_rest": rest, "rest_for_ms": 1000 if rest else 0, "swept_deg": 60.0, "orbit_likely": True}])
        row = folds.phase_step(state, rows).iloc[0]
        seen.append((row["phase"], row["finished"]))
    order = list(dict.fromkeys(p for p, _ in seen))
    assert order == ["perch", "arc", "reseat", "hold"] and seen[-1] == ("hold", "complete") and not state["aborted"]


def test_rest_detector():
    detector = Stillness()
    state, rows = detector.start(), []
    for i in range(800):
        t = i * 5_000_000
        rows.append((1, t, "accel", 0.0, 0.0, 9.81))
        rows.append((1, t, "gyro", 0.004, 0.0, 0.0 if i < 600 else 0.5))
    rows.insert(800, (1, 400 * 5_000_000, "mark", 0.0, 0.0, 0.0))
    got = detector.advance(state, pd.DataFrame(rows, columns=["capture_id", "t_ns", "sensor", "x", "y", "z"]))
    assert got["at_rest"].iloc[700] and got["rest_for_ms"].iloc[700] > 1500 and not got["disturbed"].iloc[1100]
    assert not got["at_rest"].iloc[-1] and got["disturbed"].iloc[-1] and got["residual_deg"].iloc[-1] == pytest.approx(math.degrees(0.5), rel=0.05)


def test_rest_detector_on_one_sensor_alone():
    for sensor in ("gyro", "accel", "mark"):
        detector = Stillness()
        state = detector.start()
        rows = pd.DataFrame([(1, i * 10, sensor, 0.0, 0.0, 1.0) for i in range(3)], columns=["capture_id", "t_ns", "sensor", "x", "y", "z"])
        made = [detector.advance(state, rows) for _ in range(2)]
        assert sum(map(len, made)) == (0 if sensor == "mark" else 6) and not any(m["at_rest"].any() for m in made if len(m))
