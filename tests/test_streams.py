"""A stream gives what its batch form gives, whatever the micro-batches, and forgets what it no longer needs."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rushlight.operators import frames as fr
from rushlight.operators import motion, rest
from rushlight.plans.timeline import Timeline
from rushlight.streaming import live

END = 90_000_000_000  # a row far behind the others moves the watermark past them


def motion_rows(extra: str):
    rng = np.random.default_rng(9)
    rows = []
    for capture in (1, None):
        for i in range(300):
            t = i * 5_000_000
            rows.append((capture, t, "accel", *(rng.normal(size=3) * 0.02 + [0, 0, 9.81])))
            noise = 0.06 if i % 9 == 0 else 0.01
            rows.append((capture, t + 1_000_000, "gyro", *(rng.normal(size=3) * noise + [0, 0, 0.4 if 100 < i < 160 else 0])))
            if extra and i in (70, 230, 231):
                rows.append((capture, t + 2_000_000, extra, *(rng.normal(size=3) * 0.3)))
        rows.append((capture, END, "gyro", 0.0, 0.0, 0.0))
    return pd.DataFrame(rows, columns=["capture_id", "t_ns", "sensor", "x", "y", "z"])


def lock_rows():
    rng = np.random.default_rng(4)
    rows = []
    for capture in (1, 2):
        for i in range(200):
            exposure = None if i % 11 == 0 else 1000 + (int(rng.integers(0, 60)) if i > 90 else 0)
            lens = None if i < 3 else "tele" if i == 150 and capture == 1 else "wide"
            rows.append((capture, i * 10_000_000, lens, exposure, 1000, None if i % 7 == 0 else i != 120, "0 0" if i != 60 else "1 1"))
        rows.append((capture, END, None, None, None, None, None))
    return pd.DataFrame(rows, columns=["capture_id", "t_ns", "physical_id", "exposure_ns", "requested_ns", "awb_manual", "crop"])


def frame_rows():
    rng = np.random.default_rng(5)
    rows = []
    for capture in (1, 2):
        still = rng.integers(0, 255, (6, 8), np.uint8)
        for i in range(120):
            if i % 3 == 0:
                still = rng.integers(0, 255 if i % 2 else 20, (6, 8), np.uint8)
            rows.append((capture, i * 10_000_000, i, still.tobytes(), 6, 8))
        rows.append((capture, END, 10_000, still.tobytes(), 6, 8))
    return pd.DataFrame(rows, columns=["capture_id", "t_ns", "frame", "gray", "height", "width"])


def columns(frame):
    kinds = {"capture_id": "long", "t_ns": "long", "frame": "long", "gray": "binary", "height": "int", "width": "int", "exposure_ns": "long",
             "requested_ns": "long", "awb_manual": "boolean", "x": "double", "y": "double", "z": "double"}
    return ", ".join(f"{c} {kinds.get(c, 'string')}" for c in frame.columns)


def spread(spark, frame, folder):
    """Three files whose rows overlap in time by less than the watermark."""
    part = np.clip((frame["t_ns"] + np.random.default_rng(1).integers(-200_000_000, 200_000_000, len(frame))) // 500_000_000, 0, 2)
    part[frame["t_ns"] == END] = 2
    for _, rows in frame.groupby(part):
        rows = rows.sample(frac=1, random_state=1).astype(object)
        plain = [[int(v) if c.endswith(("_ns", "_id")) and isinstance(v, float) else v for c, v in zip(frame, r)] for r in rows.where(rows.notna(), None).values.tolist()]
        df = spark.createDataFrame(plain, columns(frame))
        df.withColumn("ts", F.timestamp_micros(F.floor(F.col("t_ns") / 1000) + 1_700_000_000_000_000)).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


BATCH = {
    "stillness": lambda rows, line: rest.stillness(rows, line),
    "sweep": lambda rows, line: rest.sweep_ticks(rows, line),
    "locks": lambda rows, line: rest.lock_events(rows, line),
    "select": lambda rows, line: fr.select_frames(fr.frame_signals(rows), Timeline.measure(rows, ["capture_id"], "frame")),
}


@pytest.mark.parametrize("name", sorted(BATCH))
def test_stream_equals_batch(spark, tmp_path, name):
    frame = {"stillness": motion_rows("mark"), "sweep": motion_rows("rotation"), "locks": lock_rows(), "select": frame_rows()}[name]
    rows = spread(spark, frame, str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ties = ["sensor"] if "sensor" in frame else []
    made = live.live(stream.drop("t_ns") if name == "select" else stream, name, "ts", ties)
    state = str(tmp_path / uuid.uuid4().hex)
    made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(180)
    got = spark.read.schema(made.schema).parquet(str(tmp_path / "out")).toPandas()
    rows = rows.filter(F.col("t_ns") < END).drop("ts")
    want = BATCH[name](rows, Timeline.measure(rows, ["capture_id"], "t_ns", ties)).toPandas()[list(got.columns)]
    order = [c for c in ("capture_id", "t_ns", "frame", "kind", "gyro_rms") if c in got]
    a, b = (df.sort_values(order, ignore_index=True) for df in (got, want))
    assert len(a) == len(b) >= (7 if name == "locks" else 240)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-7, atol=1e-9)
    # only the row beyond the watermark still waits
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(state)
    assert waiting.count() == 2


def test_a_silent_capture_is_forgotten(spark, tmp_path):
    rows = [(c, t, 1.0, 0.01, 1300.0) for c, last in ((1, 20), (2, 20)) for t in range(last)]
    rows += [(3, t, 1.0, 0.01, 1300.0) for t in (100, 2000, 4000)]  # time goes on for others
    schema = "capture_id long, t_ns long, speed double, exposure_s double, focal_px double"
    for part in (rows[:40], rows[40:41], rows[41:42], rows[42:]):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds(F.col("t_ns") + 1_700_000_000))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = live.live(stream, "rate", "ts", idle_ms=60_000)
    state = str(tmp_path / "state")
    made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(180)
    for name in ("waiting", "kept", "alarm"):
        held = spark.read.format("statestore").option("stateVarName", name).load(state)
        assert {r.key.capture_key for r in held.select("key").collect()} <= {"=3"}
    assert spark.read.parquet(str(tmp_path / "out")).filter("capture_id < 3").count() == 40


def test_captures_share_lanes(spark, tmp_path):
    """Lanes change nothing in the result; many captures wait in few entries, and silent ones are forgotten in a busy lane."""
    rows = [(c, t, float((c + t) % 5), 0.01, 1300.0) for c in range(40) for t in range(50)]
    rows += [(40 + t // 1000, t, 1.0, 0.01, 1300.0) for t in (100, 2000, 4000)]  # time goes on for others
    schema = "capture_id long, t_ns long, speed double, exposure_s double, focal_px double"
    for part in (rows[:2000], rows[2000:2001], rows[2001:2002], rows[2002:]):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds(F.col("t_ns") + 1_700_000_000))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = live.live(stream, "rate", "ts", idle_ms=60_000, lanes=1)
    state = str(tmp_path / "state")
    made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(180)
    got = spark.read.schema(made.schema).parquet(str(tmp_path / "out")).filter("capture_id < 40").toPandas().sort_values(["capture_id", "t_ns"], ignore_index=True)
    plain = spark.createDataFrame(rows[:2000], schema)
    want = motion.angular_rate(plain, Timeline.measure(plain, ["capture_id"], "t_ns"), "speed").toPandas().sort_values(["capture_id", "t_ns"], ignore_index=True)
    assert np.allclose(got["angular_rate"], want["angular_rate"]) and (got["t_ns"] == want["t_ns"]).all()
    store = lambda name, batch: spark.read.format("statestore").option("stateVarName", name).option("batchId", batch).load(state)
    assert store("waiting", 0).count() == 1  # 2,000 rows of 40 captures
    last = max(int(f.name) for f in (tmp_path / "state" / "offsets").iterdir() if f.name.isdigit())
    assert {r.user_map_key.capture for r in store("kept", last).select("user_map_key").collect()} == {"=42"}


def test_many_poses_in_one_batch_and_in_many(monkeypatch):
    """The tracker gives the same rows however they are cut, a pose at every seventh row, and judges all poses at once."""
    from rushlight.streaming import detectors
    from rushlight.streaming.detectors import Stillness

    asked, plain = [], detectors._degrees_between
    monkeypatch.setattr(detectors, "_degrees_between", lambda a, b: asked.append(len(a)) or plain(a, b))

    rng = np.random.default_rng(3)
    kinds = ["mark" if i % 7 == 6 else "accel" if i % 2 else "gyro" for i in range(200)]
    rows = pd.DataFrame({"t_ns": np.arange(200) * 5_000_000, "sensor": kinds, "x": rng.normal(size=200) * 0.01, "y": rng.normal(size=200) * 0.01, "z": 0.01})
    rows.loc[rows["sensor"] == "accel", "z"] = 9.81
    tracker, whole, parts = Stillness(), Stillness().start(), Stillness().start()
    a = tracker.advance(whole, rows)
    assert len(asked) == 1
    b = pd.concat([tracker.advance(parts, rows[low : low + 13]) for low in range(0, 200, 13)], ignore_index=True)
    pd.testing.assert_frame_equal(a, b, rtol=0, atol=1e-7)  # arc cosines near one
    assert len(a) == 172 and whole["last"] == parts["last"] and a["max_tilt_deg"].max() > 0


def test_the_gate_follows_the_serial_recurrence(spark):
    """Rows near the limit, a hot capture in many blocks: the windows agree with a walk along every capture."""
    from rushlight.plans.recurrence import gated_ema

    rng = np.random.default_rng(8)
    rows = [(1 if i % 10 else 2, i, *(float(x) for x in rng.normal(size=2) * 0.05 + 0.02)) for i in range(3000)]
    df = spark.createDataFrame(rows, "c long, t long, x double, y double")
    want, mean = {}, {}
    for c, t, x, y in rows:
        g = mean.get(c, np.zeros(2))
        v = np.array([x, y])
        mean[c] = g + 0.05 * (v - g) if np.linalg.norm(v - g) < 0.06 else g
        want[t] = mean[c]
    for limit in (None, 500):
        line = Timeline.measure(df, ["c"], "t", limit=limit)
        assert line.fits == (limit is None)
        got = gated_ema(df, line, {"gx": "x", "gy": "y"}, 0.05, 0.06, F.lit(True)).collect()
        assert len(got) == 3000 and all(np.allclose([r.gx, r.gy], want[r.t], atol=1e-12) for r in got)


def test_rates_of_windows_and_trackers_agree(spark):
    rows = spark.createDataFrame([(1, t, float(t % 7), 0.01, 1300.0) for t in range(100)], "capture_id long, t_ns long, value double, e double, f double")
    line = Timeline.measure(rows, ["capture_id"], "t_ns")
    windows = motion.angular_rate(rows, line, "value").orderBy("t_ns").toPandas()
    from rushlight.streaming.detectors import Rate

    tracker, state = Rate(), Rate().start()
    frame = rows.toPandas().rename(columns={"value": "speed", "e": "exposure_s", "f": "focal_px"})
    made = pd.concat([tracker.advance(state, frame[:3]), tracker.advance(state, frame[3:70]), tracker.advance(state, frame[70:])])
    assert np.allclose(made["angular_rate"], windows["angular_rate"]) and len(state["speeds"]) == 31


def test_ingest_appends_once(spark, tmp_path):
    rows = spark.range(6).select(F.col("id").alias("capture_id"), F.concat(F.lit('{"session_id":"s'), (F.col("id") % 4).cast("string"), F.lit('"}')).alias("document"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        check = lambda df: df.select("capture_id", F.lit("warning").alias("level"))
        live.ingest(stream, check, str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination(120)

    run()
    rows.limit(2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    found = spark.read.parquet(str(tmp_path / "table" / "captures"))
    assert found.count() == 4 and found.select("session_key").distinct().count() == 4
    assert spark.read.parquet(str(tmp_path / "table" / "issues")).count() == 4


def test_a_table_of_several_files_streams_whole(spark, tmp_path):
    from rushlight.queries import live as bound

    for name in ("embeddings", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for tracked, replayed in ((bound.live_selection, bound.selection_replay), (bound.live_rate, bound.rate_replay)):
        got, want = tracked(spark, str(tmp_path)), replayed(spark, "/root/testdata/sf0.001")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) != []
