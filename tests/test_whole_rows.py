"""No row is lost on the way: null keys, captures without an event, unknown fields, broken lines, old sessions."""

import numpy as np
from pyspark.sql import functions as F

from rushlight.operators import integrity, masks, motion, study
from rushlight.plans import sizing
from rushlight.plans.fold import ordered_fold
from rushlight.plans.timeline import Timeline
from rushlight.sources import manifests
from rushlight.streaming import live


def test_a_null_key_is_folded_like_any_other(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (7, 1)], "capture_id bigint, t bigint")

    def step(state, batch):
        state["n"] += len(batch)
        return batch.assign(n=state["n"])

    made = ordered_fold(rows, "capture_id", ["t"], lambda: {"n": 0}, step, "capture_id bigint, t bigint, n bigint")
    assert made.count() == 3 and made.filter("capture_id IS NULL").agg(F.max("n")).first()[0] in (1, 2)


def test_masks_of_a_null_capture(spark):
    piece = bytes([1, 0, 1, 1])
    rows = spark.createDataFrame([(None, 2, 2, 0, piece), (None, 2, 2, 0, bytes([0, 1, 0, 0])), (3, 2, 2, 0, piece)],
                                 "capture_id bigint, height int, width int, band int, piece binary")
    back = np.zeros(4, np.float32).tobytes()
    counted = masks.residual_counts(rows.withColumn("background", F.lit(bytearray(back))))
    assert counted.filter("capture_id IS NULL").agg(F.sum("n")).first()[0] == 8


def test_specks_and_discs_against_pixels():
    rng = np.random.default_rng(2)
    for density in (0.3, 0.55, 0.8):
        mask = (rng.random((40, 60)) < density).astype(np.uint8)
        left, keep = {(y, x) for y, x in zip(*np.nonzero(mask))}, np.zeros_like(mask)
        while left:
            group, queue = set(), [left.pop()]
            while queue:
                y, x = queue.pop()
                group.add((y, x))
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                queue += near
            if len(group) >= 6:
                for p in group:
                    keep[p] = 1
        assert (masks._without_specks(mask, 6) == keep).all()


def test_a_capture_that_never_sweeps_has_a_row(spark):
    still = [(1, i * 10_000_000, s, 0.0, 0.0, 9.81 if s == "accel" else 0.0) for i in range(20) for s in ("accel", "gyro")]
    turning = [(2, i * 10_000_000, s, 0.0, 0.0, 9.81 if s == "accel" else 1.0) for i in range(20) for s in ("accel", "gyro")]
    rows = spark.createDataFrame(still + turning, "capture_id bigint, t_ns bigint, sensor string, x double, y double, z double")
    got = {r.capture_id: r for r in motion.sweep(rows, Timeline.measure(rows, ["capture_id"], "t_ns", ["sensor"])).collect()}
    assert got[1].swept_deg == 0 and got[1].duration_sec == 0 and str(got[1].implied_cone_deg) == "0.0" and got[2].swept_deg > 0


def test_results_keep_unknown_fields_and_broken_lines(spark, tmp_path):
    rows = spark.createDataFrame([("a", {"score": 1.5, "own": 2.5})], "name string, signals map<string,double>").withColumn("note", F.lit("x"))
    manifests.write_results(rows, str(tmp_path), "r1")
    (tmp_path / "jsonl" / "run_id=r1" / "more.json").write_text('{"name":"b","frames_used":3,"odd":{"k":1}}\n\n{broken\n')
    got = {r.name: r for r in manifests.read_results(spark, str(tmp_path / "jsonl")).collect()}
    assert got["a"].signal_score == 1.5 and '"own":2.5' in got["a"].extras["more_signals"] and got["a"].extras["note"] == "x"
    assert got["b"].frames_used == 3 and got["b"].extras["odd"] == '{"k":1}' and got[None].broken == "{broken"


def test_whole_lines_and_bare_captures(spark):
    long = "garbage " + "x" * 500
    lines = spark.createDataFrame([(1, long)], "capture_id bigint, line string")
    files = spark.createDataFrame([], "capture_id bigint, path string, sha256 string")
    assert integrity.reconcile(lines, files).first().path == long
    frames = spark.createDataFrame([(1, 0, "f", [[0.0] * 4] * 3 + [[0.0, 0.0, 0.0, 1.0]], 1.0, True)],
                                   "capture_id bigint, frame int, file_path string, matrix array<array<double>>, fl_x double, has_top_level_intrinsics boolean")
    captures = spark.range(1, 3).withColumnRenamed("id", "capture_id")
    assert [(r.capture_id, r.code) for r in integrity.validate_transforms(frames, captures=captures).collect()] == [(2, "no_frames")]


def test_a_session_seen_long_ago_is_not_taken_again(spark, tmp_path):
    check = lambda df: df.select("capture_id", F.lit("warning").alias("level"))
    for day, number in (("2024-01-01", 1), ("2024-03-01", 2), ("2024-06-01", 3)):
        row = spark.createDataFrame([(number, '{"session_id":"same"}', day)], "capture_id bigint, document string, d string")
        row.select("capture_id", "document", F.col("d").cast("timestamp").alias("ts")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("capture_id bigint, document string, ts timestamp").parquet(str(tmp_path / "in"))
        live.ingest(stream, check, str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination(120)
    assert [r.capture_id for r in spark.read.parquet(str(tmp_path / "table" / "captures")).collect()] == [1]


def test_session_ids_depend_on_the_capture_alone(spark):
    rows = spark.createDataFrame([(1,), (2,)], "capture_id bigint").withColumn("s", manifests.session_of("capture_id"))
    a, b = (r.s for r in rows.orderBy("capture_id").collect())
    assert len(a) == len(b) == 36 and a != b and a == rows.orderBy("capture_id").first().s


def test_release_deletes_settled_tables(spark):
    kept = sizing._settled.pop(spark.sparkContext.applicationId, [])
    try:
        made = sizing.settle(spark.range(5))
        assert made.count() == 5 and sizing.release(spark) == 1 and sizing.release(spark) == 0
    finally:
        sizing._settled[spark.sparkContext.applicationId] = kept



def test_failure_model_flags_its_area(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "good" if i % 2 else "poor", bool(i % 2), float(rng.normal() + 2 * (i % 2)), 5.0) for i in range(60)] + [(99, "not_run", None, 0.0, 5.0)]
    df = spark.createDataFrame(rows, "id int, pose_status string, registered boolean, sharp double, flat double")
    got = {r.term: r for r in study.failure_model(df, ["sharp", "flat"]).collect()}
    assert set(got) == {"intercept", "sharp"} and got["sharp"].coefficient < 0 and got["sharp"].n == 60 and got["sharp"].meets_target
    sharp = np.array([r[3] for r in rows[:60]])
    y = np.array([0.0 if r[2] else 1.0 for r in rows[:60]])
    p = 1 / (1 + np.exp(-(got["intercept"].coefficient + got["sharp"].coefficient * sharp)))
    # the score equations: residuals cancel, and against the signal they balance the penalty in its scaled units
    assert abs((y - p).sum()) < 1e-5
    assert abs(((y - p) * (sharp - sharp.mean()) / sharp.std()).sum() - got["sharp"].coefficient * sharp.std()) < 1e-4
    one = study.failure_model(df.filter("registered"), ["sharp"]).first()
    assert not one.meets_target and one.note


def test_wide_rows_are_not_broadcast(spark):
    wide = spark.range(200).select("id", F.sha2(F.col("id").cast("string"), 512).alias("a"), F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.rand()).alias("b"))
    plan = lambda: spark.range(200).join(sizing.small(wide), "id")._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan()
        spark.conf.set(sizing.BROADCAST_BYTES_CONF, "1000")
        assert "BroadcastHashJoin" not in plan()
    finally:
        spark.conf.unset(sizing.BROADCAST_BYTES_CONF)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
