"""Readers and record formats, fed with text and rows derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushlight.operators import catalog
from rushlight.queries.registry import query
from rushlight.queries.views import EVENTS, events, rounded, vectors, vectors_sql
from rushlight.session import table
from rushlight.sources import manifests, models, sensors, splats


def chunked(rows):
    """Groups for documents of at most 64 rows, however many a capture has."""
    return rows.groupBy("capture_id", F.floor(F.col("event_id") / 64).alias("chunk"))


def imu_lines(spark, folder):
    """Sensor log lines: clicks and purchases are whole, views another sensor, the rest broken."""
    kind = F.col("event_type")
    body = F.struct(
        F.when(kind == "view", "android.sensor.gyroscope").otherwise(sensors.ACCELEROMETER).alias("type"),
        F.col("t").alias("t_ns"),
        F.when(kind == "signup", F.array("value", "k")).otherwise(F.array("value", "k", F.lit(9.81))).alias("v"),
        F.lit(3).alias("accuracy"),
    )
    text = F.to_json(body)
    return events(spark, folder).select(
        "capture_id", "event_id", F.when(kind == "error", F.substring(text, 1, 20)).otherwise(text).alias("line")
    )


@query(
    "src1_read_imu",
    f"""WITH {EVENTS} SELECT capture_id, event_id, t AS t_ns, value AS ax, k AS ay, 9.81 AS az FROM events_v WHERE event_type IN ('click', 'purchase')
      AND capture_id IN (SELECT capture_id FROM events_v WHERE event_type IN ('click', 'purchase') GROUP BY 1 HAVING count(*) >= 2)""",
)
def read_imu(spark, folder):
    rows = sensors.with_stream(sensors.parse_imu(imu_lines(spark, folder)))
    return rows.select("capture_id", "event_id", "t_ns", *[F.element_at("v", i + 1).alias(n) for i, n in enumerate(("ax", "ay", "az"))])


@query(
    "src3_read_frame_index",
    f"""WITH {EVENTS} SELECT capture_id, 30.0 AS source_fps, event_id AS index, k / 30.0 AS timestamp_sec, value AS blur_vol, event_type <> 'error' AS used,
      CASE WHEN event_type <> 'error' THEN event_id || '.jpg' END AS file FROM events_v""",
)
def read_frame_index(spark, folder):
    frame = F.struct(
        F.col("event_id").alias("index"), (F.col("k") / 30.0).alias("timestamp_sec"), F.col("value").alias("blur_vol"),
        (F.col("event_type") != "error").alias("used"), F.when(F.col("event_type") != "error", F.concat(F.col("event_id").cast("string"), F.lit(".jpg"))).alias("file"),
    )
    documents = chunked(events(spark, folder)).agg(F.collect_list(frame).alias("frames"))
    text = F.to_json(F.struct(F.lit("video.mp4").alias("source_video"), F.lit(30.0).alias("source_fps"), "frames"))
    parsed = manifests.parse_frame_index(documents.select("capture_id", text.alias("document")))
    return parsed.select("capture_id", "source_fps", F.col("index").cast("long").alias("index"), "timestamp_sec", "blur_vol", "used", "file")


@query(
    "src7_read_manifests",
    """SELECT o_orderkey AS capture_id, CASE WHEN o_orderstatus = 'F' THEN 'invalid_json' WHEN o_orderstatus = 'P' THEN 'missing' END AS error,
      CASE WHEN o_orderstatus = 'O' THEN 's' || o_custkey END AS session_id, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS duration_sec FROM orders""",
)
def read_manifests(spark, folder):
    text = F.to_json(
        F.struct(
            F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("session_id"),
            F.struct(F.lit("v.mp4").alias("main_file"), F.col("o_totalprice").alias("duration_sec")).alias("video"),
        )
    )
    status = F.col("o_orderstatus")
    documents = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("capture_id"), F.when(status == "F", F.substring(text, 1, 15)).when(status == "O", text).alias("document")
    )
    return manifests.parse_manifests(documents).select("capture_id", "error", "manifest.session_id", "manifest.video.duration_sec")


@query(
    "src8_inventory",
    "SELECT source AS capture_id, CAST(doc_id AS VARCHAR) AS path, octet_length(encode(text)) AS length, sha256(text) AS sha256 FROM documents",
)
def inventory(spark, folder):
    rows = table(spark, folder, "documents").select("source", F.col("doc_id").cast("string").alias("path"), "text")
    return manifests.inventory_of_rows(rows, "source", "path", "text")


@query(
    "src9_sparse_cameras",
    """SELECT p_partkey AS capture_id, p_partkey AS camera_id, CASE WHEN p_size % 2 = 0 THEN 'PINHOLE' ELSE 'SIMPLE_RADIAL' END AS model, 1920 AS width, 1080 AS height,
      p_retailprice AS fl_x, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_retailprice END AS fl_y, CASE WHEN p_size % 2 = 0 THEN 960.0 ELSE p_size END AS cx,
      CASE WHEN p_size % 2 = 0 THEN 540.0 ELSE 960.0 END AS cy, CASE WHEN p_size % 2 = 0 THEN 'PINHOLE' ELSE 'OPENCV' END AS camera_model, CASE WHEN p_size % 2 = 0 THEN 0.0 ELSE 540.0 END AS k1 FROM part""",
)
def sparse_cameras(spark, folder):
    model = F.when(F.col("p_size") % 2 == 0, "PINHOLE").otherwise("SIMPLE_RADIAL")
    line = F.concat_ws(" ", F.col("p_partkey").cast("string"), model, F.lit("1920 1080"), F.col("p_retailprice").cast("string"), F.col("p_size").cast("string"), F.lit("960.0 540.0"))
    lines = table(spark, folder, "part").select(F.col("p_partkey").alias("capture_id"), F.explode(F.array(F.lit("# cameras"), F.lit(""), line)).alias("line"))
    return models.intrinsics(models.parse_cameras(lines)).select(
        "capture_id", "camera_id", "model", "width", "height", "fl_x", "fl_y", "cx", "cy", "camera_model", "k1"
    )


POSE = {n: i + 1 for i, n in enumerate("qw qx qy qz tx ty tz".split())}


def image_lines(spark, folder):
    v = vectors(spark, folder, POSE)
    pose = F.concat_ws(" ", F.col("vec_id").cast("string"), *[F.col(n).cast("string") for n in POSE], (F.col("label") % 3).cast("string"), F.concat(F.lit("set a/frame "), F.col("vec_id").cast("string"), F.lit(".jpg")))
    points = F.concat_ws(" ", *[F.lit(f"{i}.5 {i}.25 -1") for i in range(4)])
    return v.select(F.col("label").alias("capture_id"), F.explode(F.array(F.lit("# images"), pose, points)).alias("line"))


@query(
    "src9_sparse_images",
    f"""WITH {vectors_sql(POSE)} SELECT label AS capture_id, vec_id AS image_id, {", ".join(f"round({n}, 9) AS {n}" for n in POSE)}, label % 3 AS camera_id, 'set a/frame ' || vec_id || '.jpg' AS name FROM vectors_v""",
)
def sparse_images(spark, folder):
    return rounded(models.parse_images(image_lines(spark, folder)), 9)


@query(
    "src9_sparse_points",
    """SELECT l_orderkey AS point_id, round(l_quantity, 6) AS x, round(l_extendedprice, 6) AS y, round(l_discount, 6) AS z, CAST(l_linenumber AS INT) AS r, 2 AS g, 3 AS b FROM lineitem""",
)
def sparse_points(spark, folder):
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_linenumber")], F.lit("2 3 0.5 1 2"))
    lines = table(spark, folder, "lineitem").select(line.alias("line"))
    return rounded(models.parse_points(lines))


@query(
    "src12_posed_frames",
    f"""WITH {vectors_sql(POSE)}, u AS (SELECT vec_id, label, tx, ty, tz, qw / n AS qw, qx / n AS qx, qy / n AS qy, qz / n AS qz FROM (SELECT *, sqrt(qw * qw + qx * qx + qy * qy + qz * qz) AS n FROM vectors_v) WHERE vec_id % 7 <> 0)
    SELECT label AS capture_id, vec_id AS image_id, 'images/frame ' || vec_id || '.jpg' AS file_path, TRUE AS shared, 1000.0 + label % 3 AS fl_x,
      round(1 - 2 * (qy * qy + qz * qz), 6) AS m00, round(-(1 - 2 * (qx * qx + qz * qz)), 6) AS m11,
      round(-((1 - 2 * (qy * qy + qz * qz)) * tx + 2 * (qx * qy + qw * qz) * ty + 2 * (qx * qz - qw * qy) * tz), 6) AS m03, 1.0 AS m33 FROM u""",
)
def posed_frames(spark, folder):
    images = models.parse_images(image_lines(spark, folder))
    cams = images.select("capture_id", "camera_id").distinct().select(
        "capture_id", "camera_id", F.lit("PINHOLE").alias("model"), F.lit(1920).alias("width"), F.lit(1080).alias("height"),
        F.create_map(F.lit("fx"), 1000.0 + F.col("camera_id"), F.lit("fy"), F.lit(1000.0), F.lit("cx"), F.lit(960.0), F.lit("cy"), F.lit(540.0)).alias("params"),
    )
    kept = images.filter("image_id % 7 <> 0").select("capture_id", F.concat(F.lit("frame "), F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name"))
    made = models.posed_frames(images, cams, kept)
    return rounded(
        made.select(
            "capture_id", F.col("image_id").cast("long").alias("image_id"), "file_path", "shared", "fl_x",
            *[F.get(F.get("matrix", F.lit(r)), F.lit(c)).alias(f"m{r}{c}") for r, c in ((0, 0), (1, 1), (0, 3), (3, 3))],
        )
    )


@query(
    "src13_motion_sidecar",
    f"""WITH {EVENTS} SELECT capture_id, CAST(round_even(k * 1e6, 0) AS BIGINT) AS t_ns, value AS ax, k AS ay, 9.81 AS az FROM events_v""",
)
def motion_sidecar(spark, folder):
    sample = F.struct(
        F.col("k").alias("t_ms"),
        F.struct(F.col("value").alias("x"), F.col("k").alias("y"), F.lit(9.81).alias("z")).alias("accelerationIncludingGravity"),
    )
    documents = chunked(events(spark, folder)).agg(F.collect_list(sample).alias("samples"))
    text = F.to_json(F.struct(F.lit("recording").alias("time_base"), "samples"))
    rows = sensors.motion_samples(documents.select("capture_id", text.alias("document")))
    return rows.select("capture_id", "t_ns", *[F.element_at("v", i + 1).alias(n) for i, n in enumerate(("ax", "ay", "az"))])


@query(
    "src14_manifest_for_video",
    """SELECT o_orderkey AS capture_id, '0.1' AS version, 'v' || o_orderkey || '.mp4' AS main_file, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS duration_sec,
      CAST(NULL AS BOOLEAN) AS exposure_locked FROM orders""",
)
def manifest_for_video(spark, folder):
    videos = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("capture_id"), F.concat(F.lit("v"), F.col("o_orderkey").cast("string"), F.lit(".mp4")).alias("main_file"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("duration_sec"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("fps"), F.lit("h264").alias("codec"), F.lit(None).cast("bigint").alias("bitrate"), F.lit(None).cast("boolean").alias("has_audio"), F.col("o_orderdate").alias("created_at"),
    )
    made = manifests.parse_manifests(manifests.manifest_for_video(videos)).filter("error IS NULL AND length(manifest.session_id) = 36")
    m = F.col("manifest")
    return made.select(
        "capture_id", m["capturepack_version"].alias("version"), m["video"]["main_file"].alias("main_file"), m["video"]["duration_sec"].alias("duration_sec"),
        m["capture_settings"]["exposure_locked"].alias("exposure_locked"),
    )


@query(
    "src15_read_events",
    f"""WITH {EVENTS} SELECT event_id, t AS t_ns, event_type AS event, CAST(CAST(k AS BIGINT) AS VARCHAR) AS detail FROM events_v WHERE event_type <> 'error'""",
)
def read_events(spark, folder):
    text = F.to_json(F.struct(F.col("t").alias("t_ns"), F.col("event_type").alias("event"), F.col("k").cast("long").alias("detail")))
    lines = events(spark, folder).select("event_id", F.when(F.col("event_type") == "error", "{broken").otherwise(text).alias("line"))
    return sensors.parse_events(lines).select("event_id", "t_ns", "event", F.try_element_at("fields", F.lit("detail")).alias("detail"))


@query(
    "src15_read_stillness",
    f"""WITH {EVENTS} SELECT event_id, t AS t_ns, event_type AS phase, value AS gyro_rms_rad_s, k > 50 AS at_rest FROM events_v""",
)
def read_stillness(spark, folder):
    text = F.to_json(F.struct(F.col("t").alias("t_ns"), F.col("event_type").alias("phase"), F.col("value").alias("gyro_rms_rad_s"), (F.col("k") > 50).alias("at_rest")))
    lines = events(spark, folder).select("event_id", text.alias("line"))
    return sensors.parse_stillness(lines).select("event_id", "t_ns", "phase", "gyro_rms_rad_s", "at_rest")


@query(
    "src11_splat_records",
    f"""WITH {vectors_sql({"qw": 1, "qx": 2, "qy": 3, "qz": 4, "o": 5})}, u AS (SELECT *, sqrt(qw * qw + qx * qx + qy * qy + qz * qz) AS n FROM vectors_v)
    SELECT vec_id AS gid, CAST(trunc(greatest(0, least(255, 255 / (1 + exp(-o))))) AS INT) AS a, {", ".join(f"CAST(trunc(greatest(0, least(255, q{k} / n * 128 + 128))) AS INT) AS b{i}" for i, k in enumerate("wxyz"))} FROM u""",
)
def splat_records(spark, folder):
    from rushlight.functions import encoding as enc
    from rushlight.functions import geometry as g

    rows = vectors(spark, folder, {"qw": 1, "qx": 2, "qy": 3, "qz": 4, "o": 5})
    rows = rows.withColumns(g.named(g.quat_normalise(g.vec("qw", "qx", "qy", "qz")), "qw", "qx", "qy", "qz")).withColumn("opacity", enc.sigmoid(F.col("o")))
    zero = {c: F.lit(0.0) for c in ("x", "y", "z", "sx", "sy", "sz")} | {c: F.lit(0) for c in "rgb"}
    made = splats.splat_records(rows.withColumns(zero).withColumnRenamed("vec_id", "gid"))
    return made.select("gid", "a", "b0", "b1", "b2", "b3")


@query(
    "src11_pack_records",
    """SELECT row_number() OVER (ORDER BY l_quantity, l_discount, l_tax) - 1 AS position, round(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE), 6) AS x,
      round(CAST(CAST(l_discount AS FLOAT) AS DOUBLE), 6) AS y, round(CAST(CAST(l_tax AS FLOAT) AS DOUBLE), 6) AS z, 1.0 AS sx, 1.0 AS sy, 1.0 AS sz,
      CAST(l_quantity AS INT) AS r, 7 AS g, 7 AS b, CAST(trunc(greatest(0, least(255, l_discount * 255))) AS INT) AS a,
      round(127 / CAST(128 AS DOUBLE), 6) AS qw, 0.0 AS qx, 0.0 AS qy, 0.0 AS qz FROM lineitem""",
)
def pack_records(spark, folder):
    """Records written through the sink in the order of their places and read back in byte ranges."""
    import uuid

    from rushlight.plans.sizing import shared_folder

    rows = table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z"), *[F.lit(1.0).alias(c) for c in ("sx", "sy", "sz")],
        F.col("l_quantity").cast("int").alias("r"), *[F.lit(7).alias(c) for c in "gb"], F.col("l_discount").alias("opacity"),
        F.lit(1.0).alias("qw"), *[F.lit(0.0).alias(c) for c in ("qx", "qy", "qz")],
    )
    place = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    splats.write_splat_rows(splats.splat_records(rows), ["x", "y", "z"], place)
    return rounded(splats.read_splat_rows(spark, place, bytes_per_partition=1 << 18))


@query("src4_results_round_trip", """SELECT c_name AS name, c_nationkey AS frames_used, c_acctbal AS "signal_score", c_acctbal > 0 AS registered FROM customer""")
def results_round_trip(spark, folder):
    from rushlight.plans.sizing import shared_folder
    import uuid

    rows = table(spark, folder, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("frames_used"), (F.col("c_acctbal") > 0).alias("registered"),
        F.create_map(F.lit("score"), F.col("c_acctbal")).alias("signals"),
    )
    place = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    manifests.write_results(rows, place, "r1", {"permutations": 10000, "seed": 0})
    return manifests.read_results(spark, f"{place}/jsonl").select("name", "frames_used", "signal_score", "registered")


@query("src5_results_csv", """SELECT c_name AS name, CAST(c_nationkey AS VARCHAR) AS frames_used FROM customer""")
def results_csv(spark, folder):
    from rushlight.plans.sizing import shared_folder
    import uuid

    rows = table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("frames_used"))
    place = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    manifests.write_results(rows, place, "r1")
    manifests.write_results(rows, place, "r1")  # running again replaces the run
    return spark.read.option("header", True).csv(f"{place}/csv").select("name", "frames_used")


TRAINED = {n: i + 1 for i, n in enumerate("x y z opacity scale_0 scale_1 scale_2".split())}


@query(
    "src10_read_splat_table",
    f"""WITH {vectors_sql(TRAINED)} SELECT round(x, 6) AS x, round(opacity, 6) AS opacity, round(scale_2, 6) AS scale_2,
      CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 2 END AS sh_bands, CASE WHEN vec_id % 2 = 1 THEN round(y, 6) END AS weight FROM vectors_v""",
)
def read_splat_table(spark, folder):
    """Vertex files of two layouts made from the vectors, in one folder, read back through the data source."""
    import uuid

    from rushlight.plans.sizing import shared_folder

    place = f"{shared_folder(spark)}/splats-{uuid.uuid4().hex}"
    plain = [(n, "float", "<f4") for n in (*TRAINED, "f_rest_0")]
    layouts = [plain, [plain[2], *plain[:2], *plain[3:], ("f_rest_1", "float", "<f4"), ("weight", "double", "<f8")]]

    def save(batches):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        # one file per Arrow batch and layout, written through the shared folder's own file system
        for number, batch in enumerate(batches):
            for odd, layout in enumerate(layouts):
                part = batch[batch["vec_id"] % 2 == odd]
                rows = np.zeros(len(part), [(n, t) for n, _, t in layout])
                for n, _, _ in layout:
                    rows[n] = part["y"] if n == "weight" else part[n] if n in part else 0.0
                head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(rows)}", *(f"property {k} {n}" for n, k, _ in layout), "end_header"]
                system, inner = splats._open(place)
                system.create_dir(inner, recursive=True)
                with system.open_output_stream(f"{inner}/part-{TaskContext.get().partitionId():05d}-{number:05d}-{odd}.ply") as out:
                    out.write(("\n".join(head) + "\n").encode() + rows.tobytes())
            yield pd.DataFrame({"rows": [len(batch)]})

    vectors(spark, folder, TRAINED).withColumn("f_rest_0", F.lit(0.0)).mapInPandas(save, "rows long").agg(F.sum("rows")).collect()
    rows = splats.read_splat_table(spark, place, bytes_per_partition=4000)
    return rounded(rows.select("x", "opacity", "scale_2", "sh_bands", "weight"))
