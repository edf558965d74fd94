"""Data-quality rule sets on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushlight.operators import integrity, scenes
from rushlight.queries.registry import query
from rushlight.session import table


@query(
    "dq1_validate_manifest",
    """WITH p AS (SELECT o_orderkey AS capture_id, CASE WHEN o_orderstatus <> 'P' THEN 'video.mp4' END AS main_file, o_totalprice > 100000 AS has_imu, o_orderpriority LIKE '1%' AS locked FROM orders)
    SELECT capture_id, 'error' AS level, 'main_file' AS code FROM p WHERE main_file IS NULL
    UNION ALL SELECT capture_id, 'warning', 'imu' FROM p WHERE NOT has_imu
    UNION ALL SELECT capture_id, 'warning', unnest(['intrinsics', 'poses', 'light']) FROM p
    UNION ALL SELECT capture_id, 'warning', 'exposure' FROM p WHERE NOT locked
    UNION ALL SELECT capture_id, 'warning', 'white_balance' FROM p""",
)
def validate_manifest(spark, folder):
    orders = table(spark, folder, "orders")
    none = F.lit(None).cast("string")
    packs = orders.select(
        F.col("o_orderkey").alias("capture_id"), F.when(F.col("o_orderstatus") != "P", F.lit("video.mp4")).alias("main_file"),
        none.alias("intrinsics"), none.alias("poses"), F.lit("imu.jsonl").alias("imu"), F.lit("light.jsonl").alias("light"),
        F.col("o_orderpriority").startswith("1").alias("exposure_locked"), F.lit(None).cast("boolean").alias("white_balance_locked"),
    )
    found = F.array_compact(F.array(F.lit("video.mp4"), F.when(F.col("o_totalprice") > 100000, "imu.jsonl")))
    files = orders.select(F.col("o_orderkey").alias("capture_id"), F.explode(found).alias("path"))
    return integrity.validate_manifest(packs, files).drop("message")


@query(
    "dq2_validate_transforms",
    """WITH f AS (SELECT vec_id AS frame, label AS capture_id, CASE WHEN embedding[1] > 0 THEN 'images/' || vec_id || '.jpg' END AS path, embedding[2] > 0 AS shaped, embedding[3] > 0 AS bottom, embedding[4] > 0 AS lens FROM embeddings),
    lost AS (SELECT capture_id, count(*) AS n FROM f WHERE path IS NOT NULL AND frame % 5 = 0 GROUP BY 1)
    SELECT capture_id, frame, 'error' AS level, 'no_path' AS code FROM f WHERE path IS NULL
    UNION ALL SELECT capture_id, frame, 'error', 'no_matrix' FROM f WHERE NOT shaped
    UNION ALL SELECT capture_id, frame, 'warning', 'bottom_row' FROM f WHERE shaped AND NOT bottom
    UNION ALL SELECT capture_id, frame, 'error', 'no_intrinsics' FROM f WHERE NOT lens
    UNION ALL SELECT capture_id, NULL, 'error', 'missing_images' FROM lost
    UNION ALL SELECT n_nationkey, NULL, 'error', 'no_frames' FROM nation WHERE n_nationkey NOT IN (SELECT capture_id FROM f)""",
)
def validate_transforms(spark, folder):
    e = table(spark, folder, "embeddings")
    row = F.array(*[F.lit(0.0)] * 4)
    last = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.when(F.element_at("embedding", 3) > 0, 1.0).otherwise(2.0))
    matrix = F.when(F.element_at("embedding", 2) > 0, F.array(row, row, row, last)).otherwise(F.array(row, last))
    path = F.concat(F.lit("images/"), F.col("vec_id").cast("string"), F.lit(".jpg"))
    frames = e.select(
        F.col("label").alias("capture_id"), F.col("vec_id").alias("frame"), F.when(F.element_at("embedding", 1) > 0, path).alias("file_path"),
        matrix.alias("matrix"), F.when(F.element_at("embedding", 4) > 0, 500.0).alias("fl_x"), F.lit(False).alias("has_top_level_intrinsics"),
    )
    images = e.filter("vec_id % 5 <> 0").select(F.col("label").alias("capture_id"), path.alias("file_path"))
    captures = table(spark, folder, "nation").select(F.col("n_nationkey").cast("int").alias("capture_id"))
    return integrity.validate_transforms(frames, images, captures=captures).drop("message")


@query(
    "dq3_validate_dataset",
    """WITH s AS (SELECT c_custkey AS capture_id, c_acctbal / 1000 AS qn, c_nationkey - 3 AS cone, c_mktsegment <> 'AUTOMOBILE' AS cameras, c_mktsegment = 'BUILDING' AS verified FROM customer),
    t AS (SELECT o_custkey AS capture_id, o_orderkey, (o_orderkey - min(o_orderkey) OVER w) / CAST(greatest(max(o_orderkey) OVER w - min(o_orderkey) OVER w, 1) AS DOUBLE) AS time, o_orderstatus FROM orders WINDOW w AS (PARTITION BY o_custkey)),
    f AS (SELECT capture_id, arg_max(time, o_orderkey) AS last, count(*) AS n, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS lost FROM t GROUP BY 1),
    j AS (SELECT s.*, f.last, coalesce(n, 0) AS n, coalesce(lost, 0) AS lost FROM s LEFT JOIN f USING (capture_id))
    SELECT capture_id, 'error' AS level, 'no_frames' AS code FROM j WHERE n = 0
    UNION ALL SELECT capture_id, 'error', 'times' FROM j WHERE n > 0 AND abs(last - 1) > 1e-9
    UNION ALL SELECT capture_id, 'error', 'missing_files' FROM j WHERE lost > 0
    UNION ALL SELECT capture_id, 'error', 'no_camera' FROM j WHERE NOT cameras
    UNION ALL SELECT capture_id, 'error', 'pose' FROM j WHERE abs(abs(qn) - 1) > 1e-6
    UNION ALL SELECT capture_id, 'error', 'cone' FROM j WHERE cone <= 0
    UNION ALL SELECT capture_id, 'note', 'unverified' FROM j WHERE NOT verified""",
)
def validate_dataset(spark, folder):
    c = table(spark, folder, "customer")
    facts = c.select(
        F.col("c_custkey").alias("capture_id"), (F.col("c_acctbal") / 1000).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"),
        (F.col("c_nationkey") - 3).alias("azimuth_half_deg"), (F.col("c_mktsegment") != "AUTOMOBILE").alias("has_cameras"), (F.col("c_mktsegment") == "BUILDING").alias("pose_verified"),
    )
    o = table(spark, folder, "orders")
    from rushlight.operators.phases import normalised_time

    path = F.concat(F.lit("frames/"), F.col("o_orderkey").cast("string"))
    frames = normalised_time(o.select(F.col("o_custkey").alias("capture_id"), "o_orderkey", "o_orderstatus", path.alias("file")), "capture_id", "o_orderkey")
    frames = frames.withColumn("mask", F.col("file")).withColumnRenamed("o_orderkey", "index")
    files = o.filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("capture_id"), path.alias("path"))
    return scenes.validate_dataset(facts, frames, files).drop("message")


@query(
    "dq4_validate_scene",
    """WITH s AS (SELECT l_suppkey AS scene_id, count(*) AS n, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS dynamic, count(DISTINCT l_partkey) AS nodes, count(DISTINCT l_shipdate) AS frames,
      count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS skins FROM lineitem GROUP BY 1),
    t AS (SELECT s.*, CASE WHEN scene_id % 2 = 0 THEN 30.0 ELSE 0.0 END AS fps FROM s)
    SELECT scene_id, 'error' AS level, 'nodes' AS code FROM t WHERE nodes > 256
    UNION ALL SELECT scene_id, 'error', 'skin_rows' FROM t WHERE skins <> dynamic
    UNION ALL SELECT scene_id, 'error', 'skin_index' FROM lineitem_v WHERE bad > 0
    UNION ALL SELECT scene_id, 'error', 'fps' FROM t WHERE fps <= 0""".replace(
        "WITH s AS", "WITH lineitem_v AS (SELECT l_suppkey AS scene_id, count(CASE WHEN l_returnflag = 'A' AND l_linenumber > 5 THEN 1 END) AS bad FROM lineitem GROUP BY 1), s AS"
    ),
)
def validate_scene(spark, folder):
    items = table(spark, folder, "lineitem").withColumnRenamed("l_suppkey", "scene_id")
    splats = items.select("scene_id", (F.col("l_linestatus") == "F").alias("dynamic"))
    # every part a supplier ships is a node, every ship date a frame; line numbers over 5 point outside
    nodes = items.groupBy("scene_id").agg(F.count_distinct("l_partkey").alias("node_count"))
    frames = items.groupBy("scene_id").agg(F.count_distinct("l_shipdate").alias("frame_count"))
    skin = items.filter("l_returnflag = 'A'").select(
        "scene_id", F.array(F.when(F.col("l_linenumber") > 5, 1_000_000).otherwise(F.col("l_linenumber"))).alias("idx")
    )
    facts = nodes.join(frames, "scene_id").withColumn("fps", F.when(F.col("scene_id") % 2 == 0, 30.0).otherwise(0.0))
    return scenes.validate_scene(facts, splats, skin).drop("message")


@query(
    "dq4_orphan_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p_size > 10)""",
)
def orphan_rows(spark, folder):
    child = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parent = table(spark, folder, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return integrity.orphan_rows(child, parent, ["l_partkey"])


@query(
    "dq5_camera_matches_frames",
    """SELECT p_partkey AS capture_id, p_size AS camera_width, p_size AS camera_height, p_partkey % 50 AS frame_width, p_size AS frame_height FROM part
    WHERE p_size > 0 AND p_partkey % 50 > 0 AND p_size <> p_partkey % 50""",
)
def camera_matches(spark, folder):
    pairs = table(spark, folder, "part").select(
        F.col("p_partkey").alias("capture_id"), F.col("p_size").alias("camera_width"), F.col("p_size").alias("camera_height"),
        (F.col("p_partkey") % 50).alias("frame_width"), F.col("p_size").alias("frame_height"),
    )
    return integrity.camera_matches_frames(pairs)


@query(
    "dq6_manifest_schema",
    """WITH m AS (SELECT o_orderkey AS capture_id, o_orderstatus, o_orderpriority, o_totalprice FROM orders)
    SELECT capture_id, 'not_json' AS code FROM m WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '1%'
    UNION ALL SELECT capture_id, unnest(['created_at', 'video']) FROM m WHERE o_orderstatus = 'P' AND o_orderpriority NOT LIKE '1%'
    UNION ALL SELECT capture_id, 'capture_type' FROM m WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '2%'
    UNION ALL SELECT capture_id, 'capturepack_version' FROM m WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '3%'
    UNION ALL SELECT capture_id, 'video_width' FROM m WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '4%'
    UNION ALL SELECT capture_id, 'colour_gains' FROM m WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '1%'
    UNION ALL SELECT capture_id, 'phase_name' FROM m WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '2%'
    UNION ALL SELECT capture_id, 'lens_facing' FROM m WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '3%'""",
)
def manifest_schema(spark, folder):
    status, level = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    head = '{"session_id":"s","capturepack_version":"%s","created_at":"2024","capture_type":"%s","video":{"main_file":"v.mp4","width":%s}%s}'

    def doc(version="0.3", kind="static_scene", width="1920", rest=""):
        return F.lit(head % (version, kind, width, rest))

    text = (
        F.when((status == "P") & (level == "1"), F.lit('{"session_id": '))
        .when(status == "P", F.lit('{"session_id":"s","capturepack_version":"0.3"}'))
        .when((status == "F") & (level == "2"), doc(kind="movie"))
        .when((status == "F") & (level == "3"), doc(version="three"))
        .when((status == "F") & (level == "4"), doc(width="0"))
        .when((status == "O") & (level == "1"), doc(rest=',"photometric":{"colour_correction_gains":[1.0,2.0]}'))
        .when((status == "O") & (level == "2"), doc(rest=',"protocol":{"phases":[{"name":"spin","start_frame":0,"end_frame":3}]}'))
        .when((status == "O") & (level == "3"), doc(rest=',"camera":{"lens_facing":"sideways"}'))
        .otherwise(doc())
    )
    docs = table(spark, folder, "orders").select(F.col("o_orderkey").alias("capture_id"), text.alias("document"))
    return scenes.manifest_schema(docs).select("capture_id", "code")
