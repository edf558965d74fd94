"""Rule sets for prepared datasets, 4-D scenes and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushlight.functions import geometry as g
from rushlight.operators.integrity import issue, issue_rows
from rushlight.operators.joins import PHASE_ORDER
from rushlight.operators.skinning import MAX_INFLUENCES, MAX_NODES
from rushlight.sources.manifests import MANIFEST_SCHEMA

UNIT_TOLERANCE = 1e-6  # Fixed value.


def validate_dataset(facts: DataFrame, frames: DataFrame, files: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Issues of prepared datasets.

    ``facts``: capture, pose quaternion q*, azimuth_half_deg, has_cameras, pose_verified.
    ``frames``: capture, index, time, file, mask. ``files``: capture, path.
    """
    c = F.col
    named = frames.select(capture, F.explode(F.array_distinct(F.array("file", "mask"))).alias("path"))
    lost = (
        named.join(files.select(capture, "path").distinct(), [capture, "path"], "left_anti")
        .groupBy(capture)
        .agg(F.count(F.lit(1)).alias("_lost"))
    )
    # times rise with the index exactly when ordering by either gives the same ends and no repeats
    times = frames.groupBy(capture).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("time", "index").alias("_t0"),
        F.max_by("time", "index").alias("_t1"),
    )
    back = _steps_back(frames, capture)
    joined = facts.join(times, capture, "left").join(lost, capture, "left").join(back, capture, "left")
    size = g.length(tuple(c(n).cast("double") for n in ("qw", "qx", "qy", "qz")))
    timed = c("_n").isNotNull()
    rules = [
        issue("error", "no_frames", ~timed, "dataset lists no frames"),
        issue("error", "missing_files", c("_lost") > 0, "a frame references a file that does not exist"),
        issue("error", "times", timed & ((c("_t0") != 0) | (F.abs(c("_t1") - 1) > 1e-9)), "frame times must span exactly 0 to 1"),
        issue("error", "time_order", c("_back") > 0, "frame times are not strictly increasing"),
        issue("error", "no_camera", ~F.coalesce(c("has_cameras"), F.lit(False)), "no camera file"),
        issue("error", "pose", size.isNull() | (F.abs(size - 1) > UNIT_TOLERANCE), "fixed pose is not a unit quaternion"),
        issue("error", "cone", F.coalesce(c("azimuth_half_deg"), F.lit(0)) <= 0, "view cone has zero width"),
        issue("note", "unverified", ~F.coalesce(c("pose_verified"), F.lit(False)), "fixed pose was never confirmed"),
    ]
    return issue_rows(joined, [capture], rules)


def _steps_back(frames: DataFrame, capture: str) -> DataFrame:
    from rushlight.plans.timeline import Timeline

    line = Timeline.measure(frames, [capture], "index")
    stepped = line.rolling(
        frames.select(capture, "index", "time"), 1, 0, lambda ordered, _: {"_before": F.lag("time").over(ordered)}
    )
    return stepped.groupBy(capture).agg(F.count_if(F.col("time") <= F.col("_before")).alias("_back"))


def validate_scene(facts: DataFrame, splats: DataFrame, skin: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Issues of 4-D scenes.

    ``facts``: scene, node_count, frame_count, fps. ``splats``: scene, dynamic. ``skin``: scene,
    idx (one row per dynamic splat).
    """
    c = F.col
    counts = splats.groupBy(scene).agg(F.count(F.lit(1)).alias("_n"), F.count_if("dynamic").alias("_moving"))
    bound = skin.groupBy(scene).agg(
        F.count(F.lit(1)).alias("_skins"),
        F.min(F.size("idx")).alias("_k0"),
        F.max(F.size("idx")).alias("_k1"),
        F.min(F.array_min("idx")).alias("_low"),
        F.max(F.array_max("idx")).alias("_high"),
    )
    joined = facts.join(counts, scene, "left").join(bound, scene, "left").fillna(0, ["_n", "_moving", "_skins"])
    moving = c("_moving") > 0
    rules = [
        issue("error", "empty", c("_n") == 0, "a scene needs at least one gaussian"),
        issue("error", "nodes", ~c("node_count").between(1, MAX_NODES), "node count out of range"),
        issue("error", "frames", c("frame_count") < 1, "a scene needs at least one frame"),
        issue("error", "skin_rows", c("_skins") != c("_moving"), "skin rows differ from dynamic gaussians"),
        issue("error", "skin_k", moving & ((c("_k0") < 1) | (c("_k1") > MAX_INFLUENCES) | (c("_k0") != c("_k1"))), "influences per row out of range"),
        issue("error", "skin_index", moving & ((c("_low") < 0) | (c("_high") >= c("node_count"))), "skin index outside the scaffold"),
        issue("error", "fps", c("fps") <= 0, "fps must be positive"),
    ]
    return issue_rows(joined, [scene], rules)


# Enums and required keys of a manifest.
CAPTURE_TYPES = ("static_scene", "dynamic_subject", "fixed_camera_4d", "unknown")
LENS_FACING = ("front", "back", "external", "unknown")
VERSION_PATTERN = r"^[0-9]+\.[0-9]+$"
MAIN_FILE_PATTERN = r"^[^/].*"
GAIN_COUNT = 4


def manifest_schema(documents: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Schema issues of manifest documents (``capture, document``), one row per broken rule."""
    m = F.col("m")
    parsed = documents.withColumn("m", F.from_json("document", MANIFEST_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    broken = m.isNull() | m["_broken"].isNotNull()

    def rule(code: str, test: Column) -> Column:
        return issue("error", code, ~broken & F.coalesce(test, F.lit(False)), code)

    def below(value: Column, least: float = 0) -> Column:
        return value < least

    phases = m["protocol"]["phases"]
    rest = m["protocol"]["rest_window"]
    photo, arc = m["photometric"], m["arc"]
    rules = [issue("error", "not_json", broken, "manifest is not valid JSON")]
    rules += [rule(k, m[k].isNull()) for k in ("capturepack_version", "session_id", "created_at", "video")]
    rules += [
        rule("capturepack_version", ~m["capturepack_version"].rlike(VERSION_PATTERN)),
        rule("capture_type", ~m["capture_type"].isin(*CAPTURE_TYPES)),
        rule("video_main_file", m["video"].isNotNull() & (m["video"]["main_file"].isNull() | ~m["video"]["main_file"].rlike(MAIN_FILE_PATTERN))),
        rule("video_width", below(m["video"]["width"], 1)),
        rule("video_height", below(m["video"]["height"], 1)),
        *[rule(f"video_{k}", below(m["video"][k])) for k in ("duration_sec", "fps", "bitrate")],
        rule("phases", m["protocol"].isNotNull() & (phases.isNull() | (F.size(phases) < 1))),
        rule("phase_name", F.exists(phases, lambda p: p["name"].isNull() | ~p["name"].isin(*PHASE_ORDER))),
        rule(
            "phase_bounds",
            F.exists(
                phases,
                lambda p: p["start_frame"].isNull() | p["end_frame"].isNull() | (p["start_frame"] < 0) | (p["end_frame"] < 0),
            ),
        ),
        rule("protocol_fps", below(m["protocol"]["fps"])),
        rule(
            "rest_window",
            rest.isNotNull()
            & (rest["start_frame"].isNull() | rest["end_frame"].isNull() | (rest["start_frame"] < 0) | (rest["end_frame"] < 0)),
        ),
        *[rule(f"arc_{k}", below(arc[k])) for k in ("swept_deg_total", "implied_cone_deg", "median_rate_deg_per_sec", "duration_sec")],
        *[rule(f"photometric_{k}", below(photo[k])) for k in ("exposure_time_ns", "sensitivity_iso", "frame_duration_ns")],
        rule("colour_gains", photo["colour_correction_gains"].isNotNull() & (F.size(photo["colour_correction_gains"]) != GAIN_COUNT)),
        *[rule(f"photometric_{k}", ~photo[k].between(0, 1)) for k in ("screen_brightness", "locks_verified_ratio")],
        rule("lens_facing", ~m["camera"]["lens_facing"].isin(*LENS_FACING)),
        rule("zoom_ratio", below(m["camera"]["zoom_ratio"])),
    ]
    return issue_rows(parsed, [capture], rules)
