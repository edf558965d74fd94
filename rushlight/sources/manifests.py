"""Capture documents: manifests, frame indexes, run results, inventories."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rushlight.operators.catalog import flatten_signals
from rushlight.sources.sensors import capture_from_path

PACK_VERSION = "0.1"  # Fixed value.
# Fixed formats: documents of a capture.
MANIFEST_SCHEMA = (
    "_broken string, capturepack_version string, session_id string, session_name string, capture_type string, target_type string, created_at string, "
    "device struct<manufacturer string, model string, os string, app_version string>, "
    "video struct<main_file string, duration_sec double, width int, height int, fps double, codec string, bitrate bigint, has_audio boolean>, "
    "capture_settings struct<exposure_locked boolean, white_balance_locked boolean, focus_locked boolean, stabilisation_disabled boolean, storage_mode string>, "
    "metadata_files map<string,string>, "
    "protocol struct<name string, fps double, phases array<struct<name string, start_frame int, end_frame int>>, rest_window struct<start_frame int, end_frame int>, auto_stopped boolean, aborted_reason string>, "
    "arc struct<swept_deg_left double, swept_deg_right double, swept_deg_total double, implied_cone_deg double, return_error_deg double, median_rate_deg_per_sec double, duration_sec double>, "
    "photometric struct<exposure_time_ns bigint, sensitivity_iso int, frame_duration_ns bigint, white_balance_mode string, colour_correction_gains array<double>, screen_brightness double, locks_verified_ratio double>, "
    "camera struct<lens_facing string, physical_id string, logical_id string, sensor_orientation_deg int, zoom_ratio double>"
)
FRAME_INDEX_SCHEMA = (
    "source_video string, source_fps double, frames_total_sampled int, frames_used int, frames_skipped_blur int, frames_skipped_duplicate int, "
    "extraction_settings map<string,string>, frames array<struct<index int, timestamp_sec double, blur_vol double, blur_relative double, brightness double, "
    "overexposed_ratio double, underexposed_ratio double, motion_diff double, hist_correlation double, used boolean, file string>>"
)
SIGNAL_NAMES = (
    "vol_mean", "vol_p10", "vol_median", "blurry_frame_ratio", "brightness_mean", "overexposed_ratio", "underexposed_ratio",
    "too_dark_ratio", "too_bright_ratio", "motion_mean", "too_fast_ratio", "duplicate_ratio", "score",
)
RESULT_SCHEMA = (
    "name string, project_id string, source string, label string, frames_used int, frames_sampled int, frames_skipped_blur int, frames_skipped_duplicate int, "
    "duration_sec double, resolution string, registered boolean, registered_ratio double, images_registered int, sparse_points int, pose_status string, "
    "seconds_telemetry double, seconds_frames double, seconds_pose double, seeded_intrinsics boolean, seed_fx double, solved_fx double, error string, "
    + ", ".join(f"signal_{n} double" for n in SIGNAL_NAMES)
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: capture and whole text."""
    return spark.read.text(path, wholetext=True).select(capture_from_path().alias("capture_id"), F.col("value").alias("document"))


def parse_manifests(documents: DataFrame) -> DataFrame:
    """Typed manifests; a missing or broken document is an error row, never a failure."""
    parsed = documents.withColumn(
        "manifest", F.from_json("document", MANIFEST_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    )
    broken = F.col("document").isNull() | F.col("manifest").isNull() | F.col("manifest._broken").isNotNull()
    keep = [c for c in documents.columns if c != "document"]
    return parsed.select(
        *keep,
        F.when(~broken, F.col("manifest")).alias("manifest"),
        F.when(F.col("document").isNull(), "missing").when(broken, "invalid_json").alias("error"),
    )


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifests(read_documents(spark, path))


def parse_frame_index(documents: DataFrame) -> DataFrame:
    """Header and per-frame rows of frame index documents, rejected frames included."""
    parsed = documents.withColumn("_d", F.from_json("document", FRAME_INDEX_SCHEMA))
    head = [F.col(f"_d.{n}").alias(n) for n in ("source_video", "source_fps", "frames_total_sampled", "frames_used")]
    return parsed.select("capture_id", *head, F.explode("_d.frames").alias("_f")).select(
        "capture_id", "source_video", "source_fps", "frames_total_sampled", "frames_used", "_f.*"
    )


def read_frame_index(spark: SparkSession, path: str) -> DataFrame:
    return parse_frame_index(read_documents(spark, path))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Run results as JSON lines; blank lines are skipped, a missing path is an error.

    Fields outside the schema are kept as text in the map ``extras``. A line that does not parse, or names no run, is a
    row of its own with the whole line in ``broken``.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("_r", F.from_json("value", RESULT_SCHEMA)).withColumn("_all", F.from_json("value", "map<string,string>"))
    fields = [f.split()[0] for f in RESULT_SCHEMA.split(", ")]
    extras = F.map_filter("_all", lambda k, v: ~k.isin(*fields) & v.isNotNull())
    return parsed.select(
        *[F.col(f"_r.{f}").alias(f) for f in fields],
        extras.alias("extras"),
        F.when(F.col("_r.name").isNull(), F.col("value")).alias("broken"),
        *[c for c in lines.columns if c != "value"],
    )


def write_results(rows: DataFrame, folder: str, run_id: str, config: dict | None = None) -> None:
    """Write one run's rows as JSON lines and CSV under ``run_id=``; running again replaces the run.

    Map columns are flattened first; signals outside the usual names stay together in the text column
    ``more_signals``. The pinned settings lie beside the rows.
    """
    flat = rows
    if "signals" in rows.columns:
        more = F.map_filter("signals", lambda k, _: ~k.isin(*SIGNAL_NAMES))
        kept = rows.withColumn("more_signals", F.when(F.size(more) > 0, F.to_json(more)))
        flat = flatten_signals(kept, list(SIGNAL_NAMES))
    flat.write.mode("overwrite").json(f"{folder}/jsonl/run_id={run_id}")
    flat.write.mode("overwrite").option("header", True).csv(f"{folder}/csv/run_id={run_id}")
    if config is not None:
        settings = rows.sparkSession.createDataFrame([(k, str(v)) for k, v in sorted(config.items())], "key string, value string")
        settings.coalesce(1).write.mode("overwrite").json(f"{folder}/run_config/run_id={run_id}")


HASH_CHUNK = 1 << 20
CHECKSUM_FOLDER = "checksums/"  # Fixed value: not part of the payload.


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``<root>/<capture>/`` with its relative path and size; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = root.rstrip("/").split("/")[-1]
    split = rf"^.*/{base}/([^/]+)/(.*)$"
    listed = files.select(
        F.regexp_extract("path", split, 1).alias("capture_id"),
        F.regexp_extract("path", split, 2).alias("path"),
        F.col("path").alias("location"),
        "length",
    )
    return listed.filter(~F.col("path").startswith(CHECKSUM_FOLDER))


def _digest(location: str) -> str:
    """SHA-256 of a file, a megabyte at a time."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(location if "://" in location or location.startswith("file:") else f"file://{os.path.abspath(location)}")
    seen = hashlib.sha256()
    with system.open_input_stream(path) as stream:
        while chunk := stream.read(HASH_CHUNK):
            seen.update(chunk)
    return seen.hexdigest()


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files with size and SHA-256; a file of any size is hashed in one megabyte of memory."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            local = batch["location"].str.replace(r"^file:/+", "file:///", regex=True)
            yield batch.assign(sha256=[_digest(v) for v in local])

    listed = list_files(spark, root)
    # listing packs many files into a task; hashing is the work, so it is spread by file
    return listed.repartition("capture_id", "path").mapInPandas(
        hashed, "capture_id string, path string, location string, length long, sha256 string"
    ).drop("location")


def inventory_of_rows(rows: DataFrame, capture: str, path: str, content: str) -> DataFrame:
    """Inventory of contents that are already columns."""
    return rows.select(
        F.col(capture).alias("capture_id"),
        F.col(path).alias("path"),
        F.octet_length(content).cast("long").alias("length"),
        F.sha2(F.col(content), 256).alias("sha256"),
    )


def session_of(capture: str) -> Column:
    """A session id in the usual shape that depends on the capture alone, so a task that runs again gives the same."""
    digest = F.md5(F.concat(F.lit("session:"), F.col(capture).cast("string")))
    return F.concat_ws("-", *[F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def manifest_for_video(videos: DataFrame, session: Column | None = None) -> DataFrame:
    """Minimal manifests for bare videos: what is not known is NULL, never a default.

    ``videos``: capture_id, main_file, duration_sec, width, height, fps, codec, bitrate,
    has_audio, created_at.
    """
    unknown = F.lit(None).cast("boolean")
    body = F.struct(
        F.lit(PACK_VERSION).alias("capturepack_version"),
        (session if session is not None else session_of("capture_id")).alias("session_id"),
        F.lit(None).cast("string").alias("session_name"),
        F.lit("static_scene").alias("capture_type"),
        F.lit("unknown").alias("target_type"),
        F.col("created_at").cast("string").alias("created_at"),
        F.struct(
            F.lit("unknown").alias("manufacturer"), F.lit("phone_video_import").alias("model"), F.lit("unknown").alias("os"), F.lit(PACK_VERSION).alias("app_version")
        ).alias("device"),
        F.struct("main_file", "duration_sec", "width", "height", "fps", "codec", "bitrate", "has_audio").alias("video"),
        F.struct(
            unknown.alias("exposure_locked"), unknown.alias("white_balance_locked"), unknown.alias("focus_locked"),
            F.lit("unknown").alias("storage_mode"),
        ).alias("capture_settings"),
        F.create_map(*[v for k in ("intrinsics", "poses", "imu", "light", "audio") for v in (F.lit(k), F.lit(None).cast("string"))]).alias("metadata_files"),
    )
    return videos.select("capture_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))
