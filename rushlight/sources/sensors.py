"""Sensor, frame, event and detector logs: JSON lines to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed formats: log schemas and the sensor type that carries gravity.
IMU_SCHEMA = "type string, t_ns bigint, t_rel_ns bigint, v array<double>, accuracy int"
FRAME_SCHEMA = (
    "t_ns bigint, capture_frame bigint, frame bigint, phase string, iso int, exposure_ns bigint, "
    "focus_distance double, aperture double, focal_length_mm double, crop array<int>, ae_state int, "
    "awb_state int, lens_state int, rolling_shutter_skew_ns bigint, physical_id string"
)
STILLNESS_SCHEMA = (
    "t_ns bigint, phase string, gyro_rms_rad_s double, accel_rms_m_s2 double, tilt_deg double, "
    "at_rest boolean, rest_for_ms double"
)
MOTION_SCHEMA = (
    "time_base string, samples array<struct<t_ms double, acceleration struct<x double, y double, z double>, "
    "accelerationIncludingGravity struct<x double, y double, z double>, "
    "rotationRate struct<alpha double, beta double, gamma double>, interval double>>, "
    "orientation_samples array<struct<t_ms double, alpha double, beta double, gamma double>>"
)
ACCELEROMETER = "android.sensor.accelerometer"


def capture_from_path() -> Column:
    """The folder that holds the file; packs are laid out as ``<capture>/<file>``."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Text lines with their capture and, for batch reads, their place in the file."""
    if stream:
        return spark.readStream.text(path).select(capture_from_path().alias("capture_id"), F.col("value").alias("line"))
    return spark.read.text(path).select(
        capture_from_path().alias("capture_id"),
        F.col("value").alias("line"),
        # a block is read by one task, front to back, so the pair is file order
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_no"),
    )


def parse_json_lines(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """Typed columns beside the other columns; a malformed line becomes all NULL."""
    return lines.withColumn("_j", F.from_json(line, schema, {"mode": "PERMISSIVE"})).select(
        *[c for c in lines.columns if c != line], "_j.*"
    )


def parse_imu(lines: DataFrame) -> DataFrame:
    """Accelerometer samples with three components and a time."""
    rows = parse_json_lines(lines, IMU_SCHEMA)
    return rows.filter((F.col("type") == ACCELEROMETER) & F.col("t_ns").isNotNull() & (F.size("v") == 3))


def with_stream(samples: DataFrame, capture: str = "capture_id", least: int = 2) -> DataFrame:
    """Samples of captures that have at least ``least`` of them."""
    enough = samples.groupBy(capture).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    return samples.join(enough, capture, "left_semi")


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    return with_stream(parse_imu(read_lines(spark, path).drop("line_no")))


def last_per_frame(rows: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Last row in order wins for each key; combined before the shuffle."""
    place = F.struct(*[F.col(o) for o in order])
    return rows.groupBy(*keys).agg(*[F.max_by(F.col(c), place).alias(n) for n, c in columns.items()])


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Per-frame metadata; the last line of a duplicated frame number wins."""
    rows = parse_json_lines(read_lines(spark, path), FRAME_SCHEMA).filter(
        F.col("t_ns").isNotNull() & F.col("frame").isNotNull()
    )
    names = [c for c in rows.columns if c not in ("capture_id", "frame", "line_no")]
    whole = rows.groupBy("capture_id", "frame").agg(F.max_by(F.struct(*names), "line_no").alias("_r"))
    return whole.select("capture_id", "frame", "_r.*")


def parse_events(lines: DataFrame) -> DataFrame:
    """Open event records: time and name typed, every other field kept as text."""
    fields = F.from_json("line", "map<string,string>")
    rows = lines.withColumn("_m", fields)
    return rows.select(
        *[c for c in lines.columns if c != "line"],
        F.try_element_at("_m", F.lit("t_ns")).cast("long").alias("t_ns"),
        F.try_element_at("_m", F.lit("event")).alias("event"),
        F.map_filter("_m", lambda k, _: ~k.isin("t_ns", "event")).alias("fields"),
    ).filter(F.col("t_ns").isNotNull())


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    lines = read_lines(spark, path, stream)
    return parse_events(lines.drop("line_no"))


def parse_stillness(lines: DataFrame) -> DataFrame:
    return parse_json_lines(lines, STILLNESS_SCHEMA).filter(F.col("t_ns").isNotNull())


def read_stillness(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return parse_stillness(read_lines(spark, path, stream).drop("line_no"))


def motion_samples(documents: DataFrame) -> DataFrame:
    """Browser motion documents (``capture_id, document``) in the IMU schema; ms become ns."""
    parsed = documents.withColumn("_d", F.from_json("document", MOTION_SCHEMA))
    each = parsed.select("capture_id", F.explode("_d.samples").alias("s"))
    a = F.col("s.accelerationIncludingGravity")
    t = F.rint(F.col("s.t_ms") * 1e6).cast("long")
    return each.select(
        "capture_id",
        F.lit(ACCELEROMETER).alias("type"),
        t.alias("t_ns"),
        t.alias("t_rel_ns"),
        F.array(a["x"], a["y"], a["z"]).alias("v"),
        F.lit(None).cast("int").alias("accuracy"),
    ).filter(F.col("t_ns").isNotNull())


def read_motion_sidecar(spark: SparkSession, path: str) -> DataFrame:
    documents = spark.read.text(path, wholetext=True).select(
        capture_from_path().alias("capture_id"), F.col("value").alias("document")
    )
    return motion_samples(documents)
