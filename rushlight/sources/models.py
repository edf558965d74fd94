"""Sparse reconstruction tables and posed-frame documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rushlight.functions import geometry as g
from rushlight.plans.sizing import small

# Fixed formats: parameter names of the camera models of the sparse text dialect.
CAMERA_PARAMS = {
    "SIMPLE_PINHOLE": ("f", "cx", "cy"),
    "PINHOLE": ("fx", "fy", "cx", "cy"),
    "SIMPLE_RADIAL": ("f", "cx", "cy", "k1"),
    "RADIAL": ("f", "cx", "cy", "k1", "k2"),
    "OPENCV": ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2"),
    "OPENCV_FISHEYE": ("fx", "fy", "cx", "cy", "k1", "k2", "k3", "k4"),
    "FULL_OPENCV": ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3", "k4", "k5", "k6"),
    "FOV": ("fx", "fy", "cx", "cy", "omega"),
    "SIMPLE_RADIAL_FISHEYE": ("f", "cx", "cy", "k1"),
    "RADIAL_FISHEYE": ("f", "cx", "cy", "k1", "k2"),
    "THIN_PRISM_FISHEYE": ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3", "k4", "sx1", "sy1"),
}
# The name each model goes by in posed-frame documents.
POSED_MODEL = {
    "SIMPLE_PINHOLE": "PINHOLE",
    "PINHOLE": "PINHOLE",
    "SIMPLE_RADIAL": "OPENCV",
    "RADIAL": "OPENCV",
    "OPENCV": "OPENCV",
    "FULL_OPENCV": "OPENCV",
    "OPENCV_FISHEYE": "OPENCV_FISHEYE",
    "SIMPLE_RADIAL_FISHEYE": "OPENCV_FISHEYE",
    "RADIAL_FISHEYE": "OPENCV_FISHEYE",
}
DISTORTION = ("k1", "k2", "p1", "p2")


def _by_model(values: dict[str, Column], otherwise: Column) -> Column:
    case = None
    for name, value in values.items():
        case = F.when(F.col("model") == name, value) if case is None else case.when(F.col("model") == name, value)
    return case.otherwise(otherwise)


def data_lines(lines: DataFrame) -> DataFrame:
    """Tokens of the lines that are neither blank nor comments."""
    text = F.trim("line")
    return lines.filter((text != "") & ~text.startswith("#")).withColumn("_t", F.split(text, r"\s+"))


def _token(i: int, kind: str) -> Column:
    return F.get("_t", F.lit(i)).try_cast(kind)


def parse_cameras(lines: DataFrame) -> DataFrame:
    rows = data_lines(lines)
    keep = [c for c in lines.columns if c not in ("line", "line_no")]
    values = F.transform(F.slice("_t", 5, F.greatest(F.size("_t") - 4, F.lit(0))), lambda v: v.try_cast("double"))
    rows = rows.select(
        *keep, _token(0, "int").alias("camera_id"), F.get("_t", F.lit(1)).alias("model"),
        _token(2, "long").alias("width"), _token(3, "long").alias("height"), values.alias("_v"),
    )
    names = _by_model({m: F.array(*[F.lit(n) for n in p]) for m, p in CAMERA_PARAMS.items()}, F.array().cast("array<string>"))
    size = F.least(F.size(names), F.size("_v"))
    return rows.withColumn("params", F.map_from_arrays(F.slice(names, 1, size), F.slice("_v", 1, size))).drop("_v")


def parse_images(lines: DataFrame) -> DataFrame:
    """Pose lines, told from the interleaved 2-D point lines by shape."""
    keep = [c for c in lines.columns if c not in ("line", "line_no")]
    numbers = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
    rows = data_lines(lines).filter(F.size("_t") >= 10).select(
        *keep,
        _token(0, "int").alias("image_id"),
        *[_token(i + 1, "double").alias(n) for i, n in enumerate(numbers)],
        _token(8, "int").alias("camera_id"),
        F.array_join(F.slice("_t", 10, F.size("_t")), " ").alias("name"),
    )
    for name in ("image_id", *numbers, "camera_id"):
        rows = rows.filter(F.col(name).isNotNull())
    return rows


def parse_points(lines: DataFrame) -> DataFrame:
    keep = [c for c in lines.columns if c not in ("line", "line_no")]
    return data_lines(lines).filter(F.size("_t") >= 7).select(
        *keep,
        _token(0, "long").alias("point_id"),
        *[_token(i + 1, "double").alias(n) for i, n in enumerate("xyz")],
        *[_token(i + 4, "int").alias(n) for i, n in enumerate("rgb")],
    )


def read_sparse_text(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three tables under ``<capture>/<model>/`` folders matching ``path``."""

    def lines(name: str) -> DataFrame:
        text = spark.read.text(f"{path}/{name}.txt")
        folder = F.col("_metadata.file_path")
        return text.select(
            F.regexp_extract(folder, r"([^/]+)/[^/]+/[^/]+$", 1).alias("capture_id"),
            F.regexp_extract(folder, r"([^/]+)/[^/]+$", 1).alias("model_id"),
            F.col("value").alias("line"),
        )

    return {
        "cameras": parse_cameras(lines("cameras")),
        "images": parse_images(lines("images")),
        "points": parse_points(lines("points3D")),
    }


def intrinsics(cameras: DataFrame) -> DataFrame:
    """Flat focal lengths, principal point and distortion of every camera model."""
    p = F.col("params")

    def param(name: str) -> Column:
        return F.try_element_at(p, F.lit(name))

    return cameras.select(
        *[c for c in cameras.columns if c != "params"],
        F.coalesce(param("fx"), param("f")).alias("fl_x"),
        F.coalesce(param("fy"), param("f")).alias("fl_y"),
        param("cx").alias("cx"),
        param("cy").alias("cy"),
        _by_model({m: F.lit(n) for m, n in POSED_MODEL.items()}, F.lit("OPENCV")).alias("camera_model"),
        *[F.coalesce(param(k), F.lit(0.0)).alias(k) for k in DISTORTION],
    )


def posed_frames(
    images: DataFrame, cameras: DataFrame, kept: DataFrame | None = None, folder: str = "images", capture: str = "capture_id"
) -> DataFrame:
    """Rows of a posed-frame document: path, 4x4 OpenGL pose, intrinsics.

    ``shared`` marks captures whose frames all use one camera; their intrinsics belong to the
    document, the others' to each frame. ``kept`` restricts the frames to existing file names.
    """
    named = images.withColumn("file_name", F.element_at(F.split("name", "/"), -1))
    if kept is not None:
        named = named.join(kept.select(capture, "file_name").distinct(), [capture, "file_name"], "left_semi")
    used = named.groupBy(capture).agg((F.min("camera_id") == F.max("camera_id")).alias("shared"))
    lens = intrinsics(cameras).drop("model")
    posed = named.join(small(lens), [capture, "camera_id"], "left").join(small(used), capture)
    unit = posed.withColumns(g.named(g.unit_pose(g.vec("qw", "qx", "qy", "qz")), "qw", "qx", "qy", "qz"))
    flat = g.opengl_pose(g.vec("qw", "qx", "qy", "qz"), g.vec("tx", "ty", "tz"))
    matrix = F.array(*[F.array(*flat[r * 4 : r * 4 + 4]) for r in range(4)])
    return unit.select(
        capture,
        "image_id",
        F.concat_ws("/", F.lit(folder), F.col("file_name")).alias("file_path"),
        matrix.alias("matrix"),
        "shared",
        "camera_model",
        "fl_x",
        "fl_y",
        "cx",
        "cy",
        F.col("width").alias("w"),
        F.col("height").alias("h"),
        *DISTORTION,
    )


def transforms_documents(frames: DataFrame, capture: str = "capture_id") -> DataFrame:
    """One JSON line per frame, with the intrinsics only where they are not shared."""
    lens = F.struct("camera_model", "fl_x", "fl_y", "cx", "cy", "w", "h", *DISTORTION)
    body = F.struct("file_path", F.col("matrix").alias("transform_matrix"), F.col("image_id").alias("colmap_im_id"))
    own = F.struct("body.*", "lens.*")
    made = frames.withColumn("body", body).withColumn("lens", lens)
    return made.select(
        capture, "image_id", F.when(F.col("shared"), F.to_json("body")).otherwise(F.to_json(own)).alias("frame_json")
    )
