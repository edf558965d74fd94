"""File inventories against manifests, and rule sets that report rows instead of raising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushlight.operators.joins import PHASE_ORDER, phase_rank
from rushlight.plans.timeline import Timeline

MANIFEST_LINE = r"^([0-9a-fA-F]{64})\s+(\S.*)$"  # Fixed format: digest, blanks, path.
FIXED_CAMERA = "fixed_camera_4d"  # Fixed value: the capture type that needs a hold phase.


def issue(level: str, code: str, test: Column, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(test, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), text.alias("message")))


def issue_rows(df: DataFrame, keep: list[str], issues: list[Column]) -> DataFrame:
    """One row per rule that fires; all rules run in a single projection."""
    return df.select(*keep, F.explode(F.array_compact(F.array(*issues))).alias("_i")).select(*keep, "_i.*")


def parse_manifest_lines(lines: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Manifest text to ``path, digest``; lines that do not parse keep a NULL digest."""
    text = F.trim("line")
    return lines.filter(text != "").select(
        capture,
        "line",
        F.when(text.rlike(MANIFEST_LINE), F.lower(F.regexp_extract(text, MANIFEST_LINE, 1))).alias("digest"),
        F.when(text.rlike(MANIFEST_LINE), F.regexp_extract(text, MANIFEST_LINE, 2)).alias("path"),
    )


def reconcile(
    lines: DataFrame, files: DataFrame, complete_only: bool = False, capture: str = "capture_id"
) -> DataFrame:
    """Issues between a checksum manifest and the files present.

    ``complete_only`` leaves digests out of the plan, so they are never computed.
    """
    parsed = parse_manifest_lines(lines, capture)
    bad = parsed.filter(F.col("digest").isNull()).select(
        capture, F.lit("warning").alias("level"), F.lit("unparseable_line").alias("code"),
        F.col("line").alias("path"),  # the whole line
    )
    listed = parsed.filter(F.col("digest").isNotNull()).groupBy(capture, "path").agg(
        F.max("digest").alias("digest")
    )
    present = files.select(capture, "path", F.lit(True).alias("present"), *([] if complete_only else ["sha256"]))
    both = listed.join(present, [capture, "path"], "full_outer")
    code = F.when(F.col("present").isNull(), "missing_file").when(F.col("digest").isNull(), "unlisted_file")
    if not complete_only:
        code = code.when(F.col("sha256") != F.col("digest"), "checksum_mismatch")
    found = both.withColumn("code", code).filter(F.col("code").isNotNull())
    return found.select(capture, F.lit("error").alias("level"), "code", "path").unionByName(bad)


def payload_oxum(lines: DataFrame, files: DataFrame, capture: str = "capture_id") -> DataFrame:
    """``bytes.count`` per capture: bytes of the listed files that exist, count of all files."""
    listed = parse_manifest_lines(lines, capture).filter(F.col("digest").isNotNull()).select(capture, "path").distinct()
    marked = files.select(capture, "path", "length").join(
        listed.withColumn("listed", F.lit(True)), [capture, "path"], "left"
    )
    return marked.groupBy(capture).agg(
        F.concat_ws(
            ".",
            F.coalesce(F.sum(F.when(F.col("listed"), F.col("length"))), F.lit(0)).cast("string"),
            F.count(F.lit(1)).cast("string"),
        ).alias("oxum")
    )


def missing_and_extra(listed: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Keys listed but absent, and present but unlisted."""
    left, right = listed.select(*keys).distinct(), present.select(*keys).distinct()
    return (
        left.withColumn("_l", F.lit(1))
        .join(right.withColumn("_r", F.lit(1)), keys, "full_outer")
        .filter(F.col("_l").isNull() | F.col("_r").isNull())
        .select(*keys, F.when(F.col("_r").isNull(), "missing").otherwise("extra").alias("side"))
    )


def overlapping_phases(phases: DataFrame, captures: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Issues in declared phases and rest windows.

    ``phases``: capture, name, start_frame, end_frame. ``captures``: capture, capture_type,
    rest_start, rest_end.
    """
    c = F.col
    ranked = phases.withColumn("_rank", phase_rank(c("name")))
    known = ranked.filter(c("_rank").isNotNull())
    line = Timeline.measure(known, [capture], "_rank", ["start_frame"])
    stepped = line.rolling(
        known,
        1,
        0,
        lambda ordered, _: {"_before": F.lag("end_frame").over(ordered), "_name_before": F.lag("name").over(ordered)},
    )
    row_rules = [
        issue("error", "reversed", c("end_frame") < c("start_frame"), "phase ends before it starts"),
        issue("error", "negative", c("start_frame") < 0, "frame numbers are never negative"),
        issue("error", "duplicate", c("_name_before") == c("name"), "phase declared twice"),
        issue(
            "error",
            "overlap",
            (c("start_frame") <= c("_before")) & (c("_name_before") != c("name")),
            F.concat_ws(" ", c("_name_before"), F.lit("and"), c("name"), F.lit("share a frame")),
        ),
    ]
    unknown = issue_rows(
        ranked.filter(c("_rank").isNull()), [capture, "name"], [issue("error", "unknown", F.lit(True), "unknown phase")]
    )
    by_row = issue_rows(stepped, [capture, "name"], row_rules)

    def covers(name: str) -> Column:
        hit = (c("rest_start") >= c("start_frame")) & (c("rest_start") <= c("end_frame")) & (c("name") == name)
        return F.coalesce(F.max(hit), F.lit(False))

    joined = captures.join(known, capture, "left")
    whole = joined.groupBy(capture, "capture_type", "rest_start", "rest_end").agg(
        *[F.coalesce(F.max(c("name") == n), F.lit(False)).alias(f"has_{n}") for n in PHASE_ORDER],
        *[covers(n).alias(f"in_{n}") for n in PHASE_ORDER],
    )
    capture_rules = [
        issue("error", "no_hold", (c("capture_type") == FIXED_CAMERA) & ~c("has_hold"), "hold phase is mandatory"),
        issue("error", "rest_reversed", c("rest_end") < c("rest_start"), "rest window runs backwards"),
        issue(
            "error",
            "rest_outside",
            (c("in_perch") | c("in_arc")) & ~(c("in_reseat") | c("in_hold")),
            "rest window must start in reseat or hold",
        ),
        issue("warning", "type", (c("capture_type") != FIXED_CAMERA) & c("has_hold"), "hold in another capture type"),
        *[issue("warning", f"no_{n}_declared", ~c(f"has_{n}"), f"no {n} phase declared") for n in PHASE_ORDER],
    ]
    by_capture = issue_rows(whole, [capture], capture_rules).withColumn("name", F.lit(None).cast("string"))
    return by_row.unionByName(unknown).unionByName(by_capture)


# Optional metadata files of a pack.
OPTIONAL_METADATA = ("intrinsics", "poses", "imu", "light")


def validate_manifest(packs: DataFrame, files: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Pack issues. ``packs``: capture, main_file, one path column per optional metadata file,
    exposure_locked, white_balance_locked. ``files``: capture, path."""
    c = F.col
    named = packs.select(
        capture,
        F.explode(
            F.array_compact(
                F.array(
                    *[
                        F.when(c(n).isNotNull(), F.struct(F.lit(n).alias("label"), c(n).alias("path")))
                        for n in ("main_file", *OPTIONAL_METADATA)
                    ]
                )
            )
        ).alias("_f"),
    ).select(capture, "_f.*")
    found = (
        named.join(files.select(capture, "path").distinct(), [capture, "path"], "left_semi")
        .groupBy(capture)
        .agg(F.collect_set("label").alias("_found"))
    )
    checked = packs.join(found, capture, "left").withColumn("_found", F.coalesce("_found", F.array()))

    def absent(label: str) -> Column:
        return ~F.array_contains("_found", label)

    def unlocked(flag: str) -> Column:
        return ~F.coalesce(c(flag), F.lit(False))

    rules = [issue("error", "main_file", absent("main_file"), "main video not found")]
    rules += [issue("warning", n, absent(n), f"{n} file not found") for n in OPTIONAL_METADATA]
    rules += [
        issue("warning", "exposure", unlocked("exposure_locked"), "exposure not known to be locked"),
        issue("warning", "white_balance", unlocked("white_balance_locked"), "white balance not known to be locked"),
    ]
    return issue_rows(checked, [capture], rules)


def validate_transforms(
    frames: DataFrame, images: DataFrame | None = None, capture: str = "capture_id", captures: DataFrame | None = None
) -> DataFrame:
    """Issues in posed frames: ``capture, frame, file_path, matrix array<array<double>>, fl_x,
    has_top_level_intrinsics``. With ``captures``, those without any frame are reported too."""
    c = F.col
    shaped = c("matrix").isNotNull() & (F.size("matrix") == 4) & F.forall("matrix", lambda r: F.size(r) == 4)
    bottom = F.element_at("matrix", 4) == F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    rules = [
        issue("error", "no_path", c("file_path").isNull(), "no path"),
        issue("error", "no_matrix", ~F.coalesce(shaped, F.lit(False)), "matrix is not 4 by 4"),
        issue("warning", "bottom_row", shaped & ~bottom, "last matrix row is not 0 0 0 1"),
        issue("error", "no_intrinsics", ~c("has_top_level_intrinsics") & c("fl_x").isNull(), "no focal length, neither of the frame nor of the capture"),
    ]
    found = issue_rows(frames, [capture, "frame"], rules)
    if captures is not None:
        bare = captures.select(capture).distinct().join(frames.select(capture).distinct(), capture, "left_anti")
        found = found.unionByName(
            bare.select(
                capture,
                F.lit(None).cast(frames.schema["frame"].dataType).alias("frame"),
                F.lit("error").alias("level"),
                F.lit("no_frames").alias("code"),
                F.lit("no frames").alias("message"),
            )
        )
    if images is not None:
        lost = frames.filter(c("file_path").isNotNull()).join(
            images.select(capture, "file_path").distinct(), [capture, "file_path"], "left_anti"
        )
        gone = lost.groupBy(capture).agg(
            F.count(F.lit(1)).alias("_n"), F.min_by("file_path", "frame").alias("_first")
        )
        found = found.unionByName(
            gone.select(
                capture,
                F.lit(None).cast(frames.schema["frame"].dataType).alias("frame"),
                F.lit("error").alias("level"),
                F.lit("missing_images").alias("code"),
                F.concat(c("_n").cast("string"), F.lit(" images not found; first: "), c("_first")).alias("message"),
            )
        )
    return found


def camera_matches_frames(pairs: DataFrame, capture: str = "capture_id") -> DataFrame:
    """Captures whose declared camera size differs from the frame size, when both are known."""
    c = F.col
    known = (c("camera_width") > 0) & (c("camera_height") > 0) & (c("frame_width") > 0) & (c("frame_height") > 0)
    differs = (c("camera_width") != c("frame_width")) | (c("camera_height") != c("frame_height"))
    return pairs.filter(known & differs)


def orphan_rows(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows whose key does not exist in the parent."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")
