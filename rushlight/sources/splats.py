"""Trained-splat tables: a splittable reader for fixed-stride vertex files, and packed record sinks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from rushlight.functions import encoding as enc
from rushlight.functions import geometry as g
from rushlight.plans.sizing import settle

# Fixed formats: vertex property types and the 32-byte record.
PROPERTY_TYPES = {
    "float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int8": "i1",
    "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4",
}
HEADER_CHUNK = 1 << 16
BYTES_PER_PART = 1 << 26
ROWS_PER_BATCH = 1 << 16
RECORD_BYTES = 32
RECORD = np.dtype([("xyz", "<f4", 3), ("scale", "<f4", 3), ("rgba", "u1", 4), ("quat", "u1", 4)])
SPARK_TYPES = {"f4": "float", "f8": "double", "u1": "int", "i1": "int", "i2": "int", "u2": "int", "i4": "int", "u4": "bigint"}


def _open(location: str):
    system, path = fs.FileSystem.from_uri(location if "://" in location else f"file://{location}")
    return system, path


def read_header(location: str) -> dict:
    """Vertex layout of a binary splat file; refuses text files and plain point clouds."""
    system, path = _open(location)
    head, end, body = b"", -1, 0
    with system.open_input_stream(path) as stream:
        while body <= 0 and (more := stream.read(HEADER_CHUNK)):
            head += more
            if not head.startswith(b"ply"):
                break
            end = head.find(b"end_header", max(0, end))
            body = head.find(b"\n", end) + 1 if end >= 0 else 0
    if body <= 0:
        raise ValueError(f"{location} is not a splat vertex file")
    order, count, fields, inside = None, 0, [], False
    for line in head[:end].decode("ascii").splitlines():
        words = line.split()
        if words[:1] == ["format"]:
            order = {"binary_little_endian": "<", "binary_big_endian": ">"}.get(words[1])
        elif words[:1] == ["element"]:
            inside = words[1] == "vertex"
            count = int(words[2]) if inside else count
        elif words[:1] == ["property"] and inside:
            fields.append((words[2], PROPERTY_TYPES[words[1]]))
    if order is None:
        raise ValueError(f"{location} is not binary; convert it first")
    names = {n for n, _ in fields}
    if not {"x", "y", "z"} <= names:
        raise ValueError(f"{location} has no positions")
    if not {"opacity", "scale_0"} <= names:
        raise ValueError(f"{location} is a plain point cloud, not a splat")
    dtype = np.dtype([(n, (order + t) if t[1] != "1" else t) for n, t in fields])
    return {"fields": fields, "dtype": dtype, "count": count, "offset": body}


class ByteRange(InputPartition):
    def __init__(self, location: str, start: int, stop: int, first_row: int = 0):
        self.location, self.start, self.stop, self.first_row = location, start, stop, first_row


def byte_ranges(files: list[tuple[str, int]], step: int) -> list[ByteRange]:
    return [ByteRange(name, at, min(at + step, size)) for name, size in files for at in range(0, size, step)]


class SplatReader(DataSourceReader):
    """Byte ranges of the files: the driver lists names and sizes, a task reads its file's header and the rows that begin
    in its range. A column that a file lacks is null there."""

    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.options = options

    def partitions(self):
        return byte_ranges(splat_files(self.options["path"]), int(self.options.get("bytesPerPartition", BYTES_PER_PART)))

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        head = read_header(part.location)
        dtype, scene = head["dtype"], part.location.rstrip("/").split("/")[-1].rsplit(".", 1)[0]
        bands = sum(n.startswith("f_rest_") for n, _ in head["fields"])
        first = max(0, -(-(part.start - head["offset"]) // dtype.itemsize))
        stop = min(head["count"], max(0, -(-(part.stop - head["offset"]) // dtype.itemsize)))
        fixed = {"scene_id": lambda at, n: pa.array([scene] * n, pa.string()), "gid": lambda at, n: pa.array(np.arange(at, at + n)),
                 "sh_bands": lambda at, n: pa.array(np.full(n, bands, np.int32))}
        kinds = {"double": pa.float64(), "float": pa.float32(), "long": pa.int64(), "integer": pa.int32()}
        system, path = _open(part.location)
        with system.open_input_file(path) as file:
            for start in range(first, stop, ROWS_PER_BATCH):
                rows = min(ROWS_PER_BATCH, stop - start)
                file.seek(head["offset"] + start * dtype.itemsize)
                raw = np.frombuffer(file.read(rows * dtype.itemsize), dtype=dtype)
                columns = []
                for field in self.schema.fields:
                    if field.name in fixed:
                        columns.append(fixed[field.name](start, rows))
                        continue
                    kind = kinds[field.dataType.typeName()]
                    if field.name not in dtype.names:
                        columns.append(pa.nulls(rows, kind))
                        continue
                    native = raw[field.name].astype(raw[field.name].dtype.newbyteorder("="))
                    columns.append(pa.array(native).cast(kind))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in self.schema.fields])


def splat_files(path: str, ending: str = ".ply") -> list[tuple[str, int]]:
    """Names and sizes of the files, in order of their names; no file is opened."""
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(ending))


#: Narrowest to widest, for layouts that differ in a property's type.
WIDTHS = ("int", "bigint", "float", "double")


def _ddl(fields: list[tuple[str, str]], asked: list[str]) -> str:
    chosen = [(n, t) for n, t in fields if (n in asked if asked else not n.startswith("f_rest_"))]
    return "scene_id string, gid bigint, sh_bands int, " + ", ".join(f"`{n}` {t}" for n, t in chosen)


class SplatSource(DataSource):
    """``spark.read.format("splat")``: options ``path`` and optionally ``columns``, ``bytesPerPartition``.

    ``columns`` limits what is turned into rows; the spherical-harmonic rest is only counted
    unless it is asked for. Without a schema the first file gives it; ``read_splat_table`` reconciles all.
    """

    @classmethod
    def name(cls) -> str:
        return "splat"

    def schema(self) -> str:
        head = read_header(splat_files(self.options["path"])[0][0])
        asked = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return _ddl([(n, SPARK_TYPES[t]) for n, t in head["fields"]], asked)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SplatReader(schema, self.options)


def header_catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, headers read in tasks: ``location, size, count, stride, fields, issue``.

    A file that cannot be read as splats has its reason in ``issue`` and nothing else.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for location, size in zip(batch["location"], batch["size"], strict=True):
                try:
                    head = read_header(location)
                    fields = [{"name": n, "type": SPARK_TYPES[t]} for n, t in head["fields"]]
                    out.append((location, size, head["count"], head["dtype"].itemsize, fields, None))
                except (ValueError, KeyError, IndexError, UnicodeDecodeError) as problem:
                    out.append((location, size, None, None, None, str(problem)))
            yield pd.DataFrame(out, columns=["location", "size", "count", "stride", "fields", "issue"]).astype({"count": "Int64", "stride": "Int64"})

    files = spark.createDataFrame(splat_files(path), "location string, size bigint")
    schema = "location string, size bigint, count bigint, stride bigint, fields array<struct<name:string,type:string>>, issue string"
    return files.repartition(spark.sparkContext.defaultParallelism * 4).mapInPandas(walk, schema)


def read_splat_table(spark: SparkSession, path: str, columns: list[str] | None = None, bytes_per_partition: int = BYTES_PER_PART) -> DataFrame:
    """Rows of all splat files under ``path``, whatever their layouts: a property has the widest type that any file gives
    it, and is null where a file lacks it. Files without splats are an error that names one of them."""
    catalog = settle(header_catalog(spark, path))
    wrong = catalog.filter("issue is not null").agg(F.min("issue"), F.count(F.lit(1))).first()
    if wrong[1]:
        raise ValueError(f"{wrong[1]} files cannot be read, among them: {wrong[0]}")
    each = catalog.select(F.posexplode("fields").alias("place", "f"))
    width = F.array_position(F.array(*[F.lit(w) for w in WIDTHS]), F.col("f.type"))
    # one row per property name
    layout = each.groupBy("f.name").agg(F.min("place").alias("place"), F.max(width).alias("width")).orderBy("place", "name").collect()
    spark.dataSource.register(SplatSource)
    ddl = _ddl([(r["name"], WIDTHS[r["width"] - 1]) for r in layout], columns or [])
    return spark.read.format("splat").schema(ddl).option("path", path).option("bytesPerPartition", bytes_per_partition).load()


def splat_records(splats: DataFrame) -> DataFrame:
    """The codes of the 32-byte record: positions and scales as they are, bytes truncated."""
    q = enc.snorm8(g.vec("qw", "qx", "qy", "qz"))
    alpha = enc.clip(F.col("opacity") * 255, 0.0, 255.0).cast("int")
    keep = [c for c in splats.columns if c in ("scene_id", "gid", "position")]
    return splats.select(
        *keep, "x", "y", "z", "sx", "sy", "sz", "r", "g", "b", alpha.alias("a"),
        *[c.alias(n) for c, n in zip(q, ("b0", "b1", "b2", "b3"), strict=True)],
    )


def _packed(batch: pa.RecordBatch) -> np.ndarray:
    out = np.zeros(len(batch), dtype=RECORD)
    for name, fields in (("xyz", "x y z"), ("scale", "sx sy sz"), ("rgba", "r g b a"), ("quat", "b0 b1 b2 b3")):
        for i, field in enumerate(fields.split()):
            out[name][:, i] = batch[field].to_numpy(zero_copy_only=False)
    return out


def pack_records(ordered: DataFrame, order: list[str]) -> DataFrame:
    """32-byte records in global order: ``part`` is the output partition, ``body`` its bytes.

    Rows are range-partitioned by ``order``, so the parts concatenate in order.
    """
    codes = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    codes = codes.withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(b for b in batches if len(b)):
            made = {"part": batch["part"].slice(0, 1), "batch": pa.array([number], pa.int32()), "rows": pa.array([len(batch)], pa.int32())}
            yield pa.record_batch(made | {"body": pa.array([_packed(batch).tobytes()], pa.binary())})

    return codes.mapInArrow(pack, "part int, batch int, rows int, body binary")


RECORD_FIELDS = ", ".join(
    ["position bigint", *(f"{n} float" for n in ("x", "y", "z", "sx", "sy", "sz")), *(f"{n} int" for n in "rgba"), *(f"{n} double" for n in ("qw", "qx", "qy", "qz"))]
)


@dataclass
class Written(WriterCommitMessage):
    draft: str
    part: int
    rows: int


class RecordWriter(DataSourceArrowWriter):
    """Tasks write drafts in a folder of this job; ``commit`` moves those of the attempts that count into place.

    A task that dies or runs twice leaves a draft at most, which goes with the drafts' folder, at the end of the job
    whichever way it ends. Nothing is ever seen half written.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        system, inner = _open(self.path)
        drafts = f"{inner}/_drafts-{self.job}"
        system.create_dir(drafts, recursive=True)
        draft, rows = f"{drafts}/{task.partitionId():06d}-{task.taskAttemptId()}", 0
        with system.open_output_stream(draft) as stream:
            for batch in iterator:
                stream.write(_packed(batch).tobytes())
                rows += len(batch)
        return Written(draft, task.partitionId(), rows)

    def _parts(self) -> list[str]:
        return [name for name, _ in splat_files(self.path, ".splat")]

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, inner = _open(self.path)
        old = self._parts() if system.get_file_info(inner).type == fs.FileType.Directory else []
        first = 0
        if self.overwrite:
            for name in old:
                system.delete_file(_open(name)[1])
        elif old:
            first = 1 + max(int(name.rsplit("-", 1)[1].split(".")[0]) for name in old)
        for message in messages:
            if message is not None and message.rows:
                system.move(message.draft, f"{inner}/part-{first + message.part:06d}.splat")
        self._sweep()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        system, inner = _open(self.path)
        drafts = f"{inner}/_drafts-{self.job}"
        if system.get_file_info(drafts).type == fs.FileType.Directory:
            system.delete_dir(drafts)


class RecordReader(DataSourceReader):
    """Byte ranges cut at record borders; a row's place in the whole follows from the sizes of the files before."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        step = max(1, int(self.options.get("bytesPerPartition", BYTES_PER_PART)) // RECORD_BYTES) * RECORD_BYTES
        parts, before = [], 0
        for name, size in splat_files(self.options["path"], ".splat"):
            parts += [ByteRange(name, at, min(at + step, size), (before + at) // RECORD_BYTES) for at in range(0, size, step)]
            before += size
        return parts

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        system, path = _open(part.location)
        with system.open_input_file(path) as file:
            for at in range(part.start, part.stop, ROWS_PER_BATCH * RECORD_BYTES):
                file.seek(at)
                raw = np.frombuffer(file.read(min(ROWS_PER_BATCH * RECORD_BYTES, part.stop - at)), RECORD)
                first = part.first_row + (at - part.start) // RECORD_BYTES
                made = {"position": np.arange(first, first + len(raw))}
                made |= {n: raw["xyz"][:, i] for i, n in enumerate(("x", "y", "z"))}
                made |= {n: raw["scale"][:, i] for i, n in enumerate(("sx", "sy", "sz"))}
                made |= {n: raw["rgba"][:, i].astype(np.int32) for i, n in enumerate("rgba")}
                made |= {n: (raw["quat"][:, i].astype(np.float64) - 128) / 128 for i, n in enumerate(("qw", "qx", "qy", "qz"))}
                yield pa.record_batch({n: pa.array(np.ascontiguousarray(v)) for n, v in made.items()})


class RecordSource(DataSource):
    """``format("splatrecords")``: folders of 32-byte records, written in the order of the rows and read in byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "splatrecords"

    def schema(self) -> str:
        return RECORD_FIELDS

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RecordWriter(self.options["path"], overwrite)


def write_splat_rows(ordered: DataFrame, order: list[str], folder: str, mode: str = "overwrite") -> None:
    """Write ``splat_records`` rows as files of records that concatenate in ``order``."""
    ordered.sparkSession.dataSource.register(RecordSource)
    codes = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    codes.write.format("splatrecords").mode(mode).option("path", folder).save()


def read_splat_rows(spark: SparkSession, folder: str, bytes_per_partition: int = BYTES_PER_PART) -> DataFrame:
    """Records back as columns, with their place in the whole."""
    spark.dataSource.register(RecordSource)
    return spark.read.format("splatrecords").option("path", folder).option("bytesPerPartition", bytes_per_partition).load()


def capped(ordered: DataFrame, maximum: int, position: str = "position") -> DataFrame:
    """The first ``maximum`` rows in importance order: an export option, off unless asked for."""
    return ordered.filter(F.col(position) < maximum)
