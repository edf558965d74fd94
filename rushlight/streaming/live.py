"""Structured Streaming jobs: stateful detectors, ingest, windowed health."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from rushlight.plans.fold import ordered_fold
from rushlight.streaming import folds
from rushlight.streaming.detectors import DETECTORS

DEFAULT_WATERMARK = "2 seconds"
DEFAULT_IDLE_MS = 600_000
PACK_BYTES = 1 << 20  # about the most that rows waiting in one entry of the state take
ROWS_OUT = 10_000  # captures are put together to about this many rows on the way out
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay_phases(ticks: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """Batch form of the scripted take: every capture walked in time order, one Arrow batch in memory."""
    schema = folds.PHASE_SCHEMA.format(key=dict(ticks.dtypes)["capture_id"])
    return ordered_fold(ticks, "capture_id", ["t_ms", *(ties or [])], folds.phase_start, folds.phase_step, schema)


class OrderedWalk(StatefulProcessor):
    """Walks each capture's rows in time order once the watermark has passed them.

    A group is one capture or a lane of many. State, all typed and bounded: ``waiting`` holds the rows the watermark has
    not reached (a list of packs, each the rows of one arrival as an Arrow record batch, appended to and taken out when
    due), ``kept`` when each capture was last walked to and what the detector carries for it, ``alarm`` the timer that is
    set, when a row was last seen and when silent captures were last looked for. A timer goes off at the earliest waiting
    row; a capture silent for ``idle_ms`` of event time beyond the watermark is forgotten (in a lane that others keep
    busy, within twice that), and begins anew if it comes back.
    """

    def __init__(self, detector, rows: StructType, order: list[str], idle_ms: int, whole: list[str]):
        self.detector, self.idle_ms, self.whole = detector, idle_ms, set(whole)
        self.order = [(c, "ascending") for c in ("capture_key", *order)]
        self.rows = pa.schema([pa.field(f.name, pa.int64()) if f.name in self.whole else f for f in to_arrow_schema(rows)])
        self.fields = [f.split()[0] for f in detector.state.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "low long, rows binary")
        self.kept = handle.getMapState("kept", "capture string", f"walked long, {self.detector.state}")
        self.alarm = handle.getValueState("alarm", "at long, seen long, looked long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, seen, looked = self.alarm.get() or (None, 0, 0)
        first = None
        for batch in rows:
            self.waiting.appendList(self._packs(pa.RecordBatch.from_arrays([self._column(batch, f) for f in self.rows], schema=self.rows)))
            times = batch["event_ms"].to_numpy("int64")
            low, high = int(times.min()), int(times.max())
            first, seen = low if first is None else min(first, low), max(seen, high)
        self._set(at, first, seen, looked)
        return iter(())

    def _column(self, batch: pd.DataFrame, field: pa.Field) -> pa.Array:
        values = batch[field.name].to_numpy()
        if field.name in self.whole:
            return pa.array(values, pa.string(), from_pandas=True).cast(field.type)
        return pa.array(values, field.type, from_pandas=True)

    def _packs(self, batch: pa.RecordBatch) -> list[tuple[int, bytes]]:
        """The rows as entries of the state; large rows are parted, so no entry is much above ``PACK_BYTES`` or one row."""
        size = max(1, batch.num_rows * PACK_BYTES // max(batch.nbytes, PACK_BYTES))
        parts = [batch.slice(start, size) for start in range(0, batch.num_rows, size)]
        return [(int(p.column("event_ms").to_numpy().min()), p.serialize().to_pybytes()) for p in parts]

    def _set(self, at: int | None, wanted: int, seen: int, looked: int) -> None:
        if at is None or wanted < at:
            if at is not None:
                self.handle.deleteTimer(at)
            self.handle.registerTimer(wanted)
            at = wanted
        self.alarm.update((at, seen, looked))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        _, seen, looked = self.alarm.get()
        packs = list(self.waiting.get())
        if not packs:
            for state in (self.waiting, self.kept, self.alarm):
                state.clear()
            return
        reached = self._table([p for p in packs if p[0] <= mark])
        due = reached.column("event_ms").to_numpy() <= mark
        later = [(low, rows) for low, rows in packs if low > mark]
        if not due.all():
            for part in reached.filter(pa.array(~due)).combine_chunks().to_batches():
                later += self._packs(part)
            reached = reached.filter(pa.array(due))
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        before = {k[0]: value for k, value in self.kept.iterator()}
        if mark - looked >= self.idle_ms:
            here = {name for part in (reached, *(self._table([p]) for p in later)) for name in part.column("capture_key").unique().to_pylist()}
            for name in [n for n, value in before.items() if value[0] <= mark - self.idle_ms and n not in here]:
                self.kept.removeKey((name,))
            looked = mark
        self._set(None, min(low for low, _ in later) if later else max(seen, mark) + self.idle_ms, seen, looked)
        made, names = [], []
        for name, last, rows in self._captures(reached):
            state = dict(zip(self.fields, before[name][1:])) if name in before else self.detector.start()
            out = self.detector.advance(state, rows)
            self.kept.updateValue((name,), (last, *(state[f] for f in self.fields)))
            if len(out):
                made.append(out)
                names += [name] * len(out)
            if len(names) >= ROWS_OUT:
                yield self._named(made, names)
                made, names = [], []
        if made:
            yield self._named(made, names)

    def _table(self, packs: list[tuple[int, bytes]]) -> pa.Table:
        return pa.Table.from_batches([pa.ipc.read_record_batch(rows, self.rows) for _, rows in packs], self.rows)

    def _captures(self, reached: pa.Table) -> Iterator[tuple[str, int, pd.DataFrame]]:
        """Name, time of the last row and rows of each capture, in time order."""
        if not reached.num_rows:
            return
        ready = reached.sort_by(self.order)
        names, times = ready.column("capture_key").to_numpy(), ready.column("event_ms").to_numpy()
        columns = {}
        for c in ready.column_names:
            values = ready.column(c)
            if c in self.whole and values.null_count:
                columns[c] = values.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            elif c not in ("capture_key", "event_ms"):
                columns[c] = values.to_numpy()
        frame = pd.DataFrame(columns)
        starts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for low, high in zip(starts, starts[1:]):
            yield names[low], int(times[low:high].max()), frame.iloc[low:high]

    def _named(self, made: list[pd.DataFrame], names: list[str]) -> pd.DataFrame:
        whole = pd.concat(made, ignore_index=True) if len(made) > 1 else made[0]
        whole.insert(0, "capture_key", names)
        return whole

    def close(self) -> None:
        pass


def live(
    rows: DataFrame,
    name: str,
    event_time: str,
    ties: list[str] | None = None,
    watermark: str | None = DEFAULT_WATERMARK,
    idle_ms: int = DEFAULT_IDLE_MS,
    lanes: int | None = None,
    **settings,
) -> DataFrame:
    """Streaming form of a detector: as its batch form over all rows, whatever the micro-batches.

    Rows newer than the watermark wait in the state and are walked in time order once it has passed them, so late arrivals
    within it change nothing; older ones are dropped by the engine. ``watermark`` None: the stream has one already.
    Rows without an event time cannot be placed and are left out. Column names must not begin with an underscore (the
    engine renames such columns on their way to Python).
    ``lanes``: captures share this many groups by the hash of their key, so what a group costs the engine (a dozen calls
    to the state store) is not paid for each capture; for many captures of few rows. A lane's due rows are in memory at
    once. None: each capture is a group.
    The engine keeps such state in RocksDB only, which is set here unless the session names a store.
    """
    spark, detector = rows.sparkSession, DETECTORS[name](**settings)
    if "RocksDB" not in spark.conf.get(STATE_STORE, ""):
        spark.conf.set(STATE_STORE, ROCKS)
    timed = rows.withColumn("event_ms", F.unix_millis(event_time))
    timed = timed.withWatermark(event_time, watermark) if watermark else timed
    timed = timed.filter(F.col("event_ms").isNotNull())
    # pandas turns integers beside nulls into doubles; as text they stay whole
    plain = [c for c, kind in timed.dtypes if kind in ("bigint", "int") and c not in ("capture_id", "event_ms")]
    timed = timed.withColumns({c: F.col(c).cast("string") for c in plain})
    # keys that may be null become text, since the engine mixes a null key with its neighbours
    named = F.coalesce(F.concat(F.lit("="), F.col("capture_id").cast("string")), F.lit(""))
    timed = timed.withColumn("capture_key", named).drop("capture_id")
    walk = OrderedWalk(detector, timed.drop(event_time).schema, [detector.time, *(ties or [])], idle_ms, plain)
    grouped = timed.groupBy("capture_key") if lanes is None else timed.withColumn("lane", F.pmod(F.xxhash64("capture_key"), F.lit(lanes))).groupBy("lane")
    made = grouped.transformWithStateInPandas(walk, f"capture_key string, {detector.out}", "append", "eventTime")
    capture = F.when(F.col("capture_key") != "", F.substring("capture_key", 2, 1 << 20)).cast(dict(rows.dtypes)["capture_id"])
    return made.select(capture.alias("capture_id"), *[c for c in made.columns if c != "capture_key"])


def stream_health(samples: DataFrame, event_time: str = "ts", keys: tuple[str, ...] = ("capture_id", "sensor"), window: str = "1 second", watermark: str = DEFAULT_WATERMARK, offset_us: str | None = None) -> DataFrame:
    """Samples, span and rate per tumbling window, on the camera's clock.

    ``offset_us`` names a column of microseconds added to the event time before it is used.
    Works on a stream and on a table; late rows show up in the query's dropped-row metric.
    """
    if offset_us:
        samples = samples.withColumn(event_time, F.timestamp_micros(F.unix_micros(event_time) + F.col(offset_us)))
    timed = samples.withWatermark(event_time, watermark) if samples.isStreaming else samples
    made = timed.groupBy(*keys, F.window(event_time, window).alias("w")).agg(
        F.count(F.lit(1)).alias("samples"), F.min(event_time).alias("first"), F.max(event_time).alias("last")
    )
    span = (F.unix_micros("last") - F.unix_micros("first")) / 1e6
    return made.select(
        *keys, F.col("w.start").alias("window_start"), "samples",
        F.when(span > 0, (F.col("samples") - 1) / span).otherwise(F.lit(0.0)).alias("rate_hz"),
    )


def new_manifests(documents: DataFrame, event_time: str = "ts", watermark: str = "1 day") -> DataFrame:
    """Manifest documents with one row per session; the same session arriving again is dropped.

    A document without a session id is told apart by its capture name.
    """
    session = F.coalesce(F.get_json_object("document", "$.session_id"), F.concat(F.lit("name:"), F.col("capture_id").cast("string")))
    named = documents.withColumn("session_key", session)
    if documents.isStreaming:
        return named.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["session_key"])
    first = named.groupBy("session_key").agg(F.min_by(F.struct(*documents.columns), F.struct(F.col(event_time), F.col("capture_id"))).alias("_r"))
    return first.select("_r.*", "session_key")


def ingest(stream: DataFrame, validate: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, event_time: str = "ts", watermark: str = "1 day"):
    """Append every new capture and its issues once.

    Batches are written under their batch id, replacing what an interrupted attempt left, so a
    restart repeats nothing. A session that any earlier batch has is left out, however long ago
    that was; the watermark only bounds what one run keeps in its state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        try:
            known = session.read.parquet(f"{table}/captures").filter(F.col("batch_id") != batch_id).select("session_key")
        except AnalysisException:  # nothing written yet
            known = None
        if known is not None:
            batch = batch.join(known.distinct(), "session_key", "left_anti").select(*batch.columns)
        batch.write.mode("overwrite").parquet(f"{table}/captures/batch_id={batch_id}")
        saved = batch.sparkSession.read.parquet(f"{table}/captures/batch_id={batch_id}")
        validate(saved).write.mode("overwrite").parquet(f"{table}/issues/batch_id={batch_id}")

    return (
        new_manifests(stream, event_time, watermark)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
