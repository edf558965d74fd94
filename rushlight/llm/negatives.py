"""Hard negatives below each positive's limit: scores cut into disjoint slots, the best of each merged downwards."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rushlight.plans.sizing import settle

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of a positive's score between which negatives lie
ANCHOR_BYTES = 32 << 20  # of anchor vectors that are broadcast at a time; the rest goes in further passes
CELLS = 4_000_000  # scores held at a time
SAFE = 2**53  # below it sums of products are exact as doubles
LONG = 2**63 - 1


class Anchors:
    """One pass's anchors as arrays, with the upper limits of their slots when positives are known."""

    def __init__(self, rows: pa.Table):
        self.nr = rows["nr"].to_numpy()
        self.id = rows["id"].to_numpy()
        self.label = rows["label"].to_pylist()
        sizes = pa.compute.list_value_length(rows["vector"]).to_numpy().astype(np.int64)
        self.wide = int(sizes.max()) if len(sizes) else 0
        self.vector = np.zeros((len(sizes), self.wide))
        flat = rows["vector"].combine_chunks().flatten().to_numpy()
        self.vector[np.repeat(np.arange(len(sizes)), sizes), _within(sizes)] = flat
        self.most = float(np.abs(self.vector).max()) if self.vector.size else 0.0
        if "uppers" in rows.column_names:
            ends = rows["uppers"].to_pylist()
            self.uppers = np.full((len(ends), max([1, *map(len, ends)])), -LONG, np.int64)
            for i, one in enumerate(ends):
                self.uppers[i, : len(one)] = one
            self.lower = rows["lower"].to_numpy()


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. inside each of some groups."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _scores(anchors: Anchors, vectors: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; beyond doubles in Python's integers, held within 64 bits."""
    wide = min(anchors.wide, vectors.shape[1])
    left, right = anchors.vector[:, :wide], vectors[:, :wide]
    most = float(np.abs(right).max()) if right.size else 0.0
    if wide * anchors.most * most < SAFE:
        return (left @ right.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in left], object) @ np.array([[int(x) for x in row] for row in right], object).T
    return np.clip(exact, -LONG, LONG).astype(np.int64)


def _classes(batch: pa.RecordBatch, keep: int) -> tuple[np.ndarray, list, np.ndarray]:
    """(ids, labels, vectors) of a batch; of rows with one label and vector the ``keep`` smallest ids.

    Such rows score alike against any anchor, so no more of them can be among the first ``keep``.
    """
    ids = batch["id"].to_numpy()
    labels = batch["label"].to_pylist()
    sizes = batch["vector"].value_lengths().to_numpy().astype(np.int64)
    vectors = np.zeros((len(ids), max([1, *sizes])))
    vectors[np.repeat(np.arange(len(ids)), sizes), _within(sizes)] = batch["vector"].flatten().to_numpy()
    codes = {label: i for i, label in enumerate(dict.fromkeys(labels))}
    whole = np.column_stack([np.array([codes[x] for x in labels], float), vectors]) + 0.0
    _, kind = np.unique(whole.view(f"V{whole.itemsize * whole.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, kind))
    again = np.r_[False, (kind[order][1:] == kind[order][:-1]) & (ids[order][1:] == ids[order][:-1])]  # rows repeated whole
    order = order[~again]
    first = np.r_[True, kind[order][1:] != kind[order][:-1]]
    sizes = np.diff(np.r_[np.flatnonzero(first), len(order)])
    order = np.sort(order[_within(sizes) < keep])
    return ids[order], [labels[i] for i in order], vectors[order]


class Best:
    """The first ``k`` (score, id) of every (anchor, slot) so far: higher scores first, then smaller ids, each pair once."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(keys, -LONG - 1, np.int64)  # score of the k-th, where there are k

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least[key]
        key, score, ids = (np.concatenate([a, b[good]]) for a, b in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        once = np.r_[True, (key[1:] != key[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])] if len(key) else np.zeros(0, bool)
        key, score, ids = key[once], score[once], ids[once]
        sizes = np.bincount(key, minlength=len(self.least))
        place = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = place == self.k - 1
        self.least[key[last]] = score[last]
        stay = place < self.k
        self.key, self.score, self.id = key[stay], score[stay], ids[stay]


def _top(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Narrow ``allowed`` to the entries no lower than each row's k-th."""
    if scores.shape[1] > 4 * k:
        held = np.where(allowed, scores, -LONG - 1)
        edge = -np.partition(-held.astype(np.float64), k - 1, axis=1)[:, k - 1]
        # rounded to doubles; an edge a little lower only lets more through
        return allowed & (scores >= np.nextafter(edge, -np.inf)[:, None])
    return allowed


def _combined(sent, slots: int, k: int, same: bool):
    """(nr, slot, score, id): per task the first ``k`` of every anchor and slot.

    With ``same`` the rows of the anchor's label but itself, in one slot; otherwise those of other labels, in the slot
    whose upper limit is the next at or above their score, down to the anchor's lowest limit.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = sent.value
        best = Best(len(anchors.nr) * slots, k)
        own = np.array(anchors.label, object)
        for batch in batches:
            if not len(batch):
                continue
            ids, labels, vectors = _classes(batch, k + 1)
            labels = np.array(labels, object)
            step = max(1, CELLS // max(1, len(anchors.nr)))
            for low in range(0, len(ids), step):
                part = slice(low, low + step)
                scores = _scores(anchors, vectors[part])
                alike = own[:, None] == labels[None, part]
                if same:
                    allowed = _top(scores, alike & (anchors.id[:, None] != ids[None, part]), k)
                    row, column = np.nonzero(allowed)
                    best.add(row, scores[row, column], ids[part][column])
                    continue
                usable = ~alike & (scores >= anchors.lower[:, None])
                for slot in range(slots):
                    allowed = usable & (scores <= anchors.uppers[:, slot, None])
                    if slot + 1 < slots:
                        allowed &= scores > anchors.uppers[:, slot + 1, None]
                    row, column = np.nonzero(_top(scores, allowed, k))
                    best.add(row * slots + slot, scores[row, column], ids[part][column])
        yield pa.record_batch(
            {
                "nr": pa.array(anchors.nr[best.key // slots]),
                "slot": pa.array((best.key % slots).astype(np.int32)),
                "score": pa.array(best.score),
                "id": pa.array(best.id),
            }
        )

    return walk


def mine_hard_negatives(
    df: DataFrame,
    anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = 256,
    anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``anchor`` marks.

    A component x counts as floor(``scale`` * x), a score is the integer inner product of two rows; higher scores come
    first, ties by smaller key. An anchor's positives are the first ``positives`` other rows of its label. For each, the
    first ``negatives`` rows of other labels are returned whose score is from ``low`` to ``high`` per cent of its own.

    1. Positives: every task keeps each anchor's first ones; those meet in one more selection.
    2. The positives' upper limits cut the scores into disjoint slots. Tasks keep the first ``negatives`` of each slot;
       those meet in one more selection per slot.
    3. From the lowest slot up, each slot's rows before those below it are the first ones under its upper limit
       (a merge of suffixes, since slots are disjoint and ordered). That answers all overlapping windows; lower limits cut
       the end off.

    Anchors go over the table in passes of ``anchor_bytes`` of vectors, the only thing that is broadcast. Rows of one label
    and vector score alike, so each batch keeps no more of them than can be returned. Rows with a null key, label
    or vector, or a null or non-finite component, take no part. Vectors of different lengths are compared
    over the shorter one. Rows repeated whole count once; rows of one key are not each other's positives. Scores beyond 64
    bits are held at the largest. Positives without a negative have no rows. Other columns are ignored. An empty table gives an
    empty result.
    """
    spark = df.sparkSession
    x = F.col(f"`{vector}`")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")))
    scaled = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("double"))
    if scale <= 0:
        raise ValueError("scale must be positive")
    rows = df.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & x.isNotNull() & sound)
    rows = rows.select(
        F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), scaled.alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("asks"),
    )
    asked = rows.filter("asks").select("id", "label", "vector").distinct()
    # spread over passes by hash: every pass holds its share of all anchors
    asked = asked.withColumn("nr", F.xxhash64("id", "label", "vector"))
    asked = settle(asked)
    total = asked.agg(F.sum(F.size("vector") * 8 + 64)).first()[0] or 0
    passes = -(-int(total) // anchor_bytes)
    pool = rows.select("id", "label", "vector")
    schema = "nr bigint, slot int, score bigint, id bigint"

    def over_all(table: DataFrame, slots: int, k: int, same: bool) -> DataFrame:
        """First ``k`` of every anchor of ``table`` and slot over all rows."""
        found = []
        for turn in range(passes):
            part = table.filter(F.pmod("nr", F.lit(passes)) == turn).toArrow()
            if len(part):
                found.append(pool.mapInArrow(_combined(spark.sparkContext.broadcast(Anchors(part)), slots, k, same), schema))
        order = Window.partitionBy("nr", "slot").orderBy(F.desc("score"), "id")
        met = reduce(DataFrame.union, found).distinct()
        return met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)

    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not passes:
        return spark.createDataFrame([], result)
    chosen = settle(over_all(asked, 1, positives, True))
    # n * 100 <= high * p is n <= floor(high * p / 100); the least n is the ceiling
    upper = F.floor(F.lit(high) * F.col("score").cast("decimal(38,0)") / 100)
    lower = F.ceil(F.lit(low) * F.col("score").cast("decimal(38,0)") / 100)
    limits = chosen.select("nr", "place", "score", "id", upper.cast("bigint").alias("upper"), lower.cast("bigint").alias("lower"))
    limits = limits.filter("lower <= upper")
    per_anchor = limits.groupBy("nr").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "upper"))), lambda e: e["upper"]).alias("uppers"),
        F.min("lower").alias("lower"),
    )
    limited = settle(asked.join(per_anchor, "nr"))
    if limited.isEmpty():
        return spark.createDataFrame([], result)
    slotted = over_all(limited, positives, negatives, False)
    held = slotted.groupBy("nr").agg(F.array_sort(F.collect_list(F.struct("slot", "place", "score", "id"))).alias("held"))
    # acc[0] is what lies under the upper limit last reached, going up from the lowest slot
    none = F.array().cast("array<array<struct<slot:int,place:int,score:bigint,id:bigint>>>")

    def merged(acc: Column, slot: Column) -> Column:
        mine = F.filter("held", lambda h: h["slot"] == slot)
        below = F.when(F.size(acc) > 0, F.element_at(acc, 1)).otherwise(F.array().cast("array<struct<slot:int,place:int,score:bigint,id:bigint>>"))
        return F.concat(F.array(F.slice(F.concat(mine, below), 1, negatives)), acc)

    suffixes = F.aggregate(F.reverse(F.sequence(F.lit(0), F.lit(positives - 1))), none, merged)
    answers = held.select("nr", suffixes.alias("under"))
    slot_of = limits.withColumn("slot", F.row_number().over(Window.partitionBy("nr").orderBy("place")))
    joined = slot_of.join(answers, "nr").join(asked.select("nr", F.col("id").alias("anchor_id")), "nr")
    fit = F.filter(F.element_at("under", F.col("slot")), lambda h: h["score"] >= F.col("lower"))
    return joined.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(fit)).select(
        "anchor_id",
        "positive_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("col.id").alias("negative_id"),
        "positive_score",
        F.col("col.score").alias("negative_score"),
    )
