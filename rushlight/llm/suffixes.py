"""Passages that repeat across documents, by prefix-partitioned suffix trees over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rushlight.plans.sizing import settle

WINDOW = 50  # words of a passage
GRAM = 8  # words hashed to choose where suffixes start
PIECE = 1 << 20  # bytes of text a task works on at a time; a longer text is worked on by itself
CODED = 50_000  # words coded at a time
GROUP = 20_000  # distinct stretches of a group whose tree is built in memory; larger groups take longer prefixes
SHORT = 9  # words of the shortest prefix
LAST = 2**63 - 1  # stands for a null id: after all others

_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MUL1
        x = (x ^ (x >> np.uint64(27))) * _MUL2
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts, one after the other: codes, bytes they take, and how many each text has."""

    body: np.ndarray
    start: np.ndarray
    end: np.ndarray
    codes: np.ndarray
    counts: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """Words of an Arrow array of texts, found and coded a whole array at a time. Null counts as empty."""
    data = pa.array(texts, pa.large_binary()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_binary())
    data = data.fill_null(b"")
    offsets = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8)
    raw = data.buffers()[2]
    body = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    ink = _INK[body]
    edge = np.zeros(len(body) + 1, bool)  # a word begins or a text does
    edge[offsets] = True
    begins = ink.copy()
    begins[1:] &= ~ink[:-1] | edge[1 : len(body)]
    start = np.flatnonzero(begins)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(body, none, none, np.zeros(0, np.uint64), np.zeros(len(data), np.int64))
    stops = ink.copy()
    stops[:-1] &= ~ink[1:] | edge[1 : len(body)]
    end = np.flatnonzero(stops) + 1
    codes = np.empty(len(start), np.uint64)
    length = end - start
    turns = mix64(np.arange(1, int(length.max()) + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    for low in range(0, len(start), CODED):
        part = length[low : low + CODED]
        before = np.cumsum(part) - part
        place = np.arange(int(part.sum())) - np.repeat(before, part)
        with np.errstate(over="ignore"):
            weighed = turns[place] * (body[np.repeat(start[low : low + CODED], part) + place].astype(np.uint64) + np.uint64(1))
            codes[low : low + CODED] = mix64(np.add.reduceat(weighed, before) + part.astype(np.uint64) * _STEP)
    counts = np.diff(np.searchsorted(start, offsets))
    return Words(body, start, end, codes, counts)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to about ``PIECE`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy()
        part = np.cumsum(sizes) // PIECE
        cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(batch)] if len(batch) else []
        for low, high in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(low, high - low)


_INK = np.ones(256, bool)
_INK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def rolled(codes: np.ndarray, span: int, seed: int) -> np.ndarray:
    """Hashes of all runs of ``span`` codes: one multiplier per place, then a finaliser."""
    n = len(codes) - span + 1
    total = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        with np.errstate(over="ignore"):
            turns = mix64(np.arange(1, span + 1, dtype=np.uint64) * _STEP + np.uint64(seed)) | np.uint64(1)
            for i in range(span):
                total += codes[i : i + n] * turns[i]
    return mix64(total)


@dataclass
class Starts:
    """Where suffixes enter the trees; ``first`` to ``last`` are the windows that such a suffix stands for."""

    doc: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray


def suffix_starts(codes: np.ndarray, lengths: np.ndarray, window: int, reach: int) -> Starts:
    """Suffixes of concatenated documents, one for every run of windows that share their lowest gram.

    A window of ``window`` words is stood for by the suffix at the gram of lowest hash among its first ``reach`` places
    (the leftmost of equals). That place depends on the window's words alone, so equal windows of any two documents
    are stood for by suffixes at the same distance from their beginnings, which begin with the same
    ``window - reach + 1`` words. Windows next to each other mostly share their suffix: about 2 of ``reach`` are kept.
    """
    gram = min(GRAM, window - reach + 1)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    doc = np.repeat(np.arange(len(lengths)), np.maximum(lengths - window + 1, 0))
    if not len(doc):
        none = np.zeros(0, np.int64)
        return Starts(none, none, none, none)
    counts = np.maximum(lengths - window + 1, 0)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[doc]
    low = rolled(codes, gram, 11)
    # the hash above, the place below: the lowest key is the leftmost of the lowest hashes
    low = (low & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(low), dtype=np.uint64)
    span = 1
    while 2 * span <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < reach:
        low = np.minimum(low[: len(low) - (reach - span)], low[reach - span :])
    at = (low[place] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return Starts(doc[first], at[first], place[first], place[last])


def _reach(window: int) -> int:
    """How far into a window its suffix may begin: two thirds of it, and no more windows than a mask has bits."""
    return max(1, min(63, 2 * window // 3))


def _stretch_hashes(codes: np.ndarray, starts: Starts, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix key, hash of the stretch) of every suffix.

    A key's upper half comes from the first ``SHORT`` words at the suffix, the whole of it from all words that every
    window of the stretch has there, so a key's upper half is the key of a shorter prefix. The stretch is all words of
    the windows the suffix stands for.
    """
    longest = window - _reach(window) + 1
    short = rolled(codes, min(SHORT, longest), 5)[starts.at]
    whole = rolled(codes, longest, 7)[starts.at]
    key = (short & np.uint64(0xFFFFFFFF00000000)) | (whole >> np.uint64(32))
    length = starts.last - starts.first + window
    total = np.zeros(len(key), np.uint64)
    with np.errstate(over="ignore"):
        turns = mix64(np.arange(1, 2 * window + 64, dtype=np.uint64) * _STEP + np.uint64(13)) | np.uint64(1)
        for i in range(int(length.max()) if len(length) else 0):
            inside = length > i
            if inside.all():
                total += codes[starts.first + i] * turns[i]
            else:
                total[inside] += codes[starts.first[inside] + i] * turns[i]
        total = mix64(total + length.astype(np.uint64) * _STEP)
    return key.view(np.int64), total.view(np.int64)


def _prefix_keys(window: int):
    """(key, doc): the prefix keys of each document's suffixes."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            words = words_of(batch["text"])
            starts = suffix_starts(words.codes, words.counts, window, _reach(window))
            key, _ = _stretch_hashes(words.codes, starts, window)
            pairs = np.unique(np.stack([starts.doc, key], 1), axis=0) if len(key) else np.zeros((0, 2), np.int64)
            doc = batch["doc"].to_numpy()[pairs[:, 0]]
            yield pa.record_batch({"key": pa.array(pairs[:, 1]), "doc": pa.array(doc)})

    return walk


def _suffixes(window: int):
    """(key, stretch, doc, row, place): every suffix; place packs the first window and how many there are."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            words = words_of(batch["text"])
            starts = suffix_starts(words.codes, words.counts, window, _reach(window))
            key, stretch = _stretch_hashes(words.codes, starts, window)
            first = starts.first - (np.cumsum(words.counts) - words.counts)[starts.doc]
            place = first * 64 + (starts.last - starts.first)
            columns = {"key": key, "stretch": stretch, "place": place}
            columns |= {c: batch[c].to_numpy()[starts.doc] for c in ("doc", "row")}
            yield pa.record_batch({c: pa.array(v) for c, v in columns.items()})

    return walk


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(position of the owner of each element, elements) of a list column; null lists are empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _stretches(window: int):
    """Words of the wanted stretches, as rows for trees, or one row per window where a group went beyond any prefix."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            words = words_of(batch["text"])
            owner, wanted = _lists(batch["wanted"])
            place, group, key, stretch = (wanted.field(c).to_numpy() for c in ("place", "group", "key", "stretch"))
            whole = wanted.field("whole").to_numpy(zero_copy_only=False)
            first = (np.cumsum(words.counts) - words.counts)[owner] + place // 64
            length = place % 64 + window
            doc = batch["doc"].to_numpy()[owner]
            raw = words.codes.tobytes()
            tree = np.flatnonzero(~whole)
            yield pa.record_batch(
                {
                    "group": pa.array(group[tree]),
                    "key": pa.array(key[tree]),
                    "stretch": pa.array(stretch[tree]),
                    "doc": pa.array(doc[tree]),
                    "at": pa.array(np.zeros(len(tree), np.int32)),
                    "codes": pa.array([raw[8 * a : 8 * b] for a, b in zip(first[tree], first[tree] + length[tree])], pa.binary()),
                }
            )
            for i in np.flatnonzero(whole):
                n = int(length[i]) - window + 1
                own = words.codes[first[i] : first[i] + length[i]]
                ids = np.stack([rolled(own, window, 17), rolled(own, window, 19)], 1)
                yield pa.record_batch(
                    {
                        "group": pa.nulls(n, pa.int64()),
                        "key": pa.array(np.full(n, key[i])),
                        "stretch": pa.array(np.full(n, stretch[i])),
                        "doc": pa.array(np.full(n, doc[i])),
                        "at": pa.array(np.arange(n, dtype=np.int32)),
                        "codes": pa.array([x.tobytes() for x in ids], pa.binary()),
                    }
                )

    return walk


def deep_repeats(codes: np.ndarray, lengths: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """Masks of the windows of each stretch that begin in a smaller document as well.

    The suffix tree of the stretches is held as its leaves in suffix order: ranks of 1, 2, 4 .. words give the rank of
    the next longer pieces, and two of the longest, overlapping, that of ``window`` words. Neighbours of one rank
    hang below one internal node at least ``window`` words deep; its smallest document is the first to have its words.
    """
    _, rank = np.unique(codes, return_inverse=True)
    rank, span = rank.astype(np.int64), 1

    def paired(rank: np.ndarray, step: int) -> np.ndarray:
        return np.unique(rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]

    while 2 * span <= window:
        rank = paired(rank, span)
        span *= 2
    if span < window:
        rank = paired(rank, window - span)
    counts = lengths - window + 1
    begins = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    leaf = rank[begins[owner] + nth]
    order = np.argsort(leaf, kind="stable")
    node = np.flatnonzero(np.r_[True, leaf[order][1:] != leaf[order][:-1]])
    doc = docs[owner[order]]
    earliest = np.repeat(np.minimum.reduceat(doc, node), np.diff(np.r_[node, len(order)]))
    again = order[doc > earliest]
    masks = np.zeros(len(lengths), np.int64)
    np.bitwise_or.at(masks, owner[again], np.int64(1) << nth[again])
    return masks


def _trees(window: int, most: int):
    """(key, stretch, mask) of the stretches with repeated windows; rows come sorted by group, whole groups at a time."""

    def solved(rows: pa.Table) -> pa.RecordBatch:
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint64)
        lengths = np.array([len(x) // 8 for x in rows["codes"].to_pylist()], np.int64)
        masks = deep_repeats(codes, lengths, rows["doc"].to_numpy(), window)
        hit = np.flatnonzero(masks)
        return pa.record_batch(
            {"key": pa.array(rows["key"].to_numpy()[hit]), "stretch": pa.array(rows["stretch"].to_numpy()[hit]), "mask": pa.array(masks[hit])}
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            group = batch["group"].to_numpy()
            if count + len(batch) > most and len(batch):
                # the open group is that of the last row; all before it are whole
                if held and group[0] != held[-1]["group"][-1].as_py():
                    yield solved(pa.Table.from_batches(held))
                    held, count = [], 0
                cut = int(np.searchsorted(group, group[-1], side="left"))
                if cut:
                    yield solved(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held, count, batch = [], 0, batch.slice(cut)
            held.append(batch)
            count += len(batch)
        if count:
            yield solved(pa.Table.from_batches(held))

    return walk


def _cut(window: int):
    """Rows with the words outside the marked windows."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            words = words_of(batch["text"])
            base = np.cumsum(words.counts) - words.counts
            owner, marks = _lists(batch["marks"])
            gone = np.zeros(len(words.codes), bool)
            if len(owner):
                place, mask = marks.field("place").to_numpy(), marks.field("mask").to_numpy()
                bits = (mask[:, None] >> np.arange(63)) & 1
                which, bit = np.nonzero(bits)
                edge = np.zeros(len(gone) + 1, np.int64)
                at = base[owner[which]] + place[which] // 64 + bit
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge)[:-1] > 0
            of = np.repeat(np.arange(len(batch)), words.counts)
            kept = np.flatnonzero(~gone)
            length = words.end[kept] - words.start[kept]
            lead = np.ones(len(kept), np.int64)  # the space before a word, none before a text's first
            if len(kept):
                lead[np.r_[True, of[kept][1:] != of[kept][:-1]]] = 0
            ends = np.cumsum(length + lead)
            out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
            step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            out[np.repeat(ends - length, length) + step] = words.body[np.repeat(words.start[kept], length) + step]
            sizes = np.bincount(of[kept], length + lead, len(batch)).astype(np.int64)
            offsets = np.r_[0, np.cumsum(sizes)]
            texts = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
            # runs of removed words, as [start, end) in words of the text
            first = np.zeros(len(gone) + 1, bool)
            first[base[words.counts > 0]] = True
            begins = gone & (np.r_[True, ~gone[:-1]] | first[:-1]) if len(gone) else gone
            ends_here = gone & (np.r_[~gone[1:], True] | first[1:]) if len(gone) else gone
            runs, stops = np.flatnonzero(begins), np.flatnonzero(ends_here) + 1
            spans = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(np.bincount(of[runs], minlength=len(batch)))].astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(runs - base[of[runs]]), pa.array(stops - base[of[runs]])], ["start", "end"]),
            )
            yield pa.record_batch(
                {
                    "id": batch["id"],
                    "n_words": pa.array(words.counts),
                    "n_removed": pa.array(np.bincount(of[gone], minlength=len(batch)).astype(np.int64)),
                    "spans": spans,
                    "kept_text": texts.cast(pa.large_string()).cast(pa.string()),
                }
            )

    return walk


def remove_repeats(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, group: int = GROUP
) -> DataFrame:
    """One row per row of ``df``: ``key, n_words, n_removed, spans, kept_text``.

    Words are runs without ASCII white space. A window is ``window`` consecutive words of a row; each word in a window
    whose words also begin in a row with a smaller key is removed. ``spans`` are the removed stretches, as [start, end)
    in words; ``kept_text`` the other words joined by one space. Windows are judged on the input.

    1. Every run of windows with one lowest gram enters as one suffix (``suffix_starts``), so that a suffix tree over
       about every fourteenth word finds all repeats. Suffixes whose prefix begins in one key alone are unique and go.
    2. Suffixes that stand for the same words are one leaf, of the smallest key: a passage that many rows share is one.
    3. Prefixes split the leaves into groups: ``SHORT`` words, the ``window // 3`` words that all windows have, and for
       groups still over ``group`` leaves the whole window, whose groups are single nodes and need no tree.
    4. Each group's suffix tree is built in memory (``deep_repeats``); its nodes at least ``window`` deep are the repeats.

    Words are compared by 64-bit codes; windows are one when all codes in them agree. Null and blank texts have no
    words. A null key counts as larger than all others, and null keys as equal. Rows that repeat key and text
    are judged alike; rows of one key never remove each other's words. Other columns are ignored. Empty tables give empty results.
    """
    docs = df.select(
        F.col(f"`{key}`").cast("bigint").alias("id"),
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(LAST)).alias("doc"),
        F.xxhash64(F.col(f"`{text}`")).alias("row"),
        F.col(f"`{text}`").alias("text"),
    )
    keys = docs.select("doc", "text").mapInArrow(_prefix_keys(window), "key bigint, doc bigint")
    shared = settle(keys.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("key"))
    suffixes = docs.select("doc", "row", "text").mapInArrow(
        _suffixes(window), "key bigint, stretch bigint, place bigint, doc bigint, row bigint"
    )
    suffixes = settle(suffixes.join(shared.hint("merge"), "key", "left_semi"))
    holder = F.struct("doc", "row", "place")
    leaves = settle(
        suffixes.groupBy("key", "stretch").agg(F.min(holder).alias("first"), F.max("doc").alias("hi"))
    )
    by_key = leaves.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    by_key = by_key.withColumn("short", F.shiftright("key", 32))
    by_short = by_key.groupBy("short").agg(F.sum("n").alias("n_short"))
    sized = settle(by_key.join(by_short, "short"))
    placed = leaves.join(sized.hint("merge"), "key").select(
        F.col("first.doc").alias("doc"),
        F.col("first.row").alias("row"),
        F.struct(
            F.col("first.place").alias("place"),
            F.when(F.col("n_short") <= group, F.col("short")).otherwise(F.col("key")).alias("group"),
            "key",
            "stretch",
            ((F.col("n_short") > group) & (F.col("n") > group)).alias("whole"),
        ).alias("one"),
    )
    wanted = settle(placed.groupBy("doc", "row").agg(F.collect_list("one").alias("wanted")))
    texts = docs.select("doc", "row", "text")
    once = texts.join(wanted.hint("merge"), ["doc", "row"]).select("doc", "text", "wanted")
    pieces = once.mapInArrow(
        _stretches(window), "group bigint, key bigint, stretch bigint, doc bigint, at int, codes binary"
    )
    if sized.filter((F.col("n_short") > group) & (F.col("n") > group)).isEmpty():
        in_trees, beyond = pieces, None
    else:
        pieces = settle(pieces)
        in_trees = pieces.filter("group is not null")
        windows = pieces.filter("group is null").select("codes", "doc", "key", "stretch", "at")
        earliest = windows.groupBy("codes").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi")
        beyond = windows.join(earliest.hint("merge"), "codes").filter("doc > lo")
        beyond = beyond.select("key", "stretch", F.expr("shiftleft(1L, at)").alias("mask"))
    masks = in_trees.repartition("group").sortWithinPartitions("group").mapInArrow(
        _trees(window, group), "key bigint, stretch bigint, mask bigint"
    )
    masks = masks if beyond is None else masks.union(beyond)
    masks = masks.groupBy("key", "stretch").agg(F.bit_or("mask").alias("mask"))
    judged = leaves.select("key", "stretch", F.col("first.doc").alias("lo"), "hi").join(masks, ["key", "stretch"], "left")
    judged = settle(judged.filter("lo < hi or mask is not null"))
    full = F.expr("shiftrightunsigned(-1L, cast(63 - place % 64 as int))")
    marks = suffixes.join(judged.hint("merge"), ["key", "stretch"]).select(
        "doc",
        "row",
        F.struct("place", F.when(F.col("doc") > F.col("lo"), full).otherwise(F.coalesce("mask", F.lit(0))).alias("mask")).alias("one"),
    )
    # a row repeated whole gives its marks as often; they are one set
    marks = marks.filter("one.mask <> 0").groupBy("doc", "row").agg(F.collect_set("one").alias("marks"))
    return (
        docs.join(marks.hint("merge"), ["doc", "row"], "left")
        .select("id", "text", "marks")
        .mapInArrow(
            _cut(window),
            "id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_text string",
        )
        .withColumnRenamed("id", key)
    )
