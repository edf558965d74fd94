"""Spelling variants: generated edits probed against length-sharded blocked Bloom filters, then an exact join."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rushlight.llm.suffixes import mix64
from rushlight.plans.sizing import settle

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}
MIN_LENGTH, MIN_COUNT = 5, 3
BITS = 16  # of the filter, per word
FILTER_BYTES = 32 << 20  # most of the filter that is broadcast at a time; the rest goes in further passes
PLAIN = 256  # lengths below have a shard each, longer ones share as many again
WORDS_PER_TASK = 20_000
HELD = 500_000  # words a task counts before it hands its counts on
EDITS = 1_000_000  # edits probed at a time

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _counted(min_length: int, slip: int | None):
    """(word, n): words of the texts with their counts, combined within the task."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                if not text:
                    continue
                head = zlib.crc32(f"{'' if key is None else key}:".encode())
                for run, n in Counter(RUN.findall(text)).items():
                    word = run.lower() if run.isascii() else run.translate(LOWER)
                    if slip:
                        at = zlib.crc32(word.encode(), head)
                        if at % slip == 0:
                            at %= len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) > HELD:
                    yield _rows(held)
                    held.clear()
        if held:
            yield _rows(held)

    def _rows(held: Counter[str]) -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

    return walk


def _shard(length):
    """Shard of a length: its own up to ``PLAIN``, one of as many more beyond."""
    return np.where(length < PLAIN, length, PLAIN + length % PLAIN)


def _turns(length: int) -> np.ndarray:
    return mix64(np.arange(1, length + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions in ``words``, code points as a matrix) of words of one length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        flat = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), np.uint32)
        yield int(length), at, flat.reshape(len(at), length)


class Layout:
    """Where each shard's blocks of 512 bits lie, one after the other, by the number of its words."""

    def __init__(self, sizes: dict[int, int], letters: dict[int, list[int]]):
        self.sizes, self.letters = sizes, letters
        shards = max(sizes, default=0) + 1
        self.n = np.zeros(shards, np.uint64)
        for shard, words in sizes.items():
            self.n[shard] = -(-words * BITS // 512)
        self.offset = np.concatenate([[0], np.cumsum(self.n)[:-1]]).astype(np.int64)
        self.blocks = int(self.n.sum())

    def has(self, length: int) -> int:
        return self.sizes.get(int(_shard(length)), 0)

    def place(self, sums: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, bits) of words by their letter sums: one bit in each of a block's eight words, six hash bits each."""
        shard = int(_shard(length))
        with np.errstate(over="ignore"):
            hashed = mix64(sums + np.uint64(length) * _STEP)
            block = self.offset[shard] + ((hashed >> np.uint64(32)) * self.n[shard] >> np.uint64(32)).astype(np.int64)
            return block, mix64(hashed + _STEP)


def _bit(bits: np.ndarray, part: int) -> np.ndarray:
    return np.uint64(1) << (bits >> np.uint64(6 * part) & np.uint64(63))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, letter, n): the letters of each shard's words; letter 0 counts the words."""
    for batch in batches:
        found: Counter[tuple[int, int]] = Counter()
        for length, at, points in _by_length(batch["word"].to_pylist()):
            shard = int(_shard(length))
            found[shard, 0] += len(at)
            found.update({(shard, int(p)): 1 for p in np.unique(points)})
        shards, letters = [k[0] for k in found], [k[1] for k in found]
        yield pa.record_batch(
            {"shard": pa.array(shards, pa.int32()), "letter": pa.array(letters, pa.int32()), "n": pa.array(found.values(), pa.int64())}
        )


def _filled(layout: Layout):
    """(block, b0 .. b7): the bits that words set, combined per batch."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, bits = [], []
            for length, _, points in _by_length(batch["word"].to_pylist()):
                with np.errstate(over="ignore"):
                    block, bit = layout.place((points * _turns(length)).sum(1, dtype=np.uint64), length)
                blocks.append(block)
                bits.append(bit)
            if not blocks:
                continue
            block, bit = np.concatenate(blocks), np.concatenate(bits)
            order = np.argsort(block, kind="stable")
            first = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1]])
            columns = {f"b{i}": np.bitwise_or.reduceat(_bit(bit[order], i), first).view(np.int64) for i in range(8)}
            yield pa.record_batch({"block": pa.array(block[order][first])} | {c: pa.array(v) for c, v in columns.items()})

    return walk


def _probed(layout: Layout, sent, begin: int, end: int):
    """(word, n, edit, shorter): edits of the words that the blocks ``begin`` to ``end`` of the filter may hold."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sent.value, np.uint64).reshape(-1, 8)

        def met(sums: np.ndarray, length: int) -> np.ndarray:
            """Which of these sums the filter may hold."""
            block, bits = layout.place(sums, length)
            left = np.flatnonzero((block >= begin) & (block < end))
            for part in range(8):
                one = _bit(bits[left], part)
                left = left[table[block[left] - begin, part] & one != 0]
            return left

        for batch in batches:
            words, counts = batch["word"].to_pylist(), batch["n"].to_numpy()
            of, edits, shorter = [], [], []
            for length, at, points in _by_length(words):
                turns = _turns(length)
                letters = np.array(layout.letters.get(int(_shard(length)), []), np.uint64)
                rows = max(1, EDITS // (length * max(1, len(letters))))
                for low in range(0, len(at), rows):
                    some, own = points[low : low + rows].astype(np.uint64), at[low : low + rows]
                    with np.errstate(over="ignore"):
                        parts = some * turns
                        total = parts.sum(1, dtype=np.uint64)
                        if layout.has(length - 1) and length > 1:
                            before = np.cumsum(parts, 1, dtype=np.uint64) - parts
                            moved = some[:, 1:] * turns[:-1]
                            after = moved.sum(1, dtype=np.uint64)[:, None] - (np.cumsum(moved, 1, dtype=np.uint64) - moved)
                            after = np.concatenate([after, np.zeros((len(some), 1), np.uint64)], 1)
                            # of a run of one letter only the first goes: the others give the same word
                            new = np.ones(some.shape, bool)
                            new[:, 1:] = some[:, 1:] != some[:, :-1]
                            row, place = np.nonzero(new)
                            for k in met((before + after)[row, place], length - 1):
                                word = words[own[row[k]]]
                                of.append(own[row[k]])
                                edits.append(word[: place[k]] + word[place[k] + 1 :])
                                shorter.append(True)
                        if layout.has(length) > 1:
                            wide = max(1, EDITS // (len(some) * max(1, len(letters))))
                            for left in range(0, length, wide):
                                here = slice(left, left + wide)
                                base = total[:, None] - parts[:, here]
                                sums = base[:, :, None] + letters * turns[here, None]
                                row, place, letter = np.nonzero(some[:, here, None] != letters)
                                for k in met(sums[row, place, letter], length):
                                    word, j = words[own[row[k]]], left + place[k]
                                    of.append(own[row[k]])
                                    edits.append(word[:j] + chr(int(letters[letter[k]])) + word[j + 1 :])
                                    shorter.append(False)
            yield pa.record_batch(
                {
                    "word": pa.array([words[i] for i in of], pa.string()),
                    "n": pa.array(counts[np.array(of, np.int64)]),
                    "edit": pa.array(edits, pa.string()),
                    "shorter": pa.array(shorter, pa.bool_()),
                }
            )

    return walk


def near_words(spark: SparkSession, vocabulary: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``word, n, near, near_n``: both directions of every pair of ``vocabulary`` (word, n) one edit apart.

    An edit inserts, deletes or replaces one code point. Every word's deletions and replacements are generated as hash
    sums (a deletion is the other word's insertion) and probed against a Bloom filter of the vocabulary,
    in blocks of 512 bits and sharded by length. What the filter may hold goes to an exact join with the vocabulary.
    At most ``filter_bytes`` of the filter are broadcast at a time, whatever the vocabulary's size.
    """
    counted = vocabulary.mapInArrow(_profile, "shard int, letter int, n bigint").groupBy("shard", "letter").agg(F.sum("n").alias("n"))
    rows = counted.collect()  # 2 x PLAIN shards with the letters of ``RUN`` at most
    letters: dict[int, list[int]] = {}
    for r in rows:
        if r.letter:
            letters.setdefault(r.shard, []).append(r.letter)
    layout = Layout({r.shard: r.n for r in rows if not r.letter}, letters)
    schema = "word string, n bigint, edit string, shorter boolean"
    if not layout.blocks:
        return vocabulary.limit(0).select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n"))
    bits = [f"b{i}" for i in range(8)]
    filled = vocabulary.mapInArrow(_filled(layout), "block bigint, " + ", ".join(f"{b} bigint" for b in bits))
    filled = settle(filled.groupBy("block").agg(*[F.bit_or(b).alias(b) for b in bits]))
    tasks = max(spark.sparkContext.defaultParallelism, -(-sum(layout.sizes.values()) // WORDS_PER_TASK))
    spread = vocabulary.repartition(tasks, "word")
    found = []
    step = max(1, filter_bytes // 64)
    for begin in range(0, layout.blocks, step):
        end = min(begin + step, layout.blocks)
        part = filled.filter((F.col("block") >= begin) & (F.col("block") < end)).toArrow()
        table = np.zeros((end - begin, 8), np.uint64)
        at = part["block"].to_numpy() - begin
        for i, b in enumerate(bits):
            table[at, i] = part[b].to_numpy().view(np.uint64)
        found.append(spread.mapInArrow(_probed(layout, spark.sparkContext.broadcast(table.tobytes()), begin, end), schema))
    positives = reduce(DataFrame.union, found)
    known = vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("near_n"))
    pairs = settle(positives.join(known, "edit"))
    there = pairs.select("word", "n", F.col("edit").alias("near"), "near_n")
    back = pairs.filter("shorter").select(F.col("edit").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return there.union(back)


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of the forms from each word of ``forms`` (word, form); steps double from round to round."""
    rooted = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = rooted.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = settle(rooted.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"))
        if moved.filter("further is not null").isEmpty():
            return moved.select("word", "root")
        rooted = moved.select("word", "root")


def group_spellings(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    slip: int | None = None,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """One row per word of the texts: ``word, form, root, n, n_near, form_n``.

    Words are runs of Latin letters, A-Z lower-cased, of at least ``min_length`` code points that occur ``min_count``
    times or more in all texts. Near words are one inserted, deleted or replaced code point apart (``near_words``). A
    word's form is its near word of largest count (of equals the first in code-point order) where that is at least twice the
    word's own; ``root`` is the last word that forms lead to, the word itself where it has none.

    ``slip`` plants errors, to measure recall: a run loses one letter where the crc32 of ``<key>:<run>`` is divisible by it.
    Null and blank texts have no words; a null key reads as an empty one; repeated rows count as often as they come. Other
    columns are ignored. Runs may be of any length. Empty tables give empty results.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    counted = rows.mapInArrow(_counted(min_length, slip), "word string, n bigint")
    vocabulary = settle(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_words(spark, vocabulary, filter_bytes).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    clear = -F.col("best.less") >= 2 * F.col("n")
    named = settle(
        vocabulary.join(near, "word", "left").select(
            "word",
            F.when(clear, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(clear, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(named.filter("form is not null"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
