"""Toxicity by class-conditional Kneser-Ney models of spelling with shared backoff counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rushlight.plans.sizing import settle

WORD = re.compile(r"[^\W_]+")
CONTEXT = 4  # letters before the predicted one in the highest order
DISCOUNT = 0.75
MAX_ROWS = 500_000  # labelled rows, about, that the models and their calibration are fitted on
PART_GRAMS = 4_000_000  # letter sequences of one part of the models, about; more of them make more parts
SHARED = 2  # orders below this one are in every part
MEMO = 400_000  # words a task remembers the score of

_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MUL1
        x = (x ^ (x >> np.uint64(27))) * _MUL2
        return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _grams(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For every letter of every word (an end mark included): its word's place, and for each context length the
    hash of (context, letter) and of the context. Contexts are padded with a start mark."""
    flat = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    letters = [np.where(place >= j, np.roll(flat, j), np.uint64(ord("^"))) for j in range(CONTEXT + 1)]
    keep = place > 0
    grams, contexts = [], []
    with np.errstate(over="ignore"):
        for k in range(CONTEXT + 1):
            context = np.full(len(flat), k + 1, np.uint64)
            for j in range(k, 0, -1):
                context = _mix(context + letters[j] + _STEP)
            contexts.append(context[keep])
            grams.append(_mix(context + letters[0] + _STEP)[keep])
    return word[keep], grams, contexts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the highest order's letter sequences, with the keys of all their shorter forms.

    A word counts once for each text that has it: texts are its contexts, and one text's repeats are no evidence.
    """
    for batch in batches:
        counts = [Counter(), Counter()]
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            counts[label].update(set(words_of(text)))
        words = sorted(counts[0].keys() | counts[1].keys())
        if not words:
            continue
        word, grams, contexts = _grams(words)
        top, first, at = np.unique(grams[CONTEXT], return_index=True, return_inverse=True)
        sums = [np.bincount(at, np.array([c[w] for w in words])[word]).astype(np.int64) for c in counts]
        keys = np.stack([g[first] for g in grams] + [c[first] for c in contexts], axis=1).view(np.int64)
        ends = pa.array(np.arange(len(top) + 1, dtype=np.int32) * keys.shape[1])
        lists = pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(top.view(np.int64)), lists, pa.array(sums[0]), pa.array(sums[1])], ["gram", "keys", "ordinary", "toxic"]
        )


def _narrow(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.int32 if counts.size == 0 or counts.max() < 1 << 31 else np.int64)


def _levels(keys: np.ndarray, counts: np.ndarray, orders: range) -> tuple[list, np.ndarray, np.ndarray]:
    """Levels of falling ``orders`` from (gram keys by order, context keys by order) of the highest order's grams, rising,
    and what the order below counts: a row of keys for each distinct gram, and which classes have it."""
    levels: list = []
    rows, here = np.arange(len(keys)), counts.astype(np.float64)
    for k in orders:
        grams, first, at = np.unique(keys[rows, k], return_index=True, return_inverse=True)
        seen = np.stack([np.bincount(at, here[:, c], minlength=len(grams)) for c in (0, 1)], axis=1)
        if k == 0:
            seen[:] = seen.sum(axis=1, keepdims=True)
        contexts, into = np.unique(keys[rows[first], CONTEXT + 1 + k], return_inverse=True)
        totals = np.stack([np.bincount(into, seen[:, c], minlength=len(contexts)) for c in (0, 1)], axis=1)
        kinds = np.stack([np.bincount(into, seen[:, c] > 0, minlength=len(contexts)) for c in (0, 1)], axis=1)
        levels.insert(0, (grams, _narrow(seen), contexts, _narrow(totals), _narrow(kinds)))
        # one order down, every distinct sequence of this order counts once
        rows, here = rows[first], (seen > 0).astype(np.float64)
    return levels, keys[rows], here


def build_part(keys: np.ndarray, counts: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Levels from ``SHARED`` on of one part's grams, and what they add to the counts of the order below: a row of keys per
    gram of that order, with the distinct letters before it by class."""
    levels, keys, here = _levels(keys, counts, range(CONTEXT, SHARED - 1, -1))
    _, first, at = np.unique(keys[:, SHARED - 1], return_index=True, return_inverse=True)
    sums = np.stack([np.bincount(at, here[:, c], minlength=len(first)) for c in (0, 1)], axis=1)
    return levels, keys[first], sums


def build_shared(added: list[tuple[np.ndarray, np.ndarray]]) -> list:
    """Levels below ``SHARED`` from what all parts add; no two parts have a gram of order ``SHARED`` in common."""
    keys, sums = (np.concatenate(x) for x in zip(*added))
    return _levels(keys, sums, range(SHARED - 1, -1, -1))[0]


@dataclass
class SpellingModels:
    """Two interpolated Kneser-Ney models over letters; classes are 0 (ordinary) and 1 (toxic).

    The highest order counts occurrences in the class; lower orders count the distinct letters that come before a
    sequence in the class; the lowest counts them over both classes together, so what is rare in either falls back
    to the same distribution. ``levels[k]``: sorted gram keys with both classes' counts, sorted context keys with both
    classes' totals and numbers of distinct continuations.

    Large models come in ``parts``: part i has the grams whose context of ``SHARED`` letters has a hash of i modulo the
    number of parts, and all levels below ``SHARED``. It predicts the letters behind these contexts; every letter is
    predicted by one part with all the counts it needs, so the sum over the parts is the whole model's.
    """

    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    part: int = 0
    parts: int = 1

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> SpellingModels:
        """``keys``: rows of (gram keys by order, context keys by order) of each highest-order gram; ``counts``: (n, 2)."""
        levels, below, sums = build_part(keys, counts)
        return cls(build_shared([(below, sums)]) + levels)

    def log_ratios(self, words: list[str]) -> np.ndarray:
        """log p(word | toxic) - log p(word | ordinary) of each word, over the letters of this part."""
        if not len(self.levels[0][0]):
            return np.zeros(len(words))
        word, grams, contexts = _grams(words)
        if self.parts > 1:
            mine = contexts[SHARED].view(np.int64) % self.parts == self.part
            word, grams, contexts = word[mine], [g[mine] for g in grams], [c[mine] for c in contexts]
        p = np.full((len(word), 2), 1.0 / (len(self.levels[0][0]) + 1))
        for k, (known, seen, heads, totals, kinds) in enumerate(self.levels):
            head, there = _find(heads, contexts[k].view(np.int64))
            gram, met = _find(known, grams[k].view(np.int64))
            if not len(known):  # no gram of this part: the orders below predict
                break
            total = np.where(there[:, None], totals[head], 0.0)
            count = np.where(met[:, None], seen[gram], 0.0)
            floor = DISCOUNT if k else 0.5
            more = np.maximum(count - floor, 0) + floor * np.where(there[:, None], kinds[head], 0.0) * p
            p = np.where(total > 0, more / np.maximum(total, 1), p)
        return np.bincount(word, np.log(p[:, 1] / p[:, 0]), minlength=len(words))


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def _features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Length-normalised log-likelihood ratios: by the root of the length, by the length, and the length itself."""
    m = np.maximum(n, 1)
    return np.stack([np.ones(len(m)), total / np.sqrt(m), total / m, np.log(m)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights by Newton steps; the ridge keeps them finite where classes separate."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9) if len(x) else np.ones(x.shape[1])
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def _total(shared, levels, part: int, parts: int) -> object:
    """Sum of a text's word log ratios over one part of the models, and its number of words; a task scores words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = SpellingModels(shared.value + levels.value, part, parts)
        memo: dict[str, float] = {}
        for batch in batches:
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            if len(memo) > MEMO:
                memo.clear()
            new = sorted({w for t in texts for w in t} - memo.keys())
            for start in range(0, len(new), 20_000):
                some = new[start : start + 20_000]
                memo.update(zip(some, models.log_ratios(some).tolist()))
            totals = pa.array([float(sum(map(memo.__getitem__, t))) for t in texts], pa.float64())
            sizes = pa.array([len(t) for t in texts], pa.int64())
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*rest, totals, sizes], [*names, "total", "n"])

    return run


def _totals(df: DataFrame, shared, parts: list) -> DataFrame:
    """``df`` (one column and ``text`` behind it) with ``total`` and ``n`` in the place of the text, a row each.

    Models in one part need no shuffle. Each of several parts reads the texts in tasks of its own; what it finds goes by
    the column and the digest of the text, and rows that repeat are added up and laid out again.
    """
    name = df.columns[0]
    kind = df.schema[name].dataType.simpleString()
    if len(parts) == 1:
        return df.mapInArrow(_total(shared, parts[0], 0, 1), f"{name} {kind}, total double, n bigint")
    marked = df.select(name, F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text")
    schema = f"{name} {kind}, sha string, total double, n bigint"
    found = [marked.mapInArrow(_total(shared, p, i, len(parts)), schema) for i, p in enumerate(parts)]
    whole = reduce(DataFrame.unionAll, found).groupBy(name, "sha").agg(
        F.sum("total").alias("sum"), F.any_value("n").alias("n"), (F.count(F.lit(1)) / len(parts)).cast("int").alias("times")
    )
    return whole.select(
        name, (F.col("sum") / F.col("times")).alias("total"), "n", F.explode(F.array_repeat(F.lit(0), F.col("times")))
    ).drop("col")


def score_toxicity(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = MAX_ROWS,
    part_grams: int = PART_GRAMS,
) -> DataFrame:
    """One row per row of ``df``: ``key, log_ratio`` (of the whole text)``, n_words, score`` (0 to 1).

    ``labels`` (key, label 0/1) are the rows to learn from; pass only those that may be learned from. About ``max_rows``
    of them, chosen by a hash of the key, are used: three quarters to count letter sequences for the two models,
    one quarter to fit the logistic curve from length-normalised log ratios to a probability. Up to that bound all
    labelled rows count. Nothing but the text enters a score.

    Words are runs of letters and digits, lower-cased; a word's letters are predicted one by one from the four before
    them by each class's model, so spellings never seen whole are judged by their parts. Whole texts are scored, without
    a shuffle. All letter sequences count, however rare. The models are broadcast in parts of about ``part_grams`` sequences,
    built one after the other; more sequences make more parts, each of which reads the texts again.

    Null and empty texts have log ratio 0 and get the curve's value for no words; without labels of both classes
    every score is the share of label 1 (0.5 without any). Repeated rows each get a score; a repeated label counts
    as often as it occurs if it agrees with itself, and a row labelled both ways counts for both.
    """
    spark = df.sparkSession
    named = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("id").isNotNull()
    )
    n = max(named.count(), 1)
    unit = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    share = min(1.0, max_rows / n)
    chosen = settle(named.filter(unit < share).withColumn("curve", F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(4)) == 0))
    small = F.broadcast(chosen)  # about max_rows rows of a number, a label and a flag
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    labelled = rows.join(small, "id")
    grams = settle(
        labelled.filter(~F.col("curve")).select("text", "label")
        .mapInArrow(_count, "gram bigint, keys array<bigint>, ordinary bigint, toxic bigint")
        .groupBy("gram")
        .agg(F.any_value("keys").alias("keys"), F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    )
    n_grams = grams.count()
    n_parts = max(1, -(-n_grams // part_grams))
    width, added, parts = 2 * (CONTEXT + 1), [], []
    shard = F.pmod(F.element_at("keys", CONTEXT + 2 + SHARED), F.lit(n_parts))
    for part in range(n_parts):  # the driver holds one part at a time, and the two lowest orders
        found = grams.filter(shard == part).toArrow()
        keys = found.column("keys").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        counts = np.stack([found.column(c).to_numpy() for c in ("ordinary", "toxic")], axis=1)
        levels, below, sums = build_part(keys, counts)
        added.append((below, sums))
        parts.append(spark.sparkContext.broadcast(levels))
    shared = spark.sparkContext.broadcast(build_shared(added))
    held = _totals(labelled.filter("curve").select("label", "text"), shared, parts).toArrow()
    y = held.column("label").to_numpy().astype(np.float64)
    if len(y) and 0 < y.sum() < len(y) and n_grams:
        weights = fit_logistic(_features(held.column("total").to_numpy(), held.column("n").to_numpy()), y)
    else:
        mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        weights = np.array([np.log(mean / (1 - mean)), 0.0, 0.0, 0.0])
    scored = _totals(rows.select("id", "text"), shared, parts)
    words = F.greatest("n", F.lit(1))
    a, b, c, d = (F.lit(float(w)) for w in weights)
    linear = a + b * F.col("total") / F.sqrt(words) + c * F.col("total") / words + d * F.log(words)
    return scored.select(
        F.col("id").alias(key),
        F.col("total").alias("log_ratio"),
        F.col("n").alias("n_words"),
        (1 / (1 + F.exp(-linear))).alias("score"),
    )
