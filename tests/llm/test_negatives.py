"""Hard negatives against a version that scores all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rushlight.llm.negatives import mine_hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string, rank int, nr int, id string"


def all_scores(rows, positives=5, negatives=10, low=30, high=90):
    usable = {
        (i, label, tuple(math.floor(256 * x) for x in v))
        for i, v, label in rows
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for i, label, v in usable:
        if i % 10:
            continue
        scored = sorted({(-sum(a * b for a, b in zip(v, w)), j, same == label) for j, same, w in usable})
        first = [(j, -s) for s, j, same in scored if same and j != i][:positives]
        for j, p in first:
            inside = [(-s, k) for s, k, same in scored if not same and low * p <= 100 * -s <= high * p]
            out += [(i, j, r + 1, k, p, s) for r, (s, k) in enumerate(inside[:negatives])]
    return sorted(out)


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "old", 1, 2, "old") for r in rows], SCHEMA)
    made = mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **how)
    return sorted(tuple(r) for r in made.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(seed, n=300, wide=6):
    rng = random.Random(seed)
    hot = [round(rng.random(), 1) for _ in range(wide)]
    rows = []
    for i in range(n):
        v = hot if i % 3 == 0 else [rng.choice([0.0, 0.25, 0.5, 1.0, -0.5]) for _ in range(wide)]
        rows.append((i, v, i % 4 if i % 5 else rng.randrange(4)))
    odd = [(None, hot, 1), (400, None, 1), (410, hot, None), (420, [float("nan")] * wide, 1), (430, [float("inf")] * wide, 1),
           (440, [None] * wide, 2), (450, [], 1), (460, [1.0, 1.0], 2), (470, [1.0] * (wide + 3), 2), (-10, hot, 3)]
    return rows + odd + rows[:12]


@pytest.mark.parametrize("how", [{}, {"anchor_bytes": 300}, {"positives": 2, "negatives": 3, "low": 0, "high": 100}, {"positives": 9, "low": 50}])
def test_all_scores(spark, how):
    rows = vectors(len(how))
    want = all_scores(rows, **{k: v for k, v in how.items() if k != "anchor_bytes"})
    assert found(spark, rows, **how) == want and len(want) > 100


def test_beyond_doubles(spark):
    rows = [(i, [1e5 + i, 3e5 - i, 7.0 * i], i % 2) for i in range(40)]
    assert found(spark, rows) == all_scores(rows)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert found(spark, [(10, [1.0], 1), (2, [-1.0], 2)]) == []
