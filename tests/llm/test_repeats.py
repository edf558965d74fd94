"""Passages that repeat across documents, against a version that compares every window."""

import random
import re

import pytest
from pyspark.sql import Row

from rushlight.llm.suffixes import LAST, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def every_window(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    ids = [LAST if i is None else i for i, _ in rows]
    first = {}
    for i, w in zip(ids, words):
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for (name, _), i, w in zip(rows, ids, words):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((name, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=by_name)


def by_name(r):
    return (r[0] is None, r[0] or 0, r[1:])


def judged(df, **how):
    rows = remove_repeats(df, **how).collect()
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in rows)
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows], key=by_name)


def shared_passages(seed, window):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "ü😀", "x" * 300]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(window, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.6:
                part = list(rng.choice(passages))
            else:
                part = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
            if part and rng.random() < 0.3:
                part[rng.randrange(len(part))] = "edit"
            parts += part
        text = rng.choice([" ", "\n\t "]).join(parts) if parts else rng.choice([None, "", " "])
        rows.append((rng.choice([None, i, i, i, i, i % 7]), text))
    periodic = [(500, "a " * 400), (501, "a " * 300), (-3, "a " * 120), (502, "a b " * 200), (503, "b a " * 200)]
    return rows + rows[:5] + periodic


# groups of 3 leaves at most: all three prefix lengths are in use
@pytest.mark.parametrize("window,group", [(50, 20_000), (50, 3), (6, 2), (1, 5), (100, 2)])
def test_every_window(spark, window, group):
    rows = shared_passages(window + group, window)
    schema = "doc_id bigint, text string, n_words string, marks int, key int, row int"
    df = spark.createDataFrame([Row(a, b, "old", 1, 2, 3) for a, b in rows], schema)
    assert judged(df, window=window, group=group) == every_window(rows, window)


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert judged(edge_docs) == every_window(rows, 50)
    assert judged(no_docs) == []


def test_a_passage_in_a_third_of_all_rows(spark):
    """Different words around one passage: its leaves are as many as rows and go beyond any prefix."""
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"head{i} {passage} tail{i}" if i % 3 == 0 else f"other{i} text") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: r for r in judged(df, group=20)}
    assert got[0][2] == 0
    assert all(got[i][2:] == (70, f"head{i} tail{i}") for i in range(3, 900, 3))
    assert all(got[i][2] == 0 for i in range(900) if i % 3)
