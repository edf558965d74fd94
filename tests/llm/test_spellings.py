"""Spelling variants against a version that compares all words."""

import random
import re
import zlib
from collections import Counter

from rushlight.llm.spellings import group_spellings


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_pairs(rows, slip=None, min_length=5, min_count=3):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            at = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if slip and at % slip == 0:
                word = word[: at % len(word)] + word[at % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if n >= min_count and len(w) >= min_length}
    forms, rest = {}, {}
    for w, n in counts.items():
        close = [v for v in counts if v != w and near(v, w)]
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
        rest[w] = len(close)
    out = []
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, counts[w], rest[w], counts.get(forms[w])))
    return sorted(out)


def corpus(seed, docs=150):
    rng = random.Random(seed)
    letters = "abcdeéÿß×A"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(40)] + ["aaaaaa", "aaaaa", "aaaaaaa"]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = stems[min(int(rng.expovariate(0.1)), len(stems) - 1)]
            if rng.random() < 0.3:
                at, new = rng.randrange(len(w)), rng.choice("ab")
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + new + w[at:], w[:at] + new + w[at + 1 :]])
            words.append(w)
        rows.append((rng.choice([None, i, i, i]), rng.choice([None, "", " ".join(words)]) if i % 9 == 0 else "-".join(words)))
    long = "ab" * 20_000
    rows += [(900 + i, f"{long} {long[:-1]}c {long}x") for i in range(3)]
    return rows + rows[:4]


def found(df, **how):
    return sorted(tuple(r) for r in group_spellings(df, **how).collect())


def test_all_pairs(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(*r, "old", 1, "old") for r in rows], "doc_id bigint, text string, word string, n int, form string")
    want = all_pairs(rows, slip=5)
    assert found(df, slip=5) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])


def test_a_filter_in_several_passes(spark):
    """No more of the filter than one block is broadcast at a time; the words are the same."""
    rows = corpus(2, 60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df, filter_bytes=64) == all_pairs(rows)


def test_edges(spark, edge_docs, no_docs):
    assert found(edge_docs) == all_pairs([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert found(no_docs) == []
    assert group_spellings(no_docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]
