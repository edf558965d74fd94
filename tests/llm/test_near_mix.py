import itertools
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rushlight.llm import darts, mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    words = WORD.findall(text or "")
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute_classes(rows):
    bags = {k: bag(t) for k, t in rows}
    root = {k: k for k in bags}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(bags), 2):
        if bags[a] and similarity(bags[a], bags[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in bags}


def near_texts(seed=3):
    """Families of edited copies, a large one among them, chains, and strangers that share long passages."""
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts, passage = {}, fresh(60)
    for family in range(25):
        base = fresh(rnd.randrange(60, 200))
        for _ in range(60 if family == 0 else rnd.randrange(1, 6)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 3)):
                copy[rnd.randrange(len(copy))] = fresh(1)[0]
            texts[len(texts)] = " ".join(copy)
    for _ in range(20):
        texts[len(texts)] = " ".join(passage + fresh(40))
    chain = fresh(120)
    for _ in range(8):
        chain = chain[4:] + fresh(4)
        texts[len(texts)] = " ".join(chain)
    for t in ("", None, "a b", "a b", "a  b", "same " * 300, "same " * 320):
        texts[len(texts)] = t
    return texts


def test_near_duplicates_against_brute_force(spark):
    texts = near_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in darts.near_duplicates(df).collect()}
    want = brute_classes(texts.items())
    assert {k: r.class_id for k, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.class_id == k) for k, r in got.items())


def test_the_exact_round_alone_is_right(spark, monkeypatch):
    monkeypatch.setattr(darts, "STARS", 0)
    texts = near_texts(8)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in darts.near_duplicates(df).collect()}
    assert got == brute_classes(texts.items())


def test_near_edges(spark, edge_docs, no_docs):
    got = darts.near_duplicates(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r.class_id for r in got}
    assert by[4] == by[5] == by[7] == by[6] == 4 and by[10] == by[11] == 10 and by[1] == 1 and by[2] == 2 and by[3] == 3
    assert darts.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.8])
def test_signatures_meet_as_often_as_weights_overlap(share):
    rng = np.random.default_rng(1)
    met, true = [], []
    for _ in range(40):
        e = rng.integers(0, 2**62, 300).astype(np.uint64)
        w = rng.integers(1, 6, 300).astype(float)
        v = w.copy()
        v[: int(300 * (1 - share))] = rng.integers(1, 9, int(300 * (1 - share)))
        owner = np.repeat([0, 1], 300)
        s = darts.dart_signatures(owner, np.concatenate([e, e]), np.concatenate([w, v]), 2, 132)
        met.append((s[0] == s[1]).mean())
        true.append(np.minimum(w, v).sum() / np.maximum(w, v).sum())
    assert abs(np.mean(met) - np.mean(true)) < 0.02


def targets_by_hand(sizes, share=1.5):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = {}
    while len(target) < len(order):
        left = share * sum(sizes.values()) - sum(target.values())
        rest = [s for s in order if s not in target]
        part = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if part[s] > 2 * sizes[s]]
        target |= {s: 2 * sizes[s] for s in over} if over else part
    return target


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_mix_comes_near_its_targets(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    mixed = mixing.mix_sources(docs, F.array("source")).select("doc_id", "source", "size", "pattern_target", "taken").collect()
    again = mixing.mix_sources(docs.repartition(5), F.array("source")).select("doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in mixed} == {r.doc_id: r.taken for r in again}
    sizes, taken = Counter(), Counter()
    for r in mixed:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = targets_by_hand(sizes)
    largest = max(r.size for r in mixed)
    for r in mixed:
        assert abs(r.pattern_target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest / 2 + 1


def test_flow_is_cheapest_for_overlapping_sources():
    patterns = {0: ([0], 10), 1: ([0, 1], 6), 2: ([1], 3)}
    for quotas in ([10, 9], [16, 3], [14, 12], [26, 6], [40, 40]):
        taken = mixing.route(patterns, quotas, 2)
        cost = sum(max(0, t - patterns[p][1]) for p, (t, _) in taken.items())
        best = None
        for a in range(21):
            for b in range(13):
                for c in range(7):
                    for d in range(13 - b):
                        if a + b <= quotas[0] and d + c <= quotas[1]:
                            found = (-(a + b + c + d), max(0, a - 10) + max(0, b + d - 6) + max(0, c - 3))
                            best = found if best is None else min(best, found)
        assert (-sum(t for t, _ in taken.values()), cost) == best


def test_flow_of_many_overlapping_patterns():
    rnd = random.Random(12)
    n = 6_000
    patterns = {i: (sorted({i % n, rnd.randrange(n), (i * 7) % n}), rnd.randint(0, 900)) for i in range(2 * n)}
    quotas = [rnd.randint(0, 3_000) for _ in range(n)]
    begin = time.perf_counter()
    taken = mixing.route(patterns, quotas, 2)
    assert time.perf_counter() - begin < 20
    sent = Counter()
    for i, (words, by) in taken.items():
        assert words == sum(by.values()) <= 2 * patterns[i][1] and min(by.values()) >= 0 and set(by) == set(patterns[i][0])
        sent.update(by)
    assert all(sent[s] <= quotas[s] for s in range(n))
    # a source left short reaches only texts that are read twice, through whatever sources could give way
    reached, at = {s for s in range(n) if sent[s] < quotas[s]}, None
    while at != len(reached):
        at = len(reached)
        near = [i for i, (sources, _) in patterns.items() if reached & set(sources)]
        reached |= {s for i in near for s, words in taken[i][1].items() if words}
    assert all(taken[i][0] == 2 * patterns[i][1] for i in near)


def test_many_sources(spark):
    n = 50_000
    docs = spark.range(2 * n).select(
        F.col("id").alias("doc_id"), F.format_string("s%05d", F.col("id") % n).alias("source"), F.repeat(F.lit("w "), 3).alias("text")
    )
    mixed = mixing.mix_sources(docs, F.array("source"))
    by = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("pattern_target").alias("target")).collect()
    assert len(by) == n and all(abs(r.taken - r.target) <= 3 for r in by)
    assert abs(sum(r.target for r in by) - 1.5 * 6 * n) < 1


def test_mix_with_overlap_and_edges(spark, edge_docs, no_docs):
    both = edge_docs.withColumn("source", F.array(F.col("source"), F.lit("all")))
    rows = mixing.mix_sources(both, F.col("source")).collect()
    assert len(rows) == edge_docs.count() and all(r.taken in (0, r["size"], 2 * r["size"]) for r in rows)
    assert mixing.mix_sources(no_docs, F.array("source")).count() == 0
    none = mixing.mix_sources(edge_docs, F.lit(None).cast("array<string>")).collect()
    assert defaultdict(int, Counter(tuple(r.pattern) for r in none)) == {(None,): edge_docs.count()}


def test_components_of_chains_stars_and_strangers(spark):
    rnd = random.Random(9)
    ids = rnd.sample(range(10**6), 400)
    edges = list(zip(ids[:150], ids[1:150])) + [(ids[200], x) for x in ids[201:300]] + [(ids[300], ids[300])]
    edges += [(rnd.choice(ids[310:]), rnd.choice(ids[310:])) for _ in range(70)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.root for r in darts.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_columns_of_any_name_come_through(spark):
    """Names that differ by case alone, hidden ones, and those of the operators' own tables."""
    rows = [(i, f"word {i} " * (i + 1), "en", f"s{i % 3}", "a", "b", "c", "d") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, Size string, _order string, whole string, room string")
    mixed = mixing.mix_sources(df, F.array("source"))
    assert mixed.columns == ["doc_id", "text", "lang", "source", "_order", "whole", "room", "size", "pattern", "pattern_target", "taken"]
    assert all((r._order, r.whole, r.room) == ("b", "c", "d") and r["size"] == 2 * (r.doc_id + 1) for r in mixed.collect())
    named = df.toDF("doc_id", "text", "lang", "source", "N_WORDS", "_cut", "_stratum", "rule")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int")
    judged = quality.judge_quality(named, labels)
    assert judged.columns[:7] == ["doc_id", "text", "lang", "source", "_cut", "_stratum", "rule"] and "n_words" in judged.columns
    assert all((r._cut, r._stratum, r.rule) == ("b", "c", "d") for r in judged.collect())
