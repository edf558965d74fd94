import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rushlight.llm import exact, quality

SMALL = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    lines = [x for x in text.split("\n") if SPACE.sub("", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i : i + 3])] > 1}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


def test_measures_against_brute_force(spark, edge_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for df in (docs, edge_docs.select("doc_id", "text")):
        got = quality.measure_texts(df).collect()
        assert len(got) == df.count()
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(r.text), r.doc_id


def test_risk_bound_is_the_binomial_tail(spark):
    cases = [(n, k, 0.05) for n in (30, 200, 1000) for k in range(0, int(n * 0.05), 3)]
    df = spark.createDataFrame([(n, k) for n, k, _ in cases], "n bigint, k bigint")
    for r in df.withColumn("p", quality.risk_bound(F.col("n"), F.col("k"), 0.05)).collect():
        true = sum(math.comb(r.n, i) * 0.05**i * 0.95 ** (r.n - i) for i in range(r.k + 1))
        assert math.isclose(r.p, true, rel_tol=1e-9)


def test_cutoffs_are_the_strictest_safe_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    measured = quality.measure_texts(docs).drop("text").cache()
    got = {(r.stratum, r.rule): r.cutoff for r in quality.fit_cutoffs(measured, labels, max_false_rejection=0.3).collect()}
    good = defaultdict(list)
    fine = {r.doc_id for r in labels.filter("quality = 1").collect()}
    for r in measured.collect():
        if r.doc_id in fine and r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words:
            good[r.lang].append(r)
    risk = 0.3 / len(quality.RULES)
    level = 0.05 / (len(good) * len(quality.RULES))
    values = {
        "symbols": lambda r: r.n_symbols / r.n_words,
        "duplicate_lines": lambda r: r.n_dup_lines / max(r.n_lines, 1),
        "repeated_words": lambda r: r.n_repeat_words / r.n_words,
        "capitals": lambda r: r.n_capitals / max(r.word_chars, 1),
        "marks": lambda r: r.n_marks / r.n_words,
    }
    want = {}
    for lang, rows in good.items():
        n = len(rows)
        for rule in quality.RULES:
            for cutoff in rule.cutoffs:
                k = sum(values[rule.name](r) > cutoff for r in rows)
                if k >= n * risk or sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) > level:
                    break
                want[lang, rule.name] = cutoff
    assert got == want and want


def test_quality_edges(edge_docs, no_docs, labels):
    rows = quality.judge_quality(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[k].base_failed and not by[k].kept for k in (1, 2, 3, 8, 9, 10))
    assert by[4].kept and by[4]["size"] == "old"
    assert quality.judge_quality(no_docs, labels).count() == 0
    assert quality.judge_quality(edge_docs, labels.limit(0)).filter("kept").count() > 0


def brute_groups(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[SPACE.sub(" ", text or "")].append(key)
    out = []
    for body, keys in groups.items():
        keep = min((k for k in keys if k is not None), default=None)
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(k, keep, len(keys), k == keep, sha) for k in keys]
    return sorted(out, key=str)


def test_exact_groups_against_brute_force(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for df, room in ((docs, 4096), (docs, 3), (edge_docs, 1)):
        got = exact.exact_groups(df, bucket_keys=room).collect()
        mine = sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got], key=str)
        assert mine == brute_groups([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert exact.exact_groups(no_docs).count() == 0


def test_directory_splits_like_an_extendible_hash(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    slots = exact.directory(keys, bucket_keys=100).collect()
    values = [r.key & (2**64 - 1) for r in keys.collect()]

    def split(prefix, depth):
        mine = [v for v in values if v >> (64 - depth) == prefix] if depth else values
        if len(mine) <= 100 or depth == exact.MAX_DEPTH:
            return {(prefix << (exact.MAX_DEPTH - depth), depth)}
        return split(prefix * 2, depth + 1) | split(prefix * 2 + 1, depth + 1)

    filled = {v >> 48 for v in values}
    want = {(b, d) for b, d in split(0, 0) if any(b <= s < b + (1 << (exact.MAX_DEPTH - d)) for s in filled)}
    assert {(r.bucket, r.depth) for r in slots} == want
    assert {r.slot for r in slots} == filled
