import random
import re
from collections import Counter

import public_tokenizers
import sentencepiece
from test_near_mix import brute_classes
from test_quality_exact import brute_groups

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, steps[-1], FOLDER).write.parquet(str(tmp_path / name))
        steps.append(spark.read.parquet(str(tmp_path / name)))
        if name != "encode":
            assert steps[-1].columns == corpus_pipeline.COLUMNS
    rows = [{r.doc_id: r for r in step.collect()} for step in steps]
    assert 0 < len(rows[1]) < len(rows[0])
    kept = {g[0] for g in brute_groups([(k, r.text) for k, r in rows[1].items()]) if g[3]}
    assert set(rows[2]) == kept
    classes = brute_classes([(k, r.text) for k, r in rows[2].items()])
    assert set(rows[3]) == set(classes.values())
    words = sum(len(r.text.split()) for r in rows[3].values())
    mixed = sum(len(r.text.split()) for r in steps[4].collect())
    assert abs(mixed - 1.5 * words) < 0.2 * words
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = steps[5].collect()
    assert len(out) == steps[4].count()
    assert all(r.ids == library.encode(rows[3][r.doc_id].text, add_eos=True) for r in out)


def test_pipeline_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, "/root/testdata/sf0.01").select("doc_id")
    long = docs.filter("size(split(text, '[ \\\\t\\\\n]+')) >= 60").join(labels.filter("quality = 1"), "doc_id")
    assert long.join(kept, "doc_id", "left_anti").count() <= 0.05 * long.count()


def test_pipeline_on_an_empty_table(spark, no_docs, tmp_path):
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    no_docs.select(corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_stage_by_row_not_by_id(spark, tmp_path):
    rnd = random.Random(5)

    def fresh(n=120):
        return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))

    a, b, c, d, e, f = (fresh() for _ in range(6))
    near_d, near_e = d + " tail", e + " tail"
    rows = [
        (1, a), (2, a), (2, b),  # id 2: one text rejected, the other its own
        (3, c), (3, c), (3, c),  # a whole row repeated
        (None, d), (None, d), (None, near_d),  # null ids: a copy and a near copy
        (None, a), (None, fresh()), (None, fresh()),  # null id behind a known one; null ids of their own
        (4, e), (5, near_e), (5, f),  # id 5: near copy rejected, the other text stays
        (6, f + " tail"), (7, b.replace(" ", "  ")), (7, b.replace(" ", "\t")),
        (None, None), (8, ""), (9, " "),
    ]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")

    def seen(df):
        return Counter((r.doc_id, r.text) for r in df.collect())

    def squeezed(text):
        return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")

    def order(row):
        return (row[0] is None, row[0] or 0)

    assert seen(corpus_pipeline.exact_dedup(spark, docs.filter("doc_id = 3"), FOLDER)) == {(3, c): 1}
    exact = seen(corpus_pipeline.exact_dedup(spark, docs, FOLDER))
    groups = {}
    for k, t, *_ in rows:
        groups.setdefault(squeezed(t), []).append((k, t))
    assert sum(exact.values()) == len(groups)
    for body, members in groups.items():
        got = [r for r in exact if squeezed(r[1]) == body]
        assert len(got) == 1 and exact[got[0]] == 1
        assert order(got[0]) == min(map(order, members))
    near = seen(corpus_pipeline.near_dedup(spark, docs.filter("trim(text) <> ''"), FOLDER))
    worded = [(k, t) for k, t, *_ in rows if squeezed(t).strip()]
    classes = brute_classes(list(enumerate(t for _, t in worded)))
    assert sum(near.values()) == len(set(classes.values()))
    for root in set(classes.values()):
        members = [worded[i] for i in classes if classes[i] == root]
        got = [r for r in near if r in members]
        assert len(got) == 1 and order(got[0]) == min(map(order, members))
    mixed = seen(corpus_pipeline.mix_sources(spark, docs, FOLDER))
    assert all(r in seen(docs) for r in mixed)
    encoded = corpus_pipeline.encode(spark, docs, FOLDER)
    assert Counter(r.doc_id for r in encoded.collect()) == Counter(k for k, *_ in rows)
    judged = corpus_pipeline.quality_rules(spark, docs, FOLDER)
    assert not seen(judged) - seen(docs)


def test_stages_composed_without_writing(spark):
    """Stages that are only called, called twice, or run side by side read tables that are still there."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, FOLDER)
    once = corpus_pipeline.exact_dedup(spark, kept, FOLDER)
    again = corpus_pipeline.exact_dedup(spark, kept, FOLDER)
    near = corpus_pipeline.near_dedup(spark, once, FOLDER)
    other = corpus_pipeline.run(spark, FOLDER)
    assert kept.count() >= once.count() == again.count() >= near.count() > 0
    mixed = corpus_pipeline.mix_sources(spark, near, FOLDER)
    assert mixed.count() == other.count() > 0
