"""Registered queries: contract columns, SQL where there is any, and the tables they read whole."""

import pytest
from oracle import compare, duck

from rushlight.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "page_id bigint, url string, text string, n_chars bigint",
    "op2": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op3": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op4": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6": "doc_id bigint, class_id bigint",
    "op7": "page_id bigint, host string, path string, rule string, verdict string",
    "op8": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op9": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op11": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op13": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
    "op10": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    made = QUERIES[name](spark, FOLDER)
    kinds = dict(made.dtypes)
    for column in COLUMNS[name.split("_")[0]].split(", "):
        who, what = column.split()
        assert kinds[who] == what
    if name.split("_")[0] in ("op11", "op13"):
        rows = made.count()
        assert rows > 0
    source = {"op1": "pages", "op7": "pages"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{FOLDER}/{source}.parquet").count()
    if name.startswith("op3"):
        rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").distinct().count() + 1
    if name.split("_")[0] not in ("op11", "op13"):
        assert made.count() == rows
    if name in SQL:
        assert compare(spark, duck(FOLDER), name, QUERIES[name], SQL[name], FOLDER) == ""


def test_the_entry_serves_them(spark):
    import __spark_entry__

    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
