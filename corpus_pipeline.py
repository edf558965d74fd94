"""Corpus pipeline: quality rules, exact dedup, near dedup, mixing to target weights, SentencePiece ids.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage as Parquet and reads it again for the next.
"""

from __future__ import annotations

import sys
import uuid
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import public_tokenizers  # noqa: E402
from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rushlight.llm import darts, exact, mixing, pieces, quality  # noqa: E402
from rushlight.plans.sizing import delete, release, settle, shared_folder, tables_made  # noqa: E402
from rushlight.shipping import ship  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _row_digest() -> Column:
    """Digest of all of a row's columns, each with its length before it, so that only equal rows have equal digests."""
    parts = [F.col(c).cast("string") for c in COLUMNS]
    marked = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*marked).cast("binary"), 256)


def _one_row_each(docs: DataFrame, keys: list[str], stays: DataFrame) -> DataFrame:
    """Of the rows of ``docs`` (with ``keys`` and ``_row``) whose keys, none of them null, are in ``stays`` one row per
    keys: that with the smallest digest. Copies are combined before the shuffle, so no key is hot behind it."""
    row = F.struct("_row", *COLUMNS)
    single = docs.groupBy(*keys).agg(F.min(row).alias("_kept"))
    # the same plan at every size
    return single.join(stays.hint("merge"), keys, "left_semi").select("_kept.*").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs of their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge_quality(docs, labels).filter("kept").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: that with the smallest doc_id (null last), then with the smallest digest of the row."""

    def named(sha: Column) -> list[Column]:
        return [
            F.col("doc_id").isNull().alias("_none"),
            F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
            sha.alias("_sha"),
        ]

    keys = ["_none", "_id", "_sha"]
    with tables_made() as used:
        stays = settle(exact.exact_groups(docs).filter("kept").select(*named(F.col("text_sha256"))).distinct())
    release(spark, used[:-1])  # written: nothing reads the tables any more that led to it
    sha = F.sha2(exact.normalised(F.col("text")).cast("binary"), 256)
    return _one_row_each(docs.select(*named(sha), _row_digest().alias("_row"), *COLUMNS), keys, stays)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every class of near duplicates: that with the smallest doc_id (null last), then the smallest digest."""
    ship(spark)
    # rows go by id and digest, which are never null as a whole: null ids are linked, and two texts of one id are two
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    rows = docs.select(*COLUMNS, _row_digest().alias("_row"))
    with tables_made() as used:
        verdicts = darts.near_duplicates(rows.select("text", place.alias("place")), key="place")
        stays = settle(verdicts.filter("kept").select(F.col("place.row").alias("_row")).distinct())
    release(spark, used[:-1])
    return _one_row_each(rows, ["_row"], stays)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them: none, one or two rows each."""
    mixed = mixing.mix_sources(docs, F.array("source"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    return mixed.select(*COLUMNS, F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document with an end id, and the digest of what they decode to."""
    ship(spark)
    made = pieces.encode_pieces(docs.select("doc_id", "lang", "source", "text"), MODEL)
    return made.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: Thresholds, signatures and subword ids are beyond SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over all before it. Each stage's tables, and the stage before, go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        with tables_made() as used:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        release(spark, used)
        if before:
            delete(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return STAGES[-1][1](spark, docs, sf_dir)
