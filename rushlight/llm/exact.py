"""Exact duplicates through an extendible-hash index on shared files, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rushlight.plans.sizing import settle

WHITE = r"[\x20\x09-\x0D]+"
MAX_DEPTH = 16  # the directory has at most 2^16 slots: its size never depends on the input
BUCKET_KEYS = 1 << 12  # keys a bucket holds before it splits


def normalised(text: Column) -> Column:
    """White space runs as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _slot(key: Column) -> Column:
    """The first ``MAX_DEPTH`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - MAX_DEPTH).cast("int")


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Slot -> bucket of an extendible hash over the distinct keys in column ``key``: rows (slot, bucket, depth).

    A bucket is a prefix of the key. Starting from one bucket for all, every bucket with more than ``bucket_keys`` keys
    splits by its next bit, which doubles the directory; a slot belongs to the first prefix of it that needs no
    split. Counting the keys per slot once and adding the counts up along the prefixes gives the same buckets as
    inserting one key after the other. At ``MAX_DEPTH`` bits a bucket keeps what it has. At most 2^16 rows.
    """
    slots = keys.groupBy(_slot(F.col("key")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    prefixes = slots.select(
        "slot", "n", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth")
    ).withColumn("prefix", F.expr(f"shiftright(slot, {MAX_DEPTH} - depth)"))
    sums = prefixes.groupBy("depth", "prefix").agg(F.sum("n").alias("n"), F.collect_list("slot").alias("slots"))
    done = sums.filter((F.col("n") <= bucket_keys) | (F.col("depth") == MAX_DEPTH))
    first = done.select(F.explode("slots").alias("slot"), "depth").groupBy("slot").agg(F.min("depth").alias("depth"))
    # the bucket's number is its lowest slot, so that buckets follow the order of the keys
    return first.withColumn(
        "bucket", F.expr(f"shiftleft(shiftright(slot, {MAX_DEPTH} - depth), {MAX_DEPTH} - depth)")
    )


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of ``df``: ``key, keep_id, group_size, kept, text_sha256, bucket, chain``.

    Texts are equal when identical after ``normalised``; the smallest key of a group stays (null keys sort last; of
    rows that repeat the kept key itself all count as kept, since nothing tells them apart). Null and empty texts
    are equal to each other. An empty table gives an empty result.

    1. Every row gets a 64-bit hash key and a digest; both go to shared files, without the texts.
    2. Texts are grouped by (key, text): the grouping compares the bytes themselves, and copies are combined before
       the shuffle, so a text that a third of all rows share leaves each task once.
    3. The distinct keys make the directory of an extendible hash. Owner tasks take ranges of buckets and write
       the index: one entry per distinct text, entries of one key chained by their smallest id.
    4. Rows look their entry up by key and digest. Hot keys meet one entry, and adaptive execution splits them.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), normalised(F.col(text)).alias("body"))
    rows = rows.withColumn("key", F.xxhash64("body"))
    sha = F.unhex(F.sha2(F.col("body").cast("binary"), 256))
    digests = settle(rows.select("id", "key", sha.alias("sha")))
    entries = settle(
        rows.groupBy("key", "body")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("key", sha.alias("sha"), "keep_id", "group_size")
    )
    slots = directory(entries.select("key").distinct(), bucket_keys)
    owned = entries.withColumn("slot", _slot(F.col("key"))).join(
        F.broadcast(slots.select("slot", "bucket")), "slot"  # at most 2^16 rows
    )
    chain = W.partitionBy("bucket", "key").orderBy(F.col("keep_id").asc_nulls_last(), "sha")
    index = (
        owned.repartitionByRange("bucket", "key")
        .withColumn("chain", F.row_number().over(chain))
        .select("key", "sha", "keep_id", "group_size", "bucket", "chain")
    )
    index = settle(index)
    found = digests.join(index, ["key", "sha"])
    return found.select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
        "chain",
    )
