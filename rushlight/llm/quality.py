"""Quality rules with risk-controlled thresholds, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushlight.plans.sizing import settle

WHITE = r"[\x20\x09-\x0D]+"
WHITE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Reject when ``measure`` is above a cutoff; ``cutoffs`` run from lenient to strict and are fixed beforehand."""

    name: str
    measure: str
    cutoffs: tuple[float, ...]


#: Shares per word, line or word character of a text.
RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2)),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("capitals", "n_capitals / greatest(word_chars, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    Rule("marks", "n_marks / greatest(n_words, 1)", (2.0, 1.5, 1.0, 0.75, 0.5)),
)


def words_of(text: Column) -> Column:
    """Runs of characters other than the six ASCII white spaces; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measure_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules read, one row in, one row out, no shuffle.

    ``n_words, word_chars, n_symbols, n_lines`` (lines with a word)``, n_dup_lines`` (of these, equal to an earlier
    one)``, n_repeat_words`` (words inside three-word windows that the text has twice or more, first ones included)``,
    n_capitals, n_marks`` (``!`` and ``?``). A null or empty text has 0 everywhere. Windows are compared by sorting
    their hashes with their places, so a text costs n log n whatever it repeats.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.length(F.translate(line, WHITE_CHARS, "")) > 0)
    kept = df.columns
    # generated columns are computed once: no filter moves below them and no lambda repeats an outer array
    parts = F.struct(words_of(body).alias("words"), lines.alias("lines"), F.translate(body, WHITE_CHARS, "").alias("solid"))
    step = df.select("*", F.inline(F.array(parts)).alias("_words", "_lines", "_solid"))
    windows = F.transform(
        F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.struct(
            F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")
        ),
    )
    step = step.select("*", F.explode(F.array(F.sort_array(windows))).alias("_windows"))
    again = F.filter(
        "_windows",
        lambda w, at: (w["h"] == F.get("_windows", at - 1)["h"]) | (w["h"] == F.get("_windows", at + 1)["h"]),
    )
    step = step.select("*", F.explode(F.array(F.sort_array(F.transform(again, lambda w: w["i"])))).alias("_again"))
    covered = F.aggregate(
        "_again",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    solid = F.col("_solid")
    return step.select(
        *[F.col(f"`{c}`") for c in kept],
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(solid).cast("bigint").alias("word_chars"),
        (F.length(solid) - _without(solid, SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.regexp_count(solid, F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
        (F.length(solid) - _without(solid, "!?")).cast("bigint").alias("n_marks"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def risk_bound(n: Column, k: Column, risk: float) -> Column:
    """P(Binomial(n, risk) <= k): the exact tail, summed from its largest term downwards in logarithms.

    Small means that a true false-rejection rate of ``risk`` or more is refuted. Called with k < n * risk, where every
    term is smaller than the one before, so nothing under- or overflows that matters.
    """
    log_choose = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")),
        F.lit(0.0),
        lambda acc, j: acc + F.log((n - k + j) / j),
    )
    top = log_choose + k * F.log(F.lit(risk)) + (n - k) * F.log(F.lit(1 - risk))
    tail = F.aggregate(
        F.when(k > 0, F.sequence(k, F.lit(1).cast("bigint"), F.lit(-1).cast("bigint"))).otherwise(
            F.array().cast("array<bigint>")
        ),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, i: F.struct(
            (acc["sum"] + acc["term"] * (i / (n - i + 1)) * ((1 - risk) / risk)).alias("sum"),
            (acc["term"] * (i / (n - i + 1)) * ((1 - risk) / risk)).alias("term"),
        ),
        lambda acc: F.log(acc["sum"]),
    )
    return F.exp(top + tail)


def fit_cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    stratum: str = "lang",
    label: str = "quality",
    rules: tuple[Rule, ...] = RULES,
    max_false_rejection: float = 0.05,
    confidence: float = 0.95,
) -> DataFrame:
    """Strictest safe cutoff of every rule in every stratum: rows (stratum, rule, cutoff).

    Good labelled rows (``label`` = 1) that pass the base rules are the holdout. The share a rule may wrongly reject
    is ``max_false_rejection`` / number of rules, so all rules together stay below ``max_false_rejection`` per
    stratum. Cutoffs of a rule are tested from lenient to strict, each with the exact binomial tail, and the walk
    stops at the first that fails (fixed-sequence testing); the chains, one per rule and stratum, share the error
    1 - ``confidence`` evenly. So with that confidence every stratum keeps its bound at once.

    Strata without enough good rows to prove anything get no cutoff and keep all. A null stratum is a stratum of its
    own; rows with null labels or labelled twice with differing values count as often as they occur. All labelled
    rows count; only the table of (stratum, rule, cutoff) counts is small, and it is joined, not collected.
    """
    good = labels.filter(F.col(label) == 1).select(F.col(key))
    tests = [F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("place"), F.lit(float(c)).alias("cutoff"),
                      (F.expr(r.measure) > c).cast("bigint").alias("hit"))
             for r in rules for i, c in enumerate(r.cutoffs)]
    each = measured.filter(~base_failed()).join(good, key).select(F.col(stratum).alias("stratum"), F.array(*tests).alias("t"))
    # sums of fixed columns first: one row per stratum and task leaves the map side
    flat = settle(
        each.groupBy("stratum").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.col("t")[i]["hit"]).alias(f"k{i}") for i in range(len(tests))]
        )
    )
    counted = flat.select(
        "stratum",
        "n",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(r.name).alias("rule"), F.lit(i).alias("place"), F.lit(float(c)).alias("cutoff"),
                             F.col(f"k{at}").alias("k"))
                    for at, (r, i, c) in enumerate((r, i, c) for r in rules for i, c in enumerate(r.cutoffs))
                ]
            )
        ).alias("t"),
    ).select("stratum", "n", "t.*")
    risk = max_false_rejection / len(rules)
    level = (1 - confidence) / max(flat.count() * len(rules), 1)  # one chain per stratum and rule
    judged = counted.withColumn(
        "safe",
        F.when(F.col("k") < F.col("n") * risk, risk_bound(F.col("n"), F.col("k"), risk) <= level).otherwise(False),
    )
    # strictest of the leading safe ones: hits only grow along a chain, so a failure is followed by failures
    stop = F.coalesce(F.min(F.when(~F.col("safe"), F.col("place"))), F.lit(1 << 20)).alias("stop")
    ends = judged.groupBy("stratum", "rule").agg(stop, F.collect_list(F.struct("place", "cutoff")).alias("walk"))
    best = F.array_max(F.filter("walk", lambda w: w["place"] < F.col("stop")))
    return ends.withColumn("best", best).filter(F.col("best").isNotNull()).select(
        "stratum", "rule", F.col("best.cutoff").alias("cutoff")
    )


def judge_quality(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    label: str = "quality",
    rules: tuple[Rule, ...] = RULES,
    max_false_rejection: float = 0.05,
    confidence: float = 0.95,
    carry: list[str] | None = None,
) -> DataFrame:
    """``df`` (or its columns ``carry``) with its counts, ``base_failed``, ``failed_rules`` (names) and ``kept``.

    ``kept`` is false for rows that fail the base rules or exceed a safe cutoff of their stratum (``fit_cutoffs``).
    Null and empty texts fail the base rules. Repeated rows and ids each get their verdict; a null id is judged too
    (it matches no label). Columns of ``df`` with the names of added ones are replaced.

    Texts are read once and counted where they lie; the counts go to shared files, and only counts are shuffled.
    """
    added = "n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words n_capitals n_marks base_failed failed_rules kept".split()
    names = [c for c in df.columns if c.lower() not in added]
    inner = {c.lower(): f"in_{i}" for i, c in enumerate(names)}  # names of the caller meet none of those below
    wanted = [c for c in names if carry is None or c in carry]
    used = {inner[c.lower()] for c in [*wanted, key, stratum]}
    counted = measure_texts(df.select(*[F.col(f"`{c}`").alias(inner[c.lower()]) for c in names]), inner[text.lower()])
    measured = settle(counted.select(*[c for c in counted.columns if c in used or c in added]))
    stratum = inner[stratum.lower()]
    cutoffs = fit_cutoffs(
        measured, labels.withColumnRenamed(key, inner[key.lower()]), inner[key.lower()], stratum, label, rules, max_false_rejection, confidence
    )
    # one row per stratum with its cutoffs, at most as many as there are strata
    table = cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut"))
    joined = measured.join(table, F.col(stratum).eqNullSafe(F.col("_stratum")), "left").drop("_stratum")
    failed = [
        F.when(F.expr(r.measure) > F.try_element_at("_cut", F.lit(r.name)), F.lit(r.name)) for r in rules
    ]
    joined = joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.array_compact(F.array(*failed)))
    made = joined.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return made.select(*[F.col(inner[c.lower()]).alias(c) for c in wanted], *added)
