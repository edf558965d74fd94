"""URL verdicts from rules and from trust that flows over the host graph, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushlight.plans.sizing import planned_once, settle

DAMPING = 0.85
TOLERANCE = 1e-6  # largest share of its score that a host may still gain in ROUNDS_A_TABLE rounds
ROUNDS_A_TABLE = 6  # rounds between two written tables
RATIO = 2.0  # a host is blocked where its distrust exceeds RATIO times its trust


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The fixed rules of the query, as given.
RULES = (
    UrlRule("org", "/", "allow"),
    UrlRule("example.org", "/es/", "block"),
    UrlRule("example.org", "/en/1", "block"),
    UrlRule("com", "/fr/", "allow"),
    UrlRule("com", "/de/", "block"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what lies between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; then
    what comes up to ``?``, ``#`` or the end. Both empty for null and for what has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def match_rules(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, by its text's length; null where none does.

    Rules are a fixed, small list, so they are one CASE expression, longest first.
    """
    rule = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, r.text) if rule is None else rule.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return rule, verdict


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """Weighted edges (src, dst, weight) between different hosts.

    Every absolute link in a page's ``href`` or ``src`` is an edge from the page's host, counted once per page and
    target host. Counts are combined before the shuffle.
    """
    links = F.array_distinct(
        F.transform(
            F.regexp_extract_all(
                F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""), F.lit(1)
            ),
            lambda h: F.lower(h),
        )
    )
    linked = (
        pages.filter(F.col(host) != "")
        .select(F.col(host).alias("src"), F.explode(links).alias("dst"))
        .filter(F.col("src") != F.col("dst"))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    return linked


def parent_domains(host: Column) -> Column:
    """All parent domains of a host that have two labels at least, nearest first."""
    labels = F.split(host, r"\.")
    last = F.size(labels) - 1
    places = F.when(last >= 2, F.sequence(F.lit(2), F.greatest(last, F.lit(2)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def parent_edges(hosts: DataFrame) -> DataFrame:
    """Edges of weight 1 between every host and all its parent domains, both ways, since one owner answers for both.
    Parents that are no known host are hosts too."""
    every = hosts.select("host").union(hosts.select(F.explode(parent_domains(F.col("host"))))).distinct()
    up = every.select(F.col("host").alias("src"), F.explode(parent_domains(F.col("host"))).alias("dst")).filter("src <> dst")
    return up.union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("weight", F.lit(1.0))


def personalised_rank(
    edges: DataFrame,
    seeds: DataFrame,
    damping: float = DAMPING,
    rounds: int | None = None,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(kind, host, score): personalised PageRank from ``seeds`` (kind, host, mass) over ``edges`` (kind, src, dst, weight),
    for every kind by itself; scores of a kind add up to 1, hosts that are not reached have no row.

    Each round a host passes ``damping`` of its score on by its edges' weights, and the seeds get the rest. What hosts
    without edges would pass on returns to the seeds: that only scales all scores, so it is done once at the end. Scores
    begin with the seeds' own part and only grow. Rounds go on until no host gained more than ``tolerance`` of its own
    score in the last ``ROUNDS_A_TABLE`` (one number a kind), so hosts far from all seeds are reached and settled as the
    near ones are; ``rounds``, if given, ends them earlier. A round is one join of edges and scores and one sum, combined
    before its shuffle; every ``ROUNDS_A_TABLE`` rounds are written to shared files, which a lost executor costs at most.
    They are one job, planned once: planning them anew after every stage would fill the driver with plans.
    """
    outs = edges.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    share = settle(edges.join(outs, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    size = share.count()
    masses = seeds.groupBy("kind").agg(F.sum("mass").alias("all"))
    start = settle(
        seeds.groupBy("kind", "host").agg(F.sum("mass").alias("mass")).join(F.broadcast(masses), "kind")  # a row per kind
        .select("kind", "host", (F.col("mass") / F.col("all")).alias("score"))
    )
    fresh = start.withColumn("score", F.lit(1 - damping) * F.col("score"))
    scores, done, gain = fresh, 0, 1.0
    while gain > tolerance and (rounds is None or done < rounds):
        turns = ROUNDS_A_TABLE if rounds is None else min(ROUNDS_A_TABLE, rounds - done)
        before = scores.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("before"))
        for _ in range(turns):
            moved = share.join(scores.withColumnRenamed("host", "src"), ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), (F.lit(damping) * F.col("score") * F.col("share")).alias("score")
            )
            parts = moved.union(fresh)
            scores = parts.groupBy("kind", "host").agg(F.sum("score").alias("score"))
        last = parts.withColumn("before", F.lit(0.0)).union(before)
        with planned_once(edges.sparkSession, size):
            both = settle(last.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("before").alias("before")))
            gains = both.filter("score > 0").groupBy("kind").agg(F.max((F.col("score") - F.col("before")) / F.col("score")).alias("gain"))
            gain = max([r["gain"] for r in gains.collect()], default=0.0)
        scores, done = both.select("kind", "host", "score"), done + turns
    sums = scores.groupBy("kind").agg(F.sum("score").alias("all"))
    return scores.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("score") / F.col("all")).alias("score"))


def judge_urls(
    pages: DataFrame,
    rules: tuple[UrlRule, ...] = RULES,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    damping: float = DAMPING,
    rounds: int | None = None,
    ratio: float = RATIO,
) -> DataFrame:
    """One row per row of ``pages``: ``key, host, path, rule, verdict, trust, distrust``.

    Urls under a rule have its verdict. The others are judged by host: trust is the personalised PageRank from hosts
    with allowed pages (as much mass as they have such pages), along the host edges; distrust is the one from hosts with
    blocked pages along the reversed edges, since who links to blocked hosts is suspect. A host is blocked where its
    distrust exceeds ``ratio`` times its trust.

    Urls without ``://`` and null urls have an empty host and path, no rule and the verdict allow, as have hosts that
    neither score reaches. Null html has no links. Repeated rows and ids each get a row. A host with a third of all pages
    is one row once pages are counted per host; the last join meets it with one score and is split by adaptive
    execution.
    """
    host, path = split_url(F.col(url))
    split = pages.select(F.col(key), host.alias("host"), path.alias("path"), F.col(html).alias("_html"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    judged = split.select(key, "host", "path", rule.alias("rule"), verdict.alias("by_rule"), "_html")
    seeds = settle(
        judged.filter(F.col("host") != "").groupBy("host").agg(
            F.count(F.when(F.col("by_rule") == "allow", 1)).cast("double").alias("allowed"),
            F.count(F.when(F.col("by_rule") == "block", 1)).cast("double").alias("blocked"),
        )
    )
    linked = settle(host_edges(split, "host", "_html"))
    known = settle(seeds.select("host").union(linked.select(F.col("dst").alias("host"))).distinct())
    edges = settle(linked.union(parent_edges(known)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(
        edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "weight")
    )
    masses = seeds.select(F.lit("trust").alias("kind"), "host", F.col("allowed").alias("mass")).union(
        seeds.select(F.lit("distrust"), "host", "blocked")
    )
    ranks = personalised_rank(both, masses.filter("mass > 0"), damping, rounds)
    scores = ranks.groupBy("host").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")]
    )
    blocked = F.coalesce(F.col("distrust") > ratio * F.col("trust"), F.lit(False))
    return judged.drop("_html").join(scores, "host", "left").select(
        key, "host", "path", "rule",
        F.coalesce("by_rule", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
