"""Study statistics on documents with labels, line items and run records."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushlight.operators import study
from rushlight.queries.joins import RUNS, runs
from rushlight.queries.registry import query
from rushlight.queries.views import rounded
from rushlight.session import table


def ranks_sql(source: str) -> str:
    """CTEs ``ranked`` and ``rho_v`` from ``source(signal, id, x, y)``."""
    return f"""ranked AS (SELECT signal, id,
      rank() OVER (PARTITION BY signal ORDER BY x) + (count(*) OVER (PARTITION BY signal, x) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY signal ORDER BY y) + (count(*) OVER (PARTITION BY signal, y) - 1) / 2.0 AS ry FROM {source}),
    sums AS (SELECT signal, count(*) AS n, CAST(sum(rx) AS DOUBLE) AS sx, CAST(sum(ry) AS DOUBLE) AS sy,
      CAST(sum(rx * rx) AS DOUBLE) AS xx, CAST(sum(ry * ry) AS DOUBLE) AS yy, CAST(sum(rx * ry) AS DOUBLE) AS xy
      FROM (SELECT signal, CAST(rx AS DOUBLE) AS rx, CAST(ry AS DOUBLE) AS ry FROM ranked) GROUP BY signal),
    rho_v AS (SELECT *, CASE WHEN sqrt((xx - sx * sx / n) * (yy - sy * sy / n)) > 0
      THEN (xy - sx * sy / n) / sqrt((xx - sx * sx / n) * (yy - sy * sy / n)) ELSE 0.0 END AS rho FROM sums)"""


def _scrambled(value: str, key: str) -> str:
    """``plans.permute._scrambled`` as SQL."""
    mask = "CAST(4294967295 AS UBIGINT)"
    x = f"(({value} * CAST(2654435761 AS UBIGINT) + {key}) & {mask})"
    x = f"((xor({x}, {x} >> 15) * CAST(2246822519 AS UBIGINT)) & {mask})"
    return f"xor({x}, {x} >> 13)"


def permuted_sql(permutations: int) -> str:
    """CTE ``p_v`` with the permutation p-value on top of ``ranks_sql``; needs WITH RECURSIVE."""
    keys = ", ".join(_scrambled(f"(CAST(perm AS UBIGINT) * 8 + {r})", "CAST(1 AS UBIGINT)") for r in range(6))
    step = f"((s & low) << half) | xor(s >> half, {_scrambled('(s & low)', 'k')} & low)"
    network = f"list_reduce(list_concat([{{spot}}], keys), lambda s, k: {step})"
    return f"""placed AS (SELECT signal, CAST(rx AS DOUBLE) AS rx, CAST(ry AS DOUBLE) AS ry,
      CAST(row_number() OVER (PARTITION BY signal ORDER BY id) - 1 AS UBIGINT) AS pos, count(*) OVER (PARTITION BY signal) AS n FROM ranked),
    perms AS (SELECT perm, [{keys}] AS keys FROM range(0, {permutations}) r(perm)),
    sized AS (SELECT signal, CAST(greatest(4, ceil(log2(n) / 2)) AS INT) AS half, n FROM (SELECT DISTINCT signal, n FROM placed)),
    started AS (SELECT p.signal, perm, rx, p.n, pos, keys, half, CAST((1 << half) - 1 AS UBIGINT) AS low FROM placed p JOIN sized USING (signal), perms),
    walked AS (SELECT signal, perm, rx, n, keys, half, low, {network.format(spot="pos")} AS spot FROM started
      UNION ALL SELECT signal, perm, rx, n, keys, half, low, {network.format(spot="spot")} FROM walked WHERE spot >= n),
    crossed AS (SELECT w.signal, perm, sum(w.rx * p.ry) AS xy FROM walked w JOIN placed p ON w.signal = p.signal AND w.spot = p.pos GROUP BY ALL),
    hits AS (SELECT c.signal, count(*) AS extreme FROM crossed c JOIN rho_v r ON c.signal = r.signal
      WHERE abs(CASE WHEN sqrt((xx - sx * sx / n) * (yy - sy * sy / n)) > 0
        THEN (c.xy - sx * sy / n) / sqrt((xx - sx * sx / n) * (yy - sy * sy / n)) ELSE 0.0 END) >= abs(rho) - 1e-12
      GROUP BY 1),
    p_v AS (SELECT r.*, (coalesce(extreme, 0) + 1) / CAST({permutations + 1} AS DOUBLE) AS p_value
      FROM rho_v r LEFT JOIN hits h ON r.signal = h.signal)"""


PAIRS = """pairs AS (SELECT 'chars_quality' AS signal, d.doc_id AS id, CAST(n_chars AS DOUBLE) AS x, CAST(quality AS DOUBLE) AS y
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    UNION ALL SELECT 'chars_toxic', d.doc_id, CAST(n_chars AS DOUBLE), CAST(toxic AS DOUBLE)
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def labelled(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "n_chars", "lang").join(table(spark, folder, "labels"), "doc_id")


def label_pairs(spark, folder):
    each = F.array(
        *[
            F.struct(F.lit(f"chars_{c}").alias("signal"), F.col(c).cast("double").alias("y"))
            for c in ("quality", "toxic")
        ]
    )
    rows = labelled(spark, folder).select(
        F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("x"), F.explode(each).alias("e")
    )
    return rows.select("e.signal", "id", "x", "e.y")


@query(
    "agg21_spearman",
    f"""WITH RECURSIVE {PAIRS}, {ranks_sql("pairs")}, {permuted_sql(10_000)}
    SELECT signal, round(rho, 9) AS rho, round(p_value, 9) AS p_value, n, 10000 AS permutations FROM p_v""",
)
def spearman(spark, folder):
    return rounded(study.spearman(label_pairs(spark, folder)), 9)


@query(
    "agg22_auc",
    f"""WITH a AS (SELECT d.lang, l.quality, rank() OVER (PARTITION BY lang ORDER BY n_chars)
        + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS r
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    s AS (SELECT lang, count(*) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS positives,
      CAST(sum(CASE WHEN quality = 1 THEN r END) AS DOUBLE) AS r FROM a GROUP BY 1)
    SELECT lang, n, positives, CASE WHEN positives > 0 AND n > positives
      THEN round((r - positives * (positives + 1) / 2.0) / (CAST(positives AS DOUBLE) * (n - positives)), 9)
      ELSE CAST('NaN' AS DOUBLE) END AS auc FROM s""",
)
def auc(spark, folder):
    return rounded(study.auc(labelled(spark, folder), "n_chars", "quality", ["lang"]), 9)


@query(
    "agg23_standardise",
    """WITH m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp,
      stddev_pop(l_extendedprice) AS sp FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - mq) / sq, 6) AS l_quantity,
      round((l_extendedprice - mp) / sp, 6) AS l_extendedprice FROM lineitem, m""",
)
def standardise(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return rounded(study.standardise(items, ["l_quantity", "l_extendedprice"]))


@query("agg24_fit_logistic")
def fit_logistic(spark, folder):
    rows = labelled(spark, folder).withColumn("english", (F.col("lang") == "en").cast("int"))
    return rounded(study.fit_logistic(rows, ["n_chars", "english", "toxic"], "quality"))


STUDY = """study AS (SELECT signal, id, x, registered_ratio AS y FROM (
      SELECT capture_id AS id, registered_ratio, unnest(['frames_sampled', 'frames_used', 'vol_median']) AS signal,
        unnest([CAST(frames_sampled AS DOUBLE), CAST(frames_used AS DOUBLE), vol_median]) AS x
      FROM runs_v WHERE pose_status NOT IN ('skipped', 'colmap_missing', 'not_run'))
    WHERE x IS NOT NULL AND registered_ratio IS NOT NULL)"""


@query(
    "agg25_study_correlations",
    f"""WITH RECURSIVE {RUNS}, {STUDY}, {ranks_sql("study")}, {permuted_sql(10_000)}
    SELECT signal, round(rho, 9) AS rho, round(p_value, 9) AS p_value, n, 10000 AS permutations,
      abs(rho) >= 0.40 AS meets_target FROM p_v""",
)
def study_correlations(spark, folder):
    signals = ["frames_sampled", "frames_used", "vol_median"]
    found = study.study_correlations(runs(spark, folder), "registered_ratio", signals, "capture_id")
    return rounded(found, 9)


@query(
    "agg25_study_rho_lineitem",
    f"""WITH items AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS signal,
        (l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS id,
        unnest([l_quantity, l_discount, l_tax]) AS x, l_extendedprice AS y FROM lineitem), {ranks_sql("items")}
    SELECT signal, round(rho, 9) AS rho, n FROM rho_v""",
)
def study_rho(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("id"),
        "l_quantity", "l_discount", "l_tax", "l_extendedprice",
    )
    found = study.study_correlations(rows, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "id", permutations=0)
    return rounded(found.select("signal", "rho", "n"), 9)


@query("agg25_failure_model")
def failure_model(spark, folder):
    return rounded(study.failure_model(runs(spark, folder), ["frames_sampled", "frames_used", "vol_median"]))


@query(
    "agg25_study_caveats",
    f"""WITH {RUNS}, t AS (SELECT count(*) AS total FROM runs_v),
    u AS (SELECT count(*) AS n, count(CASE WHEN registered THEN 1 END) AS registered FROM runs_v
      WHERE pose_status NOT IN ('skipped', 'colmap_missing', 'not_run'))
    SELECT total, n, registered, n - registered AS failed, CASE WHEN total > n THEN 'excluded' END AS caveat FROM t, u""",
)
def study_caveats(spark, folder):
    return study.study_caveats(runs(spark, folder), "registered_ratio")


@query(
    "flt4_usable_runs",
    f"""WITH {RUNS} SELECT capture_id, frames_used FROM runs_v WHERE frames_used IS NOT NULL""",
)
def usable_runs(spark, folder):
    return study.usable_runs(runs(spark, folder), "frames_used").select("capture_id", "frames_used")


@query(
    "flt4_excluded_runs",
    f"""WITH {RUNS} SELECT count(*) AS total, count(CASE WHEN pose_status <> 'not_run' THEN 1 END) AS n,
      count(CASE WHEN pose_status = 'not_run' THEN 1 END) AS excluded FROM runs_v""",
)
def excluded_runs(spark, folder):
    return study.excluded_runs(runs(spark, folder), "images_registered")
