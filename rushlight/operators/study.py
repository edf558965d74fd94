"""Does a telemetry signal predict the outcome? Rank correlation, AUC and a penalised logit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rushlight.operators.robust import as_number, is_finite
from rushlight.plans.permute import places, round_keys
from rushlight.plans.quantiles import average_rank
from rushlight.plans.sizing import fits_one_task, settle, small
from rushlight.plans.timeline import Timeline

# Pre-registered targets, outcomes that need a pose stage, states without one.
TARGET_RHO = 0.40
TARGET_AUC = 0.80
LEAST_FOR_A_CLAIM = 30
LEAST_FOR_STATISTICS = 3
POSE_OUTCOMES = ("registered", "registered_ratio", "images_registered", "sparse_points", "seconds_pose")
NO_POSE = ("skipped", "colmap_missing", "not_run")
SEPARABLE_FROM = 1.0 - 1e-12
RANK_BLOCK = 1 << 18  # ranks of a block
RIGHT_BLOCKS = 16  # blocks that permuted ranks of one block are looked up in at once
PERM_CHUNK = 500  # permutations of a unit of work
UNIT_TASKS = 4096  # units beyond these share tasks


def usable_runs(rows: DataFrame, outcome: str) -> DataFrame:
    """Runs an outcome can be read from: posed runs for pose outcomes, finite values otherwise."""
    if outcome in POSE_OUTCOMES:
        return rows.filter(F.col("pose_status").isNull() | ~F.col("pose_status").isin(*NO_POSE))
    return rows.filter(is_finite(as_number(outcome, dict(rows.dtypes)[outcome])))


def excluded_runs(rows: DataFrame, outcome: str) -> DataFrame:
    """How many runs ``usable_runs`` leaves out; a caveat when positive."""
    usable = usable_runs(rows.withColumn("_all", F.lit(1)), outcome)
    kept = usable.agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    total = rows.agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("one"))
    return total.join(kept, "one").select("total", "n", (F.col("total") - F.col("n")).alias("excluded"))


def unpivot(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns to ``signal, x`` rows; non-numbers become NULL."""
    kinds = dict(rows.dtypes)
    each = F.array(*[F.struct(F.lit(c).alias("signal"), as_number(c, kinds[c]).alias("x")) for c in columns])
    return rows.select(*keys, F.explode(each).alias("_s")).select(*keys, "_s.signal", "_s.x")


def _rho(cross: Column, n: Column, sum_x: Column, sum_y: Column, xx: Column, yy: Column) -> Column:
    spread = F.sqrt((xx - sum_x * sum_x / n) * (yy - sum_y * sum_y / n))
    return F.when(spread > 0, (cross - sum_x * sum_y / n) / spread).otherwise(F.lit(0.0))


def _crossed(permutations: int, seed: int, block: int):
    """(signal, perm, cross): sums of products of one block of ranks with the permuted ranks that fall into another."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in range(len(batch)):
                one = {c: batch[c][unit] for c in batch.schema.names}
                n, rx, ry = one["n"].as_py(), one["rx"].values.to_numpy(), one["ry"].values.to_numpy()
                first, begin = one["left"].as_py() * block, one["right"].as_py() * block * RIGHT_BLOCKS
                numbers = np.arange(one["chunk"].as_py() * PERM_CHUNK, min((one["chunk"].as_py() + 1) * PERM_CHUNK, permutations))
                keys, cross = round_keys(seed, numbers), np.empty(len(numbers))
                together = max(1, (1 << 18) // len(rx))
                for low in range(0, len(numbers), together):
                    to = places(n, keys[low : low + together], first + np.arange(len(rx))) - begin
                    if len(ry) == n:
                        cross[low : low + together] = ry[to] @ rx
                        continue
                    here = (to >= 0) & (to < len(ry))
                    cross[low : low + together] = (np.where(here, ry[np.where(here, to, 0)], 0.0) * rx).sum(1)
                yield pa.record_batch({"signal": pa.array([one["signal"].as_py()] * len(numbers)), "perm": pa.array(numbers), "cross": pa.array(cross)})

    return walk


def _rank_sums(finite: DataFrame, signal: str) -> DataFrame:
    """Per signal the number of rows and the sums of ranks, their squares and products, from counted values: no row is sorted.

    The ranks of ``x`` come from the counts of its values and are summed per value of ``y``, so that what is shuffled is
    distinct values, already combined where they are read.
    """
    def placed(counted: DataFrame, column: str) -> DataFrame:
        upto = Timeline.measure(counted, [signal], column).running(counted, {"_upto": ("sum", F.col("_n"))})
        return upto.withColumn("_rank", F.col("_upto") - (F.col("_n") - 1) / 2.0)

    n, rank = F.col("_n"), F.col("_rank")
    by_x = settle(placed(settle(finite.groupBy(signal, "x").agg(F.count(F.lit(1)).alias("_n"))), "x"))
    x_sums = by_x.groupBy(signal).agg(F.sum("_n").alias("n"), F.sum(n * rank).alias("_sx"), F.sum(n * rank * rank).alias("_xx"))
    ranked = finite.select(signal, "x", "y").join(small(by_x.select(signal, "x", "_rank")), [signal, "x"])
    by_y = settle(ranked.groupBy(signal, "y").agg(F.count(F.lit(1)).alias("_n"), F.sum("_rank").alias("_rx")))
    y_sums = placed(by_y, "y").groupBy(signal).agg(
        F.sum(n * rank).alias("_sy"), F.sum(n * rank * rank).alias("_yy"), F.sum(F.col("_rx") * rank).alias("_xy")
    )
    return x_sums.join(y_sums, signal)


def spearman(
    pairs: DataFrame,
    permutations: int = 10_000,
    seed: int = 0,
    signal: str = "signal",
    row_id: str = "id",
    rank_block: int = RANK_BLOCK,
) -> DataFrame:
    """Rank correlation of ``x`` and ``y`` per signal with a two-sided permutation p-value.

    A permutation is a keyed network over row places (``plans.permute``), so tasks know where it sends a row without
    sorting or moving anything, and p-values are the same on every run and any cluster size. Ranks lie in blocks of
    ``rank_block`` places; a unit of work multiplies one block by the permuted places of ``RIGHT_BLOCKS`` others for
    ``PERM_CHUNK`` permutations at once. What is shuffled is the blocks and one number per unit and permutation.
    """
    finite = pairs.filter(is_finite(F.col("x")) & is_finite(F.col("y")))
    if permutations:
        # read several times below: written once, so the runs behind it are not recomputed
        finite = settle(finite.select(signal, row_id, "x", "y"))
        whole = fits_one_task(finite, [signal])
        ranked = average_rank(average_rank(finite, [signal], "x", "rx", fits=whole), [signal], "y", "ry", fits=whole).select(
            signal, row_id, "rx", "ry"
        )
        x, y = F.col("rx"), F.col("ry")
        observed = ranked.groupBy(signal).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(x).alias("_sx"),
            F.sum(y).alias("_sy"),
            F.sum(x * x).alias("_xx"),
            F.sum(y * y).alias("_yy"),
            F.sum(x * y).alias("_xy"),
        )
    else:
        observed = _rank_sums(finite, signal)

    def rho_of(cross: str) -> Column:
        return _rho(*[F.col(c) for c in (cross, "n", "_sx", "_sy", "_xx", "_yy")])

    observed = observed.withColumn("rho", rho_of("_xy"))
    if permutations:
        observed = settle(observed)
        line = Timeline((signal,), row_id) if whole else Timeline.measure(ranked, [signal], row_id)
        placed = line.number(ranked, "_pos").withColumn("_block", F.floor((F.col("_pos") - 1) / rank_block))
        in_order = F.array_sort(F.collect_list(F.struct("_pos", "rx", "ry")))
        blocks = settle(
            placed.groupBy(signal, "_block").agg(in_order.alias("_r")).select(signal, "_block", F.col("_r.rx").alias("rx"), F.col("_r.ry").alias("ry"))
        )
        chunks = F.explode(F.sequence(F.lit(0), F.lit((permutations - 1) // PERM_CHUNK))).alias("chunk")
        # a place is worked out once for all blocks on the right, while they are no more than RIGHT_BLOCKS
        beside = blocks.groupBy(signal, F.floor(F.col("_block") / RIGHT_BLOCKS).alias("right")).agg(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_block", "ry"))), lambda b: b["ry"])).alias("ry")
        )
        units = (
            blocks.select(signal, F.col("_block").alias("left"), "rx")
            .join(beside, signal)
            .join(observed.select(signal, "n"), signal)
            .select(F.col(signal).alias("signal"), "n", "left", "right", "rx", "ry", chunks)
        )
        kind = dict(pairs.dtypes)[signal]
        # few blocks in one batch: each may be large
        spread = max(1, min(units.drop("rx", "ry").count(), UNIT_TASKS))
        null = units.repartition(spread).mapInArrow(_crossed(permutations, seed, rank_block), f"signal {kind}, perm bigint, cross double")
        null = null.groupBy(F.col("signal").alias(signal), "perm").agg(F.sum("cross").alias("_cross"))
        extreme = (
            null.join(observed, signal)
            .filter(F.abs(rho_of("_cross")) >= F.abs("rho") - 1e-12)
            .groupBy(signal)
            .agg(F.count(F.lit(1)).alias("_extreme"))
        )
        observed = observed.join(extreme, signal, "left")
    else:
        observed = observed.withColumn("_extreme", F.lit(0))
    enough = F.col("n") >= LEAST_FOR_STATISTICS
    p = (F.coalesce("_extreme", F.lit(0)) + 1) / F.lit(float(permutations + 1))
    return observed.select(
        signal,
        F.when(enough, F.col("rho")).otherwise(0.0).alias("rho"),
        F.when(enough, p).otherwise(1.0).alias("p_value"),
        "n",
        F.when(enough, permutations).otherwise(0).alias("permutations"),
    )


def auc(df: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve per key from average ranks; NaN with one class only.

    Scores are counted per distinct value first, so ties and hot keys cost nothing.
    """
    keys = keys or []
    anyway = keys or ["_one"]
    base = df if keys else df.withColumn("_one", F.lit(1))
    counted = base.groupBy(*anyway, F.col(score).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == 1).alias("_p")
    )
    line = Timeline.measure(counted, anyway, "_v")
    ranked = line.running(counted, {"_upto": ("sum", F.col("_n"))})
    mean_rank = F.col("_upto") - (F.col("_n") - 1) / 2.0
    summed = ranked.groupBy(*anyway).agg(
        F.sum(mean_rank * F.col("_p")).alias("_r"), F.sum("_p").alias("positives"), F.sum("_n").alias("n")
    )
    pos = F.col("positives").cast("double")
    neg = F.col("n") - pos
    area = F.when((pos > 0) & (neg > 0), (F.col("_r") - pos * (pos + 1) / 2) / (pos * neg)).otherwise(F.lit(float("nan")))
    return summed.select(*keys, area.alias("auc"), "n", "positives")


def column_moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, population std) of each column: one row, two numbers per column."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0) for c in columns}


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Centre and scale; constant columns are only centred."""
    moments = column_moments(df, columns)
    made = {c: (F.col(c) - F.lit(m)) / F.lit(s if s != 0 else 1.0) for c, (m, s) in moments.items()}
    return df.withColumns(made)


def fit_logistic(
    df: DataFrame, features: list[str], label: str, l2: float = 1.0, max_iterations: int = 100, tolerance: float = 1e-8
) -> DataFrame:
    """Penalised logistic fit; one distributed sum of the gradient and curvature per iteration.

    Returns one row per term (intercept included) in the signals' own units, with the fit's
    metrics repeated. Only (k+1)^2 sums reach the driver.
    """
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    data = df.select(
        *[as_number(f, kinds[f]).alias(f"x{i}") for i, f in enumerate(features)], as_number(label, kinds[label]).alias("y")
    )
    for name in data.columns:
        data = data.filter(is_finite(F.col(name)))
    k = len(features)
    data = data.persist()
    try:
        size = data.agg(F.count(F.lit(1)), F.sum("y"), F.count_distinct("y")).first()
        n, positives, classes = size[0], int(size[1] or 0), size[2]
        schema = (
            "term string, coefficient double, auc double, accuracy double, n long, positives long, "
            "converged boolean, separable boolean, note string"
        )
        nan = float("nan")
        if classes < 2:
            note = "one_class"
            rows = [(t, 0.0, nan, nan, n, positives, False, False, note) for t in ["intercept", *features]]
            return spark.createDataFrame(rows, schema)

        moments = column_moments(data, [f"x{i}" for i in range(k)])
        means = np.array([moments[f"x{i}"][0] for i in range(k)])
        scales = np.array([moments[f"x{i}"][1] or 1.0 for i in range(k)])
        design = [F.lit(1.0)] + [(F.col(f"x{i}") - F.lit(float(means[i]))) / F.lit(float(scales[i])) for i in range(k)]
        penalty = l2 * np.diag([0.0] + [1.0] * k)

        def probability(beta: np.ndarray) -> Column:
            eta = sum((F.lit(float(b)) * d for b, d in zip(beta[1:], design[1:], strict=True)), F.lit(float(beta[0])))
            return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))))

        beta, converged, notes = np.zeros(k + 1), False, []
        pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        for _ in range(max_iterations):
            scored = data.withColumn("_p", probability(beta))
            p = F.col("_p")
            weight = F.greatest(p * (1 - p), F.lit(1e-9))
            sums = scored.agg(
                *[F.sum(design[i] * (F.col("y") - p)) for i in range(k + 1)],
                *[F.sum(weight * design[i] * design[j]) for i, j in pairs],
            ).first()
            gradient = np.array(sums[: k + 1]) - penalty @ beta
            hessian = penalty.copy()
            for (i, j), value in zip(pairs, sums[k + 1 :], strict=True):
                hessian[i, j] += value
                if i != j:
                    hessian[j, i] += value
            try:
                step = np.linalg.solve(hessian, gradient)
            except np.linalg.LinAlgError:
                notes.append("singular")
                break
            beta = beta + step
            if np.max(np.abs(step)) < tolerance:
                converged = True
                break

        fitted = data.withColumn("_p", probability(beta))
        hit = (F.col("_p") >= 0.5).cast("double") == F.col("y")
        accuracy = fitted.agg(F.avg(hit.cast("double"))).first()[0]
        area = auc(fitted.withColumn("_label", F.col("y").cast("int")), "_p", "_label").first()["auc"]
    finally:
        data.unpersist()
    separable = bool(area >= SEPARABLE_FROM)
    if separable:
        notes.append("separable")
    raw = beta[1:] / scales
    intercept = float(beta[0] - np.sum(beta[1:] * means / scales))
    terms = [("intercept", intercept), *zip(features, raw.tolist(), strict=True)]
    note = "; ".join(notes) or None
    return spark.createDataFrame(
        [(t, float(c), float(area), float(accuracy), n, positives, converged, separable, note) for t, c in terms], schema
    )


def study_correlations(
    rows: DataFrame, outcome: str, signals: list[str], row_id: str, permutations: int = 10_000, seed: int = 0
) -> DataFrame:
    """Every signal that varies against the outcome, strongest first."""
    usable = usable_runs(rows, outcome)
    kinds = dict(rows.dtypes)
    long = unpivot(usable.withColumn("y", as_number(outcome, kinds[outcome])), [row_id, "y"], signals)
    spread = long.groupBy("signal").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi")).filter("_lo < _hi")
    varied = long.join(small(spread.select("signal")), "signal", "left_semi")  # one row per signal column
    found = spearman(varied.withColumnRenamed(row_id, "id"), permutations, seed)
    return found.withColumn("meets_target", F.abs("rho") >= TARGET_RHO).orderBy(F.abs("rho").desc(), "signal")


def failure_model(rows: DataFrame, signals: list[str], l2: float = 1.0) -> DataFrame:
    """Penalised logit of failure (1: the pose stage ran and did not register) on all signals that vary.

    The terms of ``fit_logistic`` with ``meets_target``: whether the area under the curve reaches its pre-registered
    target. Runs without a pose stage say nothing about failure and are left out; with one class the
    note says so and nothing meets a target. Signals that do not vary have no term.
    """
    posed = rows.filter(F.coalesce(~F.col("pose_status").isin(*NO_POSE), F.lit(True)))
    failed = posed.withColumn("failed", F.when(F.coalesce("registered", F.lit(False)), 0).otherwise(1))
    kinds = dict(rows.dtypes)
    bounds = failed.agg(
        *[f(F.when(is_finite(as_number(c, kinds[c])), as_number(c, kinds[c]))).alias(f"{n}_{c}") for c in signals for n, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    varied = [c for c in signals if bounds[f"lo_{c}"] is not None and bounds[f"lo_{c}"] < bounds[f"hi_{c}"]]
    fitted = fit_logistic(failed, varied, "failed", l2=l2)
    return fitted.withColumn("meets_target", ~F.isnan("auc") & (F.col("auc") >= TARGET_AUC))


def study_caveats(rows: DataFrame, outcome: str) -> DataFrame:
    """Caveat rows for a study: excluded runs, few captures, a single outcome class."""
    usable = usable_runs(rows, outcome)
    # NULL and text states count as posed: only the listed states have no pose stage
    has_pose = F.coalesce(~F.col("pose_status").isin(*NO_POSE), F.lit(True))
    posed = usable.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(has_pose).alias("posed"),
        F.count_if(has_pose & F.coalesce("registered", F.lit(False))).alias("registered"),
        F.lit(1).alias("one"),
    )
    total = rows.agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("one"))
    c = F.col
    one_class = (c("n") >= LEAST_FOR_STATISTICS) & (c("posed") > 0) & ((c("registered") == 0) | (c("registered") == c("posed")))
    picks = F.array_compact(
        F.array(
            F.when(c("total") > c("n"), "excluded"),
            F.when(c("n") < LEAST_FOR_STATISTICS, "no_statistics"),
            F.when((c("n") >= LEAST_FOR_STATISTICS) & (c("posed") == 0), "no_pose"),
            F.when(one_class, "one_class"),
            F.when((c("n") >= LEAST_FOR_STATISTICS) & (c("n") < LEAST_FOR_A_CLAIM), "too_few"),
        )
    )
    return total.join(posed, "one").select(
        "total", "n", "registered", (c("posed") - c("registered")).alias("failed"), F.explode_outer(picks).alias("caveat")
    )
