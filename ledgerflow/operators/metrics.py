"""Ranking metrics and result summaries. Scores are counted per distinct value first, and
their running sums are bucketed, so no metric sorts a population in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.ranks import BUCKET_BITS, number_rows, running_totals, value_bucketed
from ledgerflow.sources.readers import materialise

# The reported top shares.
TOP_FRACTIONS = (0.01, 0.05, 0.10)


def cumulative_confusion(df: DataFrame, y: str, score: str, by: Sequence[str], bits: int = BUCKET_BITS) -> DataFrame:
    """(by, score, p, n, tp, fp) along falling score; rows with equal scores are one step. The steps
    are written once and read by each pass over them; ``2**bits`` tasks share their order."""
    steps = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(y).cast("bigint")).alias("p"), F.count(F.lit(1)).alias("n")
    ).withColumn("n", F.col("n") - F.col("p"))
    return running_totals(
        value_bucketed(materialise(steps), "score", bits), list(by), [F.desc("score")], {"tp": "p", "fp": "n"}, descending=True
    )


def ranking_metrics(
    df: DataFrame, y: str, score: str, by: Sequence[str], strict: bool = False, bits: int = BUCKET_BITS
) -> DataFrame:
    """ROC-AUC with ties at half, and step-wise average precision, per group. One class
    only: NULL metrics and ``status`` ONE_CLASS, or an error when ``strict``."""
    c = cumulative_confusion(df, y, score, by, bits)
    n_before = F.col("fp") - F.col("n")
    sums = c.groupBy(*by).agg(
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"),
        F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("_ap"),
        F.sum(F.col("p").cast("double") * (n_before + F.col("n") / F.lit(2.0))).alias("_below"),
    )
    pos, neg = F.col("positives"), F.col("negatives")
    two = (pos > 0) & (neg > 0)
    message = F.lit("only one class among the rows to evaluate")
    status = F.when(two, "OK").otherwise(F.raise_error(message).cast("string") if strict else F.lit("ONE_CLASS"))
    pairs = F.nullif(pos.cast("double") * neg, F.lit(0.0))
    return sums.select(
        *by, (pos + neg).alias("n_rows"), "positives",
        (pos / (pos + neg)).alias("prevalence"),
        F.when(two, F.lit(1.0) - F.col("_below") / pairs).alias("roc_auc"),
        F.when(two, F.col("_ap") / F.nullif(pos, F.lit(0))).alias("pr_auc"),
        status.alias("status"),
    )


def top_fraction(
    df: DataFrame, score: str, by: Sequence[str], key: Sequence[str], fractions: Sequence[float] = TOP_FRACTIONS
) -> DataFrame:
    """Rows ranked by (score desc, key asc) with the fractions whose top
    k = max(1, round-half-even(fraction * n)) they belong to.

    Two passes: the first counts rows per bucket of scores, the second keeps the buckets that
    the largest share reaches into, and only those are sorted. The sort is cut by score and
    key together, so even one score shared by most rows is ordered by many tasks."""
    by = list(by)
    order = [F.col(score).cast("double").desc(), *[F.asc(k) for k in key]]
    placed = value_bucketed(df.withColumn("_score", F.col(score).cast("double")), "_score").drop("_score")
    # at most 2**BUCKET_BITS rows a group
    counts = placed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_m"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    above = whole.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    most = F.greatest(F.lit(1), F.rint(F.lit(max(fractions)) * F.col("_n")).cast("bigint"))
    reached = counts.select(*by, "_bucket", F.sum("_m").over(whole).alias("_n"), F.coalesce(F.sum("_m").over(above), F.lit(0)).alias("_above"))
    reached = materialise(reached.where(F.col("_above") < most))
    edge = reached.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_b"), "_n")
    same = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    sized = number_rows(placed.join(edge, same).select(*df.columns, "_n"), by, order, "rank")
    cuts = F.array(
        *[
            F.struct(
                F.lit(f).alias("fraction"),
                F.greatest(F.lit(1), F.rint(F.lit(f) * F.col("_n")).cast("bigint")).alias("k"),
            )
            for f in fractions
        ]
    )
    top = F.filter(cuts, lambda c: F.col("rank") <= c["k"])
    return sized.select(*df.columns, "rank", F.inline(top))


def precision_recall_at_k(
    df: DataFrame, y: str, score: str, by: Sequence[str], key: Sequence[str],
    fractions: Sequence[float] = TOP_FRACTIONS,
) -> DataFrame:
    """(by, fraction, k, precision, recall) in the top share of each group."""
    by = list(by)
    positives = df.groupBy(*by).agg(F.sum(F.col(y).cast("bigint")).alias("_pos"))
    hits = top_fraction(df, score, by, key, fractions).groupBy(*by, "fraction", "k").agg(
        F.sum(F.col(y).cast("bigint")).alias("_tp")
    )
    j = hits.join(positives, by) if by else hits.withColumn("_pos", positives.scalar())
    some = F.col("_pos") > 0
    return j.select(
        *by, "fraction", "k",
        F.when(some, F.col("_tp") / F.col("k")).alias("precision"),
        F.when(some, F.try_divide("_tp", "_pos")).alias("recall"),
    )


def precision_recall_at(df: DataFrame, y: str, score: str, by: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Precision and recall of ``score >= threshold``; 0 where undefined."""
    flag = F.col(score) >= threshold
    g = df.groupBy(*by).agg(
        F.count_if(flag & (F.col(y) == 1)).alias("_tp"), F.count_if(flag).alias("_flagged"),
        F.count_if(F.col(y) == 1).alias("_pos"),
    )
    return g.select(
        *by,
        F.coalesce(F.try_divide("_tp", "_flagged"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("_tp", "_pos"), F.lit(0.0)).alias("recall"),
    )


# -- summaries of result tables --------------------------------------------------------


def summarise_folds(results: DataFrame, by: Sequence[str] = ("model", "target"), fold: str = "test_fold") -> DataFrame:
    return results.groupBy(*by).agg(
        F.count_distinct(fold).alias("n_folds"), F.sum("n_rows").alias("n_test_rows_total"),
        F.avg("prevalence").alias("prevalence_mean"),
        F.avg("pr_auc").alias("pr_auc_mean"), F.stddev_samp("pr_auc").alias("pr_auc_std"),
        F.avg("roc_auc").alias("roc_auc_mean"), F.stddev_samp("roc_auc").alias("roc_auc_std"),
    )


def macro(summary: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    return summary.groupBy(*by).agg(
        F.avg("roc_auc_mean").alias("mean_roc_auc_across_targets"),
        F.avg("pr_auc_mean").alias("mean_pr_auc_across_targets"),
    )


def require_folds(summary: DataFrame, n: int = 5) -> DataFrame:
    if summary.where(F.col("n_folds") != n).limit(1).count():
        raise ValueError(f"every model and target must have all {n} test folds")
    return summary


def settings_report(results: DataFrame, by: Sequence[str], settings: str = "settings") -> DataFrame:
    """Per group the number of distinct settings; comparable results have one."""
    n = F.count_distinct(settings)
    return results.groupBy(*by).agg(n.alias("n_settings"), (n == 1).alias("same_settings"))


def require_same_settings(results: DataFrame, by: Sequence[str], settings: str = "settings") -> DataFrame:
    if settings_report(results, by, settings).where(~F.col("same_settings")).limit(1).count():
        raise ValueError("folds use different inputs or settings")
    return results


def compare_runs(old: DataFrame, new: DataFrame, by: Sequence[str] = ("model", "target"), strict: bool = False) -> DataFrame:
    """Paired deltas of two result tables with (by, cohort, n_rows, prevalence, pr_auc,
    roc_auc). ``comparable`` is false, or an error when ``strict``, unless cohort, size and
    prevalence agree."""
    metrics = ("pr_auc", "roc_auc")
    guard = ("cohort", "n_rows", "prevalence")
    a = old.select(*by, *[F.col(c).alias(f"old_{c}") for c in (*guard, *metrics)])
    b = new.select(*by, *[F.col(c).alias(f"new_{c}") for c in (*guard, *metrics)])
    j = a.join(b, list(by))
    same = F.lit(True)
    for c in guard:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    if strict and j.where(~same).limit(1).count():
        raise ValueError("comparison invalid: cohorts differ")
    return j.select(
        *by, F.col("old_n_rows").alias("n_test"), F.col("old_prevalence").alias("prevalence"),
        *[F.col(f"{side}_{m}") for m in metrics for side in ("old", "new")],
        *[(F.col(f"new_{m}") - F.col(f"old_{m}")).alias(f"delta_{m}") for m in metrics],
        same.alias("comparable"),
    )


def sweep_summary(runs: DataFrame) -> DataFrame:
    """Accuracy, coverage and convergence per (condition, alpha) over noise seeds."""
    return runs.groupBy("condition", "alpha").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("accuracy").alias("accuracy_mean"),
        F.stddev_samp("accuracy").alias("accuracy_sd"), F.min("accuracy").alias("accuracy_min"),
        F.max("accuracy").alias("accuracy_max"), F.avg("coverage").alias("coverage_mean"),
        (F.lit(1.0) - F.avg("coverage")).alias("unfilled_rate_mean"),
        F.count_if("converged").alias("converged_runs"),
    )


def gap_from_best(summary: DataFrame, alpha: float) -> DataFrame:
    """Per condition: mean accuracy at ``alpha``, the best mean over the grid and where."""
    best = F.max("accuracy_mean")
    at = F.max(F.when(F.col("alpha") == alpha, F.col("accuracy_mean")))
    return summary.groupBy("condition").agg(
        at.alias("accuracy_at_alpha"), best.alias("best_mean_accuracy"), (best - at).alias("gap_from_best"),
        F.max_by("alpha", F.struct(F.col("accuracy_mean"), -F.col("alpha"))).alias("smallest_best_alpha"),
    )


def recovery_pivot(recovery: DataFrame, alphas: Sequence[float], field: str = "target") -> DataFrame:
    """Mean correctness per field (rows) and alpha (columns ``a_<alpha>``)."""
    hit = F.col("correct").cast("double")
    return recovery.groupBy(field).agg(
        *[F.avg(F.when(F.col("alpha") == a, hit)).alias(f"a_{a:g}".replace(".", "_")) for a in alphas]
    )


def status_crosstab(df: DataFrame, rows: str, status: str, values: Sequence[str]) -> DataFrame:
    """Counts of each status per row value."""
    return df.groupBy(rows).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])
