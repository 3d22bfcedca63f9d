"""Embedding panels: validity, joins to targets, coverage, readiness and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.ranks import exact_quantiles
from ledgerflow.functions.scalars import count_edges_at_most
from ledgerflow.sources.readers import attach_row, materialise

# Share added to every bin, drift threshold, smallest usable coverage.
PSI_EPSILON = 1e-6
PSI_THRESHOLD = 0.1
MIN_COVERAGE = 0.95


def _bad(emb: str):
    """Count of NaN, infinite or NULL entries of a vector."""
    return F.size(
        F.filter(emb, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    )


def panel_violations(panel: DataFrame, client: str, date: str, emb: str) -> DataFrame:
    """Per date: rows, missing keys, duplicate clients, non-finite rows and the spread of
    vector lengths. A valid panel has no violation and one length."""
    per_key = panel.groupBy(date, client).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(_bad(emb), F.lit(1)) > 0).alias("bad"),
        F.min(F.size(emb)).alias("lo"), F.max(F.size(emb)).alias("hi"),
    )
    return per_key.groupBy(date).agg(
        F.sum("n").alias("n_rows"), F.count_if(F.col(client).isNull() | F.col(date).isNull()).alias("missing_keys"),
        F.sum(F.col("n") - 1).alias("duplicate_rows"), F.sum("bad").alias("non_finite_rows"),
        F.min("lo").alias("min_dim"), F.max("hi").alias("max_dim"),
    )


def validate_panel(panel: DataFrame, client: str, date: str, emb: str) -> DataFrame:
    """The panel itself, or an error naming the first violation."""
    v = panel_violations(panel, client, date, emb)
    bad = v.agg(
        F.sum("missing_keys").alias("k"), F.sum("duplicate_rows").alias("d"), F.sum("non_finite_rows").alias("f"),
        F.min("min_dim").alias("lo"), F.max("max_dim").alias("hi"),
    ).first()
    if bad["k"]:
        raise ValueError("embedding panel is missing keys")
    if bad["d"]:
        raise ValueError("embedding panel contains duplicate client ids")
    if bad["f"]:
        raise ValueError("embedding panel contains NaN or infinite values")
    if bad["lo"] != bad["hi"] or not bad["lo"]:
        raise ValueError("embedding vectors differ in length")
    return panel


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def _once(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Fails inside the join job if a key repeats. Only keys are counted, and one row comes of
    it; keys with a null join nothing and may repeat."""
    whole = df.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    error = F.raise_error(F.lit(f"{what} repeat a key")).cast("boolean")
    counted = attach_row(df, whole.agg(F.coalesce(F.max("_n"), F.lit(1)).alias("_n")))
    return counted.where(F.when(F.col("_n") <= 1, F.lit(True)).otherwise(error)).drop("_n")


def join_panel(targets: DataFrame, panel: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Targets with their embeddings, one-to-one on the keys."""
    return _once(targets, keys, "targets").join(_once(panel, keys, "embeddings"), list(keys))


def paired_cohort(targets: DataFrame, panels: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Targets whose keys every panel has."""
    out = targets
    for p in panels:
        out = out.join(p.select(*keys), list(keys), "left_semi")
    return out


def features_for(cohort: DataFrame, panel: DataFrame, keys: Sequence[str], emb: str, strict: bool = True) -> DataFrame:
    """Cohort keys with vectors; ``complete`` is false, or an error when ``strict``, for a
    key without a finite vector."""
    j = cohort.join(panel.select(*keys, emb), list(keys), "left")
    complete = F.coalesce(_bad(emb) == 0, F.lit(False)) & F.col(emb).isNotNull()
    if strict:
        error = F.raise_error(F.lit("a cohort key has no finite vector")).cast("boolean")
        return j.where(F.when(complete, F.lit(True)).otherwise(error))
    return j.withColumn("complete", complete)


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def coverage(
    targets: DataFrame, panel: DataFrame, client: str, date: str, minimum: float = MIN_COVERAGE
) -> DataFrame:
    """Embedded clients against labelled clients per target date."""
    want = targets.groupBy(date).agg(F.count_distinct(client).alias("expected"))
    have = panel.groupBy(date).agg(F.count_distinct(client).alias("actual"), F.count(F.lit(1)).alias("n_rows"))
    share = F.coalesce("actual", F.lit(0)) / F.col("expected")
    return want.join(have, date, "left").select(
        date, "expected", F.coalesce("actual", F.lit(0)).alias("actual"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), share.alias("coverage"),
        F.when(F.col("actual").isNull() | (share < minimum), "FAIL").otherwise("OK").alias("status"),
    )


def panel_gaps(expected: DataFrame, published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected parts that are absent, and published parts with other settings.

    Both frames: (keys, settings), one row per part."""
    p = published.select(*keys, F.col("settings").alias("_published"))
    j = expected.join(p, list(keys), "left")
    issue = F.when(F.col("_published").isNull(), "missing").when(
        F.col("_published") != F.col("settings"), "other_settings"
    )
    return j.select(*keys, issue.alias("issue")).where(F.col("issue").isNotNull())


def psi_by_dimension(panel: DataFrame, date: str, emb: str, n_bins: int = 10) -> DataFrame:
    """(date, dim, psi): population stability of every dimension and later date against
    the earliest date. Bins are its quantiles with open ends; empty bins count."""
    first = panel.agg(F.min(date).alias("d")).scalar()
    cells = panel.withColumn("_ref", F.col(date) == first).select(
        date, "_ref", F.posexplode(F.col(emb).cast("array<double>")).alias("dim", "v")
    )
    ref = cells.where("_ref").groupBy("dim", "v").agg(F.count(F.lit(1)).alias("n"))
    edges = exact_quantiles(materialise(ref), ["dim"], "v", "n", [i / n_bins for i in range(n_bins + 1)])
    distinct = F.array_distinct("quantiles")
    inner = F.slice(distinct, 2, F.greatest(F.size(distinct) - 2, F.lit(0)))
    # One row of at most n_bins doubles per embedding dimension.
    edges = F.broadcast(edges.select("dim", inner.alias("edges")))
    counts = (
        cells.join(edges, "dim")
        .groupBy(date, "_ref", "dim", F.size("edges").alias("n_edges"), count_edges_at_most(F.col("edges"), F.col("v"), n_bins - 1).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(date, "dim"))
    shares = counts.withColumn("share", F.col("n") / total)
    base = shares.where("_ref").select("dim", "bin", F.col("share").alias("ref_share"))
    dates = shares.where("NOT _ref").select(date, "dim", "n_edges").distinct()
    grid = dates.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("n_edges"))))
    act = shares.where("NOT _ref").select(date, "dim", "bin", F.col("share").alias("act_share"))
    full = grid.join(act, [date, "dim", "bin"], "left").join(base, ["dim", "bin"], "left")
    a = F.coalesce("act_share", F.lit(0.0)) + F.lit(PSI_EPSILON)
    r = F.coalesce("ref_share", F.lit(0.0)) + F.lit(PSI_EPSILON)
    return full.groupBy(date, "dim").agg(F.sum((a - r) * F.ln(a / r)).alias("psi"))


def psi_by_date(dims: DataFrame, date: str, threshold: float = PSI_THRESHOLD) -> DataFrame:
    mean = F.avg("psi")
    return dims.groupBy(date).agg(
        mean.alias("mean_psi"), F.count(F.lit(1)).alias("n_dims"),
        F.when(mean > threshold, "FAIL").otherwise("OK").alias("verdict"),
    )


def psi_worst(dims: DataFrame, date: str, threshold: float = PSI_THRESHOLD, k: int = 5) -> DataFrame:
    """The ``k`` most drifted dimensions of every failing date."""
    failing = psi_by_date(dims, date, threshold).where("verdict = 'FAIL'").select(date)
    w = Window.partitionBy(date).orderBy(F.desc("psi"), F.asc("dim"))
    ranked = dims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.join(failing, date, "left_semi")


def fit_standardiser(df: DataFrame, emb: str, floor: float = 1e-12) -> DataFrame:
    """(dim, center, scale) over the given (train) rows: population deviation whose
    variance is floored. Sums are taken per dimension before any shuffle."""
    cells = df.select(F.posexplode(F.col(emb).cast("array<double>")).alias("dim", "v"))
    g = cells.groupBy("dim").agg(F.avg("v").alias("center"), F.var_pop("v").alias("_var"))
    return g.select("dim", "center", F.sqrt(F.greatest(F.col("_var"), F.lit(floor))).alias("scale"))


def standardise(df: DataFrame, fitted: DataFrame, emb: str, clip: float | None = None) -> DataFrame:
    """Vectors centred and scaled; the fitted table is one row per dimension."""
    book = fitted.agg(F.array_sort(F.collect_list(F.struct("dim", "center", "scale"))).alias("_s"))

    def z(x, s):
        v = (x.cast("double") - s["center"]) / s["scale"]
        return v if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), v))

    return attach_row(df, book).withColumn(emb, F.zip_with(emb, "_s", z)).drop("_s")
