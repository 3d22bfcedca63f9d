"""Target panels: validation, fold roles, leakage-safe splits, undersampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.ranks import hash_bucketed, hash_rank
from ledgerflow.functions.scalars import hash60
from ledgerflow.sources.readers import materialise, sample_clients

N_FOLDS = 5


def target_issues(df: DataFrame, keys: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row: rows with nulls, rows with non-binary labels, rows collapsed as identical
    duplicates, and keys whose selected labels contradict each other. A label that a key never
    has contradicts nothing."""
    null = F.lit(False)
    for c in (*keys, *labels):
        null = null | F.col(c).isNull()
    odd = F.lit(False)
    for c in labels:
        odd = odd | ~F.col(c).isin(0, 1)
    variants = [F.coalesce(F.min(c) != F.max(c), F.lit(False)) for c in labels]
    conflict = variants[0]
    for v in variants[1:]:
        conflict = conflict | v
    per_key = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), conflict.alias("conflict"),
        F.count_if(null).alias("nulls"), F.count_if(F.coalesce(odd, F.lit(False))).alias("odd"),
    )
    return per_key.agg(
        F.sum("n").alias("n_rows"), F.sum("nulls").alias("null_rows"), F.sum("odd").alias("non_binary_rows"),
        F.sum(F.when(~F.col("conflict"), F.col("n") - 1).otherwise(0)).alias("collapsed_rows"),
        F.count_if("conflict").alias("conflicting_keys"),
    )


def clean_targets(df: DataFrame, keys: Sequence[str], labels: Sequence[str], strict: bool = True) -> DataFrame:
    """(keys, labels) once per key. Identical duplicates collapse; nulls, labels other than
    0/1 and contradicting duplicates raise, or, if not ``strict``, their keys are left out."""
    if strict:
        bad = target_issues(df, keys, labels).first()
        if bad["null_rows"]:
            raise ValueError(f"{bad['null_rows']} target rows lack a key or a label")
        if bad["non_binary_rows"]:
            raise ValueError(f"{bad['non_binary_rows']} target rows have labels other than 0 and 1")
        if bad["conflicting_keys"]:
            raise ValueError(f"labels contradict each other on {bad['conflicting_keys']} keys")
    g = df.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in labels], *[F.max(c).alias(f"_max_{c}") for c in labels],
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in labels],
    )
    for c in labels:
        g = g.where((F.col(c) == F.col(f"_max_{c}")) & F.col(c).isin(0, 1) & (F.col(f"_null_{c}") == 0))
    return g.dropna(subset=list(keys)).select(*keys, *labels)


def fold_roles(df: DataFrame, test_fold: int, fold: str = "fold") -> DataFrame:
    """``role``: the test fold, the fold before it (cyclically) for validation, the rest
    for training."""
    if test_fold not in range(N_FOLDS):
        raise ValueError(f"test fold must be in 0..{N_FOLDS - 1}, got {test_fold}")
    f = F.col(fold)
    role = F.when(f == test_fold, "test").when(f == (test_fold - 1) % N_FOLDS, "val").otherwise("train")
    return df.withColumn("role", role)


def rotate_folds(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Every row once per test fold with its role there; a fixed five-fold fan-out."""
    test = F.explode(F.sequence(F.lit(0), F.lit(N_FOLDS - 1)))
    rotated = df.withColumn("test_fold", test)
    before = F.pmod(F.col("test_fold") - 1, F.lit(N_FOLDS))
    role = F.when(F.col(fold) == F.col("test_fold"), "test").when(F.col(fold) == before, "val").otherwise("train")
    return rotated.withColumn("role", role)


def calendar_split(df: DataFrame, train: Sequence[str], test: Sequence[str], month: str = "month") -> DataFrame:
    """``role`` by month; every test month must come after every train month."""
    if not train or not test or max(train) >= min(test):
        raise ValueError("test months must follow all train months")
    days = [F.lit(m).cast("date") for m in train]
    late = [F.lit(m).cast("date") for m in test]
    role = F.when(F.col(month).isin(*days), "train").when(F.col(month).isin(*late), "test")
    return df.withColumn("role", role).where(F.col("role").isNotNull())


def _ranked_clients(df: DataFrame, client: str, seed: int) -> DataFrame:
    ids = df.select(client).distinct().withColumn("_h", hash60(seed, client))
    return hash_rank(ids, [], "_h", [client], "_rank").drop("_h")


def group_split(df: DataFrame, client: str, fraction: float, seed: int) -> DataFrame:
    """Adds ``valid``: whole clients, ceil(fraction * clients) of them, by seeded hash."""
    ranked = _ranked_clients(df, client, seed)
    total = df.agg(F.count_distinct(client).alias("n")).scalar()
    split = ranked.select(client, (F.col("_rank") <= F.ceil(F.lit(fraction) * total)).alias("valid"))
    return df.join(split, client)


def fixed_split(clients: DataFrame, client: str, seed: int, fraction: float) -> DataFrame:
    """(client, valid) with min(n-1, max(1, floor(n * fraction))) validation clients,
    whatever the row order. The rows of ``clients`` are read once, for the ids."""
    if not 0 < fraction < 1:
        raise ValueError("needs 0 < fraction < 1")
    ids = materialise(clients.select(client).distinct())
    ranked = _ranked_clients(ids, client, seed)
    total = ids.agg(F.count(client).alias("n")).scalar()
    n_valid = F.least(total - 1, F.greatest(F.lit(1), F.floor(total * F.lit(fraction))))
    return ranked.select(client, (F.col("_rank") <= n_valid).alias("valid"))


def undersample(
    df: DataFrame, y: str, ratio: float, seed: int, key: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """All positives and at most floor(positives * ratio) negatives per ``by``, chosen by
    seeded hash of the row key.

    The first pass counts positives, and negatives per bucket of hashes. Buckets below the one
    in which the quota ends are taken as they are; only that bucket, one of 4096, is ranked."""
    by = list(by)
    negative = F.col(y) == 0
    placed = hash_bucketed(df.withColumn("_h", hash60(seed, *key)), "_h")
    counts = placed.groupBy(*by, F.when(negative, F.col("_bucket")).alias("_bucket")).agg(
        F.count_if(negative).alias("_m"), F.count_if(F.col(y) == 1).alias("_pos")
    )
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    below = whole.orderBy(F.asc_nulls_first("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    quota = F.floor(F.sum("_pos").over(whole) * F.lit(float(ratio)))
    left = (quota - F.coalesce(F.sum("_m").over(below), F.lit(0))).alias("_left")
    cut = counts.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_bucket").alias("_b"), "_m", left)
    cut = materialise(cut.where("_b IS NOT NULL AND _left > 0"))
    same = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    near = placed.where(negative).join(cut, same)
    rank = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_h", *key))
    edge = near.where(F.col("_m") > F.col("_left")).withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left"))
    kept = near.where(F.col("_m") <= F.col("_left")).select(*df.columns).unionByName(edge.select(*df.columns))
    return df.where(F.col(y) == 1).unionByName(kept)


def tune_cohort(df: DataFrame, client: str, n: int, seed: int) -> DataFrame:
    """All rows of at most ``n`` hash-chosen clients."""
    return df.join(materialise(sample_clients(df, client, n, seed)), client, "left_semi")


def leak_report(df: DataFrame, client: str, key: Sequence[str], labels: Sequence[str], fold: str = "fold") -> DataFrame:
    """One row of counts that must all be zero for a leak-free split with ``role``s."""
    roles = F.collect_set("role")
    per_client = df.groupBy(client).agg(
        F.count_distinct(fold).alias("folds"), roles.alias("roles"),
    ).agg(
        F.count_if(F.col("folds") > 1).alias("clients_in_two_folds"),
        F.count_if(F.array_contains("roles", "train") & F.array_contains("roles", "val")).alias("clients_train_and_val"),
        F.count_if(F.array_contains("roles", "train") & F.array_contains("roles", "test")).alias("clients_train_and_test"),
    )
    per_row = df.groupBy(*key).agg(F.count_distinct("role").alias("r")).agg(
        F.count_if(F.col("r") > 1).alias("rows_in_two_roles")
    )
    parts = [F.count_if(F.col("role") == r) for r in ("train", "val", "test")]
    empty = F.lit(0)
    lacking = F.lit(0)
    for p in parts:
        empty = empty + F.when(p == 0, 1).otherwise(0)
    for r in ("train", "val", "test"):
        for y in labels:
            here = F.when(F.col("role") == r, F.col(y))
            lacking = lacking + F.when(F.min(here) == F.max(here), 1).otherwise(0)
    whole = df.agg(empty.alias("empty_partitions"), lacking.alias("one_class_partitions"))
    k = F.lit(1).alias("_k")
    out = per_client.select("*", k).join(per_row.select("*", k), "_k").join(whole.select("*", k), "_k")
    return out.drop("_k")


def class_balance(df: DataFrame, labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(label, n_rows, positives, prevalence, pos_weight) with pos_weight = neg / max(pos, 1)."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(F.col(y).cast("bigint")).alias(f"_p_{y}") for y in labels]
    rows = F.array(
        *[F.struct(F.lit(y).alias("label"), F.col("_n").alias("n_rows"), F.col(f"_p_{y}").alias("positives")) for y in labels]
    )
    g = df.groupBy(*by).agg(*aggs).select(*by, F.inline(rows))
    return g.select(
        "*", (F.col("positives") / F.col("n_rows")).alias("prevalence"),
        ((F.col("n_rows") - F.col("positives")) / F.greatest(F.col("positives"), F.lit(1))).alias("pos_weight"),
    )


def missing_months(targets: DataFrame, months: DataFrame, month: str = "month") -> DataFrame:
    """Configured months without a single target row."""
    return months.select(month).distinct().join(targets.select(month), month, "left_anti")
