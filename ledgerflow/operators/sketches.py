"""Approximate column passports from sketches that are kept per part of a ledger and merged
without reading it again.

Distinct counts come from HyperLogLog sketches, quantiles from KLL sketches; rows, valid rows, range,
moments and shares are exact. ``LG_K`` and ``KLL_K`` set the errors, see ``distinct_error`` and
``rank_error``. A part's sketches take a few kilobytes per column, whatever it holds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.scalars import finite
from ledgerflow.operators.profile import QUANTILE_LEVELS, category_value, quantile_shape
from ledgerflow.schema import ColumnSpec

LG_K = 14
KLL_K = 1600
_STATS = ["n_rows", "n_valid", "distinct", "quantile_sketch", "min", "max", "mean", "m2", "zeros", "integers"]


def distinct_error(lg_k: int = LG_K) -> float:
    """Relative error of a merged distinct count at three standard deviations."""
    return 3 * 1.04 / math.sqrt(1 << lg_k)


def rank_error(k: int = KLL_K) -> float:
    """Error of a quantile's rank, as a share of the valid rows, at 99 % confidence."""
    return 2.446 / k**0.9433


def sketch_columns(
    df: DataFrame, specs: Sequence[ColumnSpec], by: Sequence[str] = (), lg_k: int = LG_K, kll_k: int = KLL_K
) -> DataFrame:
    """One row per part ``by`` and column: its exact figures and its two sketches (the quantile
    sketch of a numeric only). One aggregate over the columns as they are: rows are not
    multiplied, and tasks sketch before the shuffle, so a part with most rows costs no more."""
    aggs, cells = [F.count(F.lit(1)).alias("_rows")], []
    for i, s in enumerate(specs):
        numeric = s.kind == "numeric"
        v = finite(s.name) if numeric else category_value(df, s.name)
        # -0.0 and 0.0 are one value
        counted = F.when(v.isNotNull(), F.xxhash64(v + F.lit(0.0))) if numeric else v
        aggs += [F.count(v).alias(f"_n{i}"), F.hll_sketch_agg(counted, lg_k).alias(f"_h{i}")]
        facts = [F.lit(None).cast(t) for t in ("binary", "double", "double", "double", "double", "bigint", "bigint")]
        if numeric:
            aggs += [
                F.kll_sketch_agg_double(v, F.lit(kll_k)).alias(f"_q{i}"), F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}"), F.avg(v).alias(f"_mean{i}"),
                (F.var_pop(v) * F.count(v)).alias(f"_m2{i}"), F.count_if(v == 0).alias(f"_zero{i}"), F.count_if(v == F.floor(v)).alias(f"_int{i}"),
            ]
            facts = [F.col(f"_{n}{i}") for n in ("q", "lo", "hi", "mean", "m2", "zero", "int")]
        named = [F.col("_rows"), F.col(f"_n{i}"), F.col(f"_h{i}"), *facts]
        cells.append(F.struct(F.lit(s.name).alias("column"), F.lit(s.kind).alias("kind"), *[c.alias(n) for c, n in zip(named, _STATS)]))
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells)))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sketches of the union of parts, per ``by`` if given. Any table of sketches will do, also one
    put together from several runs; parts must not overlap."""
    n, mean = F.col("n_valid"), F.col("mean")
    total = F.sum(F.when(mean.isNotNull(), n))
    grouped = sketches.groupBy(*by, "column", "kind").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_valid").alias("n_valid"), F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.try_divide(F.sum(n * mean), total).alias("mean"), F.sum("m2").alias("_within"),
        F.collect_list(F.when(mean.isNotNull(), F.struct(n.alias("n"), mean.alias("m")))).alias("_parts"),  # two numbers a part
        F.sum("zeros").alias("zeros"), F.sum("integers").alias("integers"),
    )
    # what the parts' means differ by; centred, so that nothing cancels
    between = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["n"] * (p["m"] - F.col("mean")) * (p["m"] - F.col("mean")))
    m2 = F.col("_within") + between
    return grouped.select(*by, "column", "kind", *[F.when(F.col("mean").isNotNull(), m2).alias(c) if c == "m2" else F.col(c) for c in _STATS])


def sketched_passports(sketches: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Passport fields of (merged) sketches: the base ones for all columns, the numeric ones with
    approximate quantiles. A column without valid rows has NULL numeric fields."""
    levels = F.array(*[F.lit(q) for q in QUANTILE_LEVELS])
    n = F.col("n_valid")
    here = (F.col("kind") == "numeric") & (n > 0)
    rows = sketches.withColumn("n_unique", F.when(n > 0, F.hll_sketch_estimate("distinct")).otherwise(F.lit(0))).withColumn(
        "quantiles", F.when(here, F.kll_sketch_get_quantile_double("quantile_sketch", levels)))
    subtype = F.when(F.col("min") == F.col("max"), "constant").when(F.col("n_unique") == 2, "binary").otherwise("continuous")
    shape = [F.when(here, c).alias(name) for c, name in zip(quantile_shape(F.col("min"), F.col("max")), ("quantile_scale", "quantile_fallback", "quantile_shape"))]
    return rows.select(
        *keep, "column", "kind", "n_rows", "n_valid", "n_unique", (F.lit(1.0) - n / F.col("n_rows")).alias("null_share"),
        (F.col("n_unique") / F.col("n_rows")).alias("uniqueness"), "min", "max", "mean", F.sqrt(F.col("m2") / F.nullif(n - 1, F.lit(0))).alias("std"),
        F.try_divide("zeros", n).alias("zero_share"), F.try_divide("integers", n).alias("integer_share"), F.when(here, subtype).alias("numeric_subtype"),
        "quantiles", *shape,
    )


def quantile_rank_errors(passports: DataFrame, counts: DataFrame) -> DataFrame:
    """(column, rank_error): how far the worst quantile of a passport is from its level, as a share of
    the valid rows, by the exact value counts (column, d, n). A level inside the ranks that a
    value's repeats take is met."""
    # one row per numeric column
    book = F.broadcast(passports.where("quantiles IS NOT NULL").select("column", "quantiles"))
    j = counts.where("d IS NOT NULL").join(book, "column")
    cells = []
    for i in range(len(QUANTILE_LEVELS)):
        q = F.get("quantiles", F.lit(i))
        cells += [F.sum(F.when(F.col("d") < q, F.col("n")).otherwise(0)).alias(f"_b{i}"), F.sum(F.when(F.col("d") <= q, F.col("n")).otherwise(0)).alias(f"_a{i}")]
    g = j.groupBy("column").agg(F.sum("n").alias("_t"), *cells)
    off = [F.greatest(F.lit(0.0), F.col(f"_b{i}") / F.col("_t") - q, q - F.col(f"_a{i}") / F.col("_t")) for i, q in enumerate(QUANTILE_LEVELS)]
    return g.select("column", F.greatest(*off).alias("rank_error"))
