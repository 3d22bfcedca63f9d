"""Exact order statistics without a single-task sort.

A window without (or with too coarse) a partition key puts a whole group into one
task. The helpers here cut the order into buckets first: bucket totals are few, so
their running sums are cheap, and rows are ordered only inside their own bucket. The
results are exact whatever the buckets look like; buckets only balance the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.scalars import HASH_BITS
from ledgerflow.sources.readers import attach_row, materialise

BUCKET_BITS = 8
HASH_BUCKET_BITS = 12
QUANTILE_BITS = 11  # finer: only buckets that hold a wanted rank are ordered, some dozen per group


def value_bucketed(df: DataFrame, value: str, bits: int = BUCKET_BITS, fixed: bool = False) -> DataFrame:
    """Adds ``_bucket``: the place of ``value`` among ``2**bits`` approximate global quantiles.

    The edges are one row of ``2**bits - 1`` doubles from a mergeable sketch. They are
    taken over all groups together: no (group, bucket) cell exceeds its share of the
    whole table, even when one group holds most rows. A row finds its place by binary
    search, one generated projection per bit. ``fixed``: the edges are written, for tables that
    are read several times.
    """
    n = 2**bits
    levels = F.expr(f"array({', '.join(f'{i / n}D' for i in range(1, n))})")
    edges = df.agg(F.percentile_approx(value, levels, 10 * n).alias("_edges"))
    placed = attach_row(df, materialise(edges) if fixed else edges).withColumn("_bucket", F.lit(0))
    for bit in reversed(range(bits)):
        step = 1 << bit
        above = f"`{value}` >= get(_edges, _bucket + {step - 1})"
        placed = placed.withColumn("_bucket", F.expr(f"_bucket + IF({above}, {step}, 0)"))
    return placed.drop("_edges")


def hash_bucketed(df: DataFrame, h: str) -> DataFrame:
    """Adds ``_bucket``: the leading bits of a 60-bit hash, evenly filled for distinct keys."""
    return df.withColumn("_bucket", F.shiftright(F.col(h), HASH_BITS - HASH_BUCKET_BITS).cast("int"))


def running_totals(
    d: DataFrame,
    by: list[str],
    order: list[Column],
    sums: dict[str, str],
    descending: bool = False,
) -> DataFrame:
    """Inclusive running sums of ``sums[name]`` as ``name``, per ``by``, along ``order``.

    The ``_bucket`` column of ``d`` must grow along ``order`` (fall when ``descending``). ``order`` must be
    total inside a group, or ties must not matter to the caller.
    """
    keys = [*by, "_bucket"]
    totals = d.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    step = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(step).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *keys,
        *[
            F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}")
            for n in sums
        ],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ordered = d.select("*", *[F.sum(c).over(inside).alias(f"_i_{n}") for n, c in sums.items()])
    joined = ordered.join(offsets, keys)
    return joined.select(
        *[c for c in d.columns if c != "_bucket"],
        *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
    )


def hash_rank(df: DataFrame, by: list[str], h: str, tie: list[str], name: str = "rank") -> DataFrame:
    """1-based rank by (hash, tie) inside ``by``; every task orders 1/4096 of the keys."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    order = [F.col(h), *[F.col(c) for c in tie]]
    ranked = running_totals(hash_bucketed(one, h), by, order, {name: "_one"})
    return ranked.drop("_one")


def exact_quantiles(
    counts: DataFrame, by: list[str], value: str, count: str, levels: list[float]
) -> DataFrame:
    """Linear-interpolated quantiles per ``by`` from (value, count) rows.

    ``counts`` is read more than once and should be materialised. Only the buckets that hold a
    wanted rank are ordered, each on its own, whatever the size.
    Output: ``by`` columns, ``quantiles`` (array in the order of ``levels``)."""
    keys = [*by, "_bucket"]
    near = _near_ranks(counts, by, value, count, levels)
    upto = F.col("_start") + F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    near = near.select(*by, "_v", "_n", "_hits", upto.alias("_upto"))
    near = near.withColumn("_hits", F.expr(_holds("_upto - _n", "_upto"))).where("size(_hits) > 0")
    points = near.select(*by, "_v", F.inline("_hits")).groupBy(*by, "level").agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("pos").alias("_pos")
    )
    q = F.expr("struct(level, _lo + (_hi - _lo) * (_pos - floor(_pos)) AS q)")
    ordered = F.array_sort(F.collect_list(q)).alias("_q")
    return points.groupBy(*by).agg(ordered).select(*by, F.expr("transform(_q, x -> x.q)").alias("quantiles"))


def _holds(lo: str, hi: str) -> str:
    """Of the wanted ranks in ``_hits`` those whose neighbours lie in [lo, hi)."""
    ranks = [f"{r}(w.pos) >= {lo} AND {r}(w.pos) < {hi}" for r in ("floor", "ceil")]
    return f"filter(_hits, w -> ({ranks[0]}) OR ({ranks[1]}))"


def _near_ranks(counts: DataFrame, by: list[str], value: str, count: str, levels: list[float]) -> DataFrame:
    """(by, _bucket, _v, _n, _start, _hits): the distinct values of buckets that hold a wanted rank, with the
    number of rows in front of the bucket."""
    d = counts.select(*by, F.col(value).alias("_v"), F.col(count).alias("_n"))
    d = d.where("_v IS NOT NULL")
    wanted = f"array({', '.join(f'{float(q)}D' for q in levels)})"
    d = value_bucketed(d, "_v", QUANTILE_BITS, fixed=True)
    keys = [*by, "_bucket"]
    group = by or [F.lit(0)]
    cells = d.groupBy(*keys).agg(F.sum("_n").alias("_cell"))
    upto = F.sum("_cell").over(
        Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    )
    total = F.sum("_cell").over(Window.partitionBy(*group))
    cells = cells.select(*keys, "_cell", (upto - F.col("_cell")).alias("_start"), total.alias("_total"))
    cells = cells.withColumn(
        "_hits", F.expr(f"transform({wanted}, (q, i) -> struct(i AS level, q * (_total - 1) AS pos))")
    )
    cells = cells.select(*keys, "_start", F.expr(_holds("_start", "_start + _cell")).alias("_hits"))
    # written, so that the planner sees how small it is before it exchanges the rows
    hit = materialise(cells.where("size(_hits) > 0"))
    # equal values are counted before they move, so that a common one brings a row per task
    values = d.join(hit.select(*keys), keys, "left_semi").groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"))
    return values.join(hit, keys)


def number_rows(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """1-based position inside ``by`` along a total ``order``, for any orderable type.

    One distributed sort; a row's position is its index inside its sorted partition plus
    the sizes of the partitions before it. The sorted rows are materialised with their
    partition and index, so that both uses see the same ones.
    """
    position = F.monotonically_increasing_id()
    rows = materialise(
        df.orderBy(*by, *order)
        .withColumn("_id", position)
        .withColumn("_part", F.shiftright("_id", 33))
    )
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    index = F.col("_id") - F.shiftleft("_part", 33) + F.col("_offset")
    placed = rows.join(offsets, "_part").withColumn("_index", index)
    if not by:
        return placed.select(*df.columns, (F.col("_index") + 1).alias(name))
    first = placed.groupBy(*by).agg(F.min("_index").alias("_first"))
    return placed.join(first, by).select(
        *df.columns, (F.col("_index") - F.col("_first") + 1).alias(name)
    )
