"""Column passports and within-table dependency, computed from value counts.

Every passport field follows from one table of (column, value, count): the rows are
counted before the shuffle, distinct counts are row counts of it, and no operator
gathers a column in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.packed import Packed, unpacked
from ledgerflow.functions.ranks import exact_quantiles, running_totals, value_bucketed
from ledgerflow.functions.scalars import count_edges_at_most, finite
from ledgerflow.schema import ColumnSpec
from ledgerflow.sources.readers import attach_row, materialise

# The quantile grid of the passports.
QUANTILE_LEVELS = (0.01, *[i / 20 for i in range(1, 20)], 0.99)
# The first passport version's limits.
TOP_VALUES = 1000
HISTOGRAM_BINS = 20


def category_value(df: DataFrame, name: str) -> Column:
    """Category as text, NULL where a floating value is not finite."""
    if dict(df.dtypes)[name] in ("double", "float"):
        return finite(name).cast("string")
    return F.col(name).cast("string")


def value_counts_long(df: DataFrame, specs: Sequence[ColumnSpec]) -> DataFrame:
    """(column, kind, s, d, n): text value for categories, DOUBLE for numerics; the
    NULLs of a column are one row."""
    cells = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("column"),
                F.lit(s.kind).alias("kind"),
                (category_value(df, s.name) if s.kind == "categorical" else F.lit(None).cast("string")).alias("s"),
                (finite(s.name) if s.kind == "numeric" else F.lit(None).cast("double")).alias("d"),
            )
            for s in specs
        ]
    )
    return (
        df.select(F.inline(cells))
        .groupBy("column", "kind", "s", "d")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _valid() -> Column:
    return F.col("s").isNotNull() | F.col("d").isNotNull()


def base_profile(counts: DataFrame) -> DataFrame:
    """Rows, valid rows, null share, exact distinct count and uniqueness per column."""
    return _statistics(counts).select("column", "kind", "n_rows", "n_valid", "n_unique", *_shares())


def base_profile_approx(df: DataFrame, specs: Sequence[ColumnSpec], rsd: float = 0.02) -> DataFrame:
    """The base profile from one shuffle-free pass, distinct counts within ``rsd``."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, s in enumerate(specs):
        v = finite(s.name) if s.kind == "numeric" else category_value(df, s.name)
        aggs += [F.count(v).alias(f"v{i}"), F.approx_count_distinct(v, rsd).alias(f"u{i}")]
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("column"), F.lit(s.kind).alias("kind"), F.col("n_rows"),
                F.col(f"v{i}").alias("n_valid"), F.col(f"u{i}").alias("n_unique"),
            )
            for i, s in enumerate(specs)
        ]
    )
    return one.select(F.inline(rows))


def category_ranks(counts: DataFrame, top: int) -> DataFrame:
    """The ``top`` most frequent values per column with their rank; pruned to ``top`` per
    task before the shuffle."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("s"), F.asc_nulls_last("d"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _entropy(total: Column, sum_n_log_n: Column) -> Column:
    return F.log2(total) - sum_n_log_n / total


def _top3(counts: DataFrame) -> DataFrame:
    c = counts.where("kind = 'categorical' AND s IS NOT NULL")
    return category_ranks(c, 3).groupBy("column").agg(F.sum("n").alias("_top3"))


def _statistics(counts: DataFrame) -> DataFrame:
    """Every passport ingredient that one aggregation of the value counts gives."""
    s, d, n = F.col("s").isNotNull(), F.col("d"), F.col("n")
    x = n.cast("double")
    num = F.when(d.isNotNull(), n)
    return counts.groupBy("column", "kind").agg(
        F.sum(n).alias("n_rows"),
        F.coalesce(F.sum(F.when(_valid(), n)), F.lit(0)).alias("n_valid"),
        F.count_if(_valid()).alias("n_unique"),
        F.sum(F.when(s, x * F.log2(x))).alias("_nlogn"),
        F.max(F.when(s, x)).alias("_top1"),
        F.min(d).alias("min"), F.max(d).alias("max"),
        (F.sum(d * n) / F.sum(num)).alias("mean"),
        (F.sum(F.when(d == 0, n).when(d.isNotNull(), 0)) / F.sum(num)).alias("zero_share"),
        (F.sum(F.when(d == F.floor(d), n).when(d.isNotNull(), 0)) / F.sum(num)).alias("integer_share"),
    )


def _shares() -> list[Column]:
    return [
        (F.lit(1.0) - F.col("n_valid") / F.col("n_rows")).alias("null_share"),
        (F.col("n_unique") / F.col("n_rows")).alias("uniqueness"),
    ]


def _categorical_fields() -> list[Column]:
    k, total = F.col("n_unique").cast("double"), F.col("n_valid").cast("double")
    here = F.col("_top1").isNotNull()
    entropy = F.when(k > 1, _entropy(total, F.col("_nlogn")) / F.log2(k)).otherwise(F.lit(0.0))
    return [
        F.when(here, entropy).alias("entropy_norm"),
        F.when(here, F.col("_top1") / total).alias("top1_share"),
        F.when(here, F.col("_top3") / total).alias("top3_share"),
    ]


def categorical_profile(counts: DataFrame) -> DataFrame:
    """Normalised entropy over all non-null values, share of the top one and three."""
    return _statistics(counts).join(_top3(counts), "column").select("column", *_categorical_fields())


def _q(level: float) -> Column:
    return F.get("quantiles", F.lit(QUANTILE_LEVELS.index(level)))


def quantile_shape(lo: Column, hi: Column) -> list[Column]:
    """Location- and scale-free quantiles: distance from the median in units of the
    central 90 % span, or of 1-99 %, or of the range when that degenerates."""
    central, wide, full = _q(0.95) - _q(0.05), _q(0.99) - _q(0.01), hi - lo
    scale = F.when(central != 0, central).when(wide != 0, wide).otherwise(full)
    fallback = (
        F.when(central != 0, "none").when(wide != 0, "q01_q99").when(full != 0, "range").otherwise("constant")
    )
    shape = F.transform(
        "quantiles",
        lambda v: F.when(scale == 0, F.lit(0.0)).otherwise((v - _q(0.5)) / F.nullif(scale, F.lit(0.0))),
    )
    return [scale.alias("quantile_scale"), fallback.alias("quantile_fallback"), shape.alias("quantile_shape")]


def _deviations(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """Sample standard deviation around the known mean."""
    # One row per profiled column, so its size is the width of the schema.
    means = F.broadcast(stats.where("mean IS NOT NULL").select("column", F.col("mean").alias("_m"), "n_valid"))
    off = F.col("d") - F.col("_m")
    return counts.where("d IS NOT NULL").join(means, "column").groupBy("column").agg(
        F.sqrt(F.sum(F.col("n") * off * off) / F.nullif(F.max("n_valid") - 1, F.lit(0))).alias("std")
    )


def _quantiles(counts: DataFrame) -> DataFrame:
    c = counts.where("kind = 'numeric' AND d IS NOT NULL")
    return exact_quantiles(c, ["column"], "d", "n", list(QUANTILE_LEVELS))


_NUMERIC = ["min", "max", "mean", "std", "zero_share", "integer_share"]


def _numeric_fields() -> list[Column]:
    k = F.col("n_unique")
    subtype = F.when(k == 1, "constant").when(k == 2, "binary").otherwise("continuous")
    here = F.col("quantiles").isNotNull()
    shape = [F.when(here, c) for c in quantile_shape(F.col("min"), F.col("max"))]
    names = ["quantile_scale", "quantile_fallback", "quantile_shape"]
    return [F.when(here, subtype).alias("numeric_subtype"), F.col("quantiles"), *[c.alias(n) for c, n in zip(shape, names)]]


def numeric_profile(counts: DataFrame) -> DataFrame:
    """Range, moments, zero and integer shares, 21 exact quantiles and their shape."""
    stats = _statistics(counts)
    joined = stats.join(_deviations(counts, stats), "column").join(_quantiles(counts), "column")
    return joined.select("column", *_NUMERIC, *_numeric_fields())


def profile_columns(
    df: DataFrame, specs: Sequence[ColumnSpec], counts: DataFrame | None = None
) -> DataFrame:
    """One passport row per column; the fields of the other kind are NULL. The ledger is
    read once: every field comes from the materialised value counts."""
    counts = materialise(value_counts_long(df, specs)) if counts is None else counts
    stats = materialise(_statistics(counts))
    kinds = {s.kind for s in specs}
    out = stats
    if "categorical" in kinds:
        out = out.join(_top3(counts), "column", "left")
    else:
        out = out.withColumn("_top3", F.lit(None).cast("bigint"))
    if "numeric" in kinds:
        out = out.join(_deviations(counts, stats), "column", "left").join(_quantiles(counts), "column", "left")
    else:
        out = out.withColumns({"std": F.lit(None).cast("double"), "quantiles": F.lit(None).cast("array<double>")})
    return out.select(
        "column", "kind", "n_rows", "n_valid", "n_unique", *_shares(), *_categorical_fields(), *_NUMERIC, *_numeric_fields()
    )


def categorical_profile_v1(counts: DataFrame) -> DataFrame:
    """First passport version: NULL is a value, only the 1000 most frequent values count,
    shares are rounded to four digits."""
    c = category_ranks(counts.where(F.col("kind") == "categorical"), TOP_VALUES)
    n = F.col("n").cast("double")
    g = c.groupBy("column").agg(
        F.sum(n).alias("_t"), F.count(F.lit(1)).cast("double").alias("_k"), F.sum(n * F.log2(n)).alias("_s"),
        F.max(n).alias("_top1"), F.sum(F.when(F.col("rank") <= 3, n)).alias("_top3"),
    )
    e = F.when(F.col("_k") > 1, _entropy(F.col("_t"), F.col("_s")) / F.log2("_k")).otherwise(F.lit(0.0))
    return g.select(
        "column", F.round(e, 4).alias("entropy_norm"), F.round(F.col("_top1") / F.col("_t"), 4).alias("top1_share"),
        F.round(F.col("_top3") / F.col("_t"), 4).alias("top3_share"),
    )


def equal_width_hist(counts: DataFrame, n_bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(column, bin, share): equal-width bins on [min, max], last bin closed, every bin
    present; a constant column fills bin 0."""
    c = counts.where((F.col("kind") == "numeric") & F.col("d").isNotNull())
    bounds = c.groupBy("column").agg(F.min("d").alias("_lo"), F.max("d").alias("_hi"), F.sum("n").alias("_total"))
    # One row per profiled column.
    b = c.join(F.broadcast(bounds), "column")
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
    step = span / F.lit(float(n_bins))
    bin_ = F.least(F.floor((F.col("d") - F.col("_lo")) / step), F.lit(n_bins - 1)).cast("int")
    filled = b.groupBy("column", bin_.alias("bin")).agg(F.sum("n").alias("_n"))
    grid = bounds.select("column", "_total", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    return grid.join(filled, ["column", "bin"], "left").select(
        "column", "bin", (F.coalesce("_n", F.lit(0)) / F.col("_total")).alias("share")
    )


def hist_entropy(hist: DataFrame) -> DataFrame:
    """Entropy of a histogram, normalised by its number of bins."""
    p = F.col("share")
    h = -F.sum(F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))
    return hist.groupBy("column").agg((h / F.log2(F.count(F.lit(1)).cast("double"))).alias("entropy_norm"))


def value_counts(df: DataFrame, c: str, k: int) -> DataFrame:
    """The ``k`` most frequent values."""
    g = df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return g.orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(k)


# -- dependency structure --------------------------------------------------------------


def structure_edges(counts: DataFrame, bins: int, max_categories: int) -> tuple[DataFrame, DataFrame]:
    """Code books of all columns: interior quantile edges of the numerics, and the kept
    values of the categories with codes 1.. (0 is the pooled tail).

    A column with more than ``max_categories`` values keeps those more frequent than the
    ``max_categories - 1``-th one; the whole group tied with it is pooled."""
    numeric = exact_quantiles(
        counts.where("kind = 'numeric'"), ["column"], "d", "n", [i / bins for i in range(bins + 1)]
    )
    return numeric.select("column", _interior("quantiles")), kept_categories(counts, max_categories)


def _interior(quantiles: Column | str) -> Column:
    edges = F.array_distinct(quantiles)
    return F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))).alias("edges")


def kept_categories(counts: DataFrame, max_categories: int) -> DataFrame:
    """(column, value, code) of the categories that ``structure_edges`` keeps."""
    cats = counts.where("kind = 'categorical' AND s IS NOT NULL")
    sizes = cats.groupBy("column").agg(F.count(F.lit(1)).alias("_k"))
    # At most max_categories rows per column survive the rank filter.
    kept = category_ranks(cats, max_categories).join(sizes, "column")
    cut = F.max(F.when(F.col("rank") == max_categories - 1, F.col("n"))).over(Window.partitionBy("column"))
    kept = kept.withColumn("_cut", cut)
    kept = kept.where((F.col("_k") <= max_categories) | (F.col("n") > F.col("_cut")))
    return kept.select("column", F.col("s").alias("value"), F.col("rank").alias("code"))


def structure_codes(
    df: DataFrame, specs: Sequence[ColumnSpec], bins: int = 10, max_categories: int = 64,
    keep: Sequence[str] = (), counts: DataFrame | None = None,
) -> DataFrame:
    """Discrete code per column and row, NULL for missing.

    The code books hold at most ``bins`` edges or ``max_categories`` values per column; all of them
    are one row that every task gets, and a category's code is its place among the kept
    values. No ledger row is shuffled or joined."""
    counts = materialise(value_counts_long(df, specs)) if counts is None else counts
    numeric, kept = structure_edges(counts, bins, max_categories)
    nums, cats = ([s.name for s in specs if s.kind == k] for k in ("numeric", "categorical"))
    out = df
    if nums:
        book = F.struct(*[F.max(F.when(F.col("column") == c, F.col("edges"))).alias(c) for c in nums])
        out = attach_row(out, materialise(numeric.agg(book.alias("_edges"))))
    if cats:
        lists = kept.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("code", "value")))["value"].alias("_values"))
        book = F.struct(*[F.max(F.when(F.col("column") == c, F.col("_values"))).alias(c) for c in cats])
        out = attach_row(out, materialise(lists.agg(book.alias("_kept"))))
    cols = []
    for s in specs:
        if s.kind == "numeric":
            v = finite(s.name)
            code = F.when(v.isNotNull(), count_edges_at_most(F.col(f"_edges.`{s.name}`"), v, bins - 1))
        else:
            v = category_value(df, s.name)
            code = F.when(v.isNotNull(), F.coalesce(F.array_position(F.col(f"_kept.`{s.name}`"), v), F.lit(0)))
        cols.append(code.cast("int").alias(s.name))
    return out.select(*keep, *cols)


def _places(names: Sequence[str], pairs: Sequence[tuple[str, str]]) -> list[tuple[int, int]]:
    place = {c: k for k, c in enumerate(names)}
    return [(place[a], place[b]) for a, b in pairs]


def _filled_cells(tables: Sequence[np.ndarray]) -> pa.RecordBatch:
    """The filled cells of dense tables per pair, whose first row and column stand for missing codes."""
    found = [np.nonzero(t[1:, 1:]) for t in tables]
    k = np.repeat(np.arange(len(tables)), [len(u) for u, _ in found])
    u, v = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    n = np.concatenate([t[1:, 1:][f] for t, f in zip(tables, found)])
    return pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in (k, u, v)], pa.array(n)], ["pair", "u", "v", "n"])


def _merged_cells(cells: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    merged = cells.groupBy("pair", "u", "v").agg(F.sum("n").alias("n"))
    sides = [F.element_at(F.array(*[F.lit(p[i]) for p in pairs]), F.col("pair") + 1).alias(n) for i, n in enumerate(("left", "right"))]
    return merged.select(*sides, "u", "v", "n")


_CELLS = "pair int, u int, v int, n bigint"


def pair_counts(codes: DataFrame, names: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(left, right, u, v, n) over the rows complete in both columns, for all pairs of ``names`` or
    the given ones. Every task counts into a dense table per pair, so no row is multiplied
    and at most the filled cells of a pair (``max_categories`` squared) leave a task."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]] if pairs is None else list(pairs)
    places = _places(names, pairs)

    def counted(batches):
        width, tables = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            # 0 stands for a missing code
            cols = [np.asarray(c.fill_null(-1)).astype(np.int64) + 1 for c in batch.columns]
            most = max(int(c.max()) for c in cols) + 1
            if most > width:
                new = np.zeros((len(places), most, most), np.int64)
                if tables is not None:
                    new[:, :width, :width] = tables
                width, tables = most, new
            for k, (a, b) in enumerate(places):
                tables[k] += np.bincount(cols[a] * width + cols[b], minlength=width * width).reshape(width, width)
        if tables is not None:
            yield _filled_cells(tables)

    return _merged_cells(codes.select(*[f"`{c}`" for c in names]).mapInArrow(counted, _CELLS), pairs)


def edge_lists(numeric: DataFrame) -> dict[str, list]:
    """Interior edges by column, at most ``bins`` each."""
    return {r["column"]: list(r["edges"]) for r in numeric.collect()}


def value_lists(kept: DataFrame) -> dict[str, list]:
    """Kept categories by column in the order of their codes, at most ``max_categories`` each."""
    lists = kept.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("code", "value")))["value"].alias("values"))
    return {r["column"]: list(r["values"]) for r in lists.collect()}


def value_pair_counts(df: DataFrame, specs: Sequence[ColumnSpec], books: dict[str, list], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``pair_counts`` of the structure codes, from the values themselves: a task codes each batch
    column by column and counts it into dense tables, one per pair, in the same pass."""
    places = _places([s.name for s in specs], pairs)
    own = [books.get(s.name, []) for s in specs]
    numeric = [s.kind == "numeric" for s in specs]
    widths = [len(b) + 2 for b in own]

    def code(column, i):
        """0 for a missing value, from 1 the structure code."""
        if numeric[i]:
            v = column.to_numpy(zero_copy_only=False)
            return np.where(np.isnan(v), 0, np.searchsorted(np.asarray(own[i], np.float64), v, side="right") + 1)
        found = np.asarray(pc.index_in(column, value_set=pa.array(own[i], column.type)).fill_null(-1), np.int64) + 2
        return np.where(np.asarray(column.is_valid()), found, 0) if column.null_count else found

    def counted(batches):
        tables = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [code(c, i).astype(np.int64) for i, c in enumerate(batch.columns)]
            new = [np.bincount(cols[a] * widths[b] + cols[b], minlength=widths[a] * widths[b]).reshape(widths[a], widths[b]) for a, b in places]
            tables = new if tables is None else [t + m for t, m in zip(tables, new)]
        if tables:
            yield _filled_cells(tables)

    values = [finite(s.name) if s.kind == "numeric" else category_value(df, s.name) for s in specs]
    return _merged_cells(df.select(*[v.alias(f"c{i}") for i, v in enumerate(values)]).mapInArrow(counted, _CELLS), pairs)


def packed_pair_counts(table: Packed, books: dict[str, list], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``value_pair_counts`` of packed columns; the book of a category has positions."""
    names, cats = [*[c for c, _ in table.categories], *table.numbers], len(table.categories)
    places, own = _places(names, pairs), [books.get(c, []) for c in names]
    width = max(len(b) for b in own) + 2
    type_, dense = table.type, table.type != "<u4"
    tables = []
    for k, (_, c) in enumerate(table.categories):
        order = np.argsort(own[k], kind="stable")
        if dense:  # a code's place by code
            book = np.full(table.sizes.get(c, 0) + 1, 1, np.int64)
            book[0] = 0
            book[np.asarray(own[k], np.int64)] = np.arange(len(own[k])) + 2
            tables.append(book)
        else:
            tables.append((np.asarray(own[k], np.int64)[order], order + 2))

    def code(k, codes):
        if dense:
            return tables[k][codes]
        values, place = tables[k]
        at = np.searchsorted(values, codes)
        found = values[np.minimum(at, len(values) - 1)] == codes if len(values) else np.zeros(len(codes), bool)
        return np.where(codes == 0, 0, np.where(found, place[np.minimum(at, len(place) - 1)] if len(place) else 1, 1))

    def counted(batches):
        sums = np.zeros((len(places), width * width), np.int64)
        for batch in batches:
            codes, n = unpacked(batch.column(0), type_, cats), batch.num_rows
            values = np.asarray(batch.column(1).flatten().fill_null(np.nan), np.float64).reshape(n, len(names) - cats)
            cols = [code(k, codes[:, k]) for k in range(cats)]
            for k in range(len(names) - cats):
                v = np.ascontiguousarray(values[:, k])
                cols.append(np.where(np.isfinite(v), np.searchsorted(np.asarray(own[cats + k], np.float64), v, side="right") + 1, 0))
            scaled = [c * width for c in cols]
            for k, (a, b) in enumerate(places):
                sums[k] += np.bincount(scaled[a] + cols[b], minlength=width * width)
        if sums.any():
            yield _filled_cells(list(sums.reshape(len(places), width, width)))

    return _merged_cells(table.rows.select("codes", "values").mapInArrow(counted, _CELLS), pairs)


def dependency_matrix(
    df: DataFrame, specs: Sequence[ColumnSpec], bins: int = 10, max_categories: int = 64,
    min_pairs: int = 30, counts: DataFrame | None = None, pairs: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """(left, right, n_pairs, usable, nmi, distance) for every column pair, or the given ones.

    NMI is arithmetic: 2 I / (H_left + H_right), from pairwise-complete rows."""
    names = [s.name for s in specs]
    wanted = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]] if pairs is None else list(pairs)
    counts = materialise(value_counts_long(df, specs)) if counts is None else counts
    numeric, kept = structure_edges(counts, bins, max_categories)
    books = edge_lists(numeric) | value_lists(kept)
    return _dependences(value_pair_counts(df, specs, books, wanted), wanted, min_pairs)


def _dependences(pairs: DataFrame, wanted: Sequence[tuple[str, str]], min_pairs: int) -> DataFrame:
    # At most max_categories squared rows per pair of columns.
    pairs = materialise(pairs)
    key = ["left", "right"]
    n = F.col("n").cast("double")

    def margin(c):
        m = pairs.groupBy(*key, c).agg(F.sum("n").cast("double").alias("m"))
        return m.groupBy(*key).agg(
            F.sum(F.col("m") * F.ln("m")).alias(f"_{c}"), F.count(F.lit(1)).alias(f"_k{c}")
        )

    joint = pairs.groupBy(*key).agg(F.sum("n").alias("n_pairs"), F.sum(n * F.ln(n)).alias("_uv"))
    grid = pairs.sparkSession.createDataFrame(list(wanted), "left string, right string")
    j = grid.join(joint.join(margin("u"), key).join(margin("v"), key), key, "left")
    total = F.col("n_pairs").cast("double")
    hu = F.ln(total) - F.col("_u") / total
    hv = F.ln(total) - F.col("_v") / total
    huv = F.ln(total) - F.col("_uv") / total
    usable = (F.col("n_pairs") >= min_pairs) & (F.col("_ku") > 1) & (F.col("_kv") > 1)
    usable = F.coalesce(usable, F.lit(False))
    nmi = F.when(usable, F.lit(2.0) * (hu + hv - huv) / (hu + hv))
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), nmi))
    return j.select(
        *key, F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), usable.alias("usable"),
        nmi.alias("nmi"), F.when(usable, F.lit(1.0) - bounded).otherwise(F.lit(1.0)).alias("distance"),
    )


def profile_source(df: DataFrame, specs: Sequence[ColumnSpec], **structure) -> tuple[DataFrame, DataFrame]:
    """(passports, dependency matrix) of one table, both from the same value counts."""
    counts = materialise(value_counts_long(df, specs))
    passports = materialise(profile_columns(df, specs, counts))
    return passports, dependency_matrix(df, specs, counts=counts, **structure)


#: Bytes of a ledger that a task holds at once to count them.
CHUNK_BYTES = 1 << 25


def category_counts(df: DataFrame, specs: Sequence[ColumnSpec]) -> DataFrame:
    """The rows of ``value_counts_long`` of the categorical columns. A task counts each column on its
    own, some megabytes at a time, so no ledger row is multiplied by the number of columns."""
    cats = [s.name for s in specs if s.kind == "categorical"]

    def tally(held):
        rows = pa.Table.from_batches(held)
        each = [pc.value_counts(c) for c in rows.columns]
        at = pa.array(np.repeat(np.arange(len(each), dtype=np.int32), [len(e) for e in each]))
        cells = [pa.concat_arrays([e.field(i) for e in each]) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([at, *cells], ["at", "s", "n"])

    def counted(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                yield tally(held)
                held, size = [], 0
        if held:
            yield tally(held)

    texts = df.select(*[category_value(df, c).alias(f"c{i}") for i, c in enumerate(cats)])
    counts = texts.mapInArrow(counted, "at int, s string, n bigint").groupBy("at", "s").agg(F.sum("n").alias("n"))
    return counts.select(
        _named(cats), F.lit("categorical").alias("kind"), "s", F.lit(None).cast("double").alias("d"), "n"
    )


def joint_values(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(left, right, u, v): the distinct values, as text, of each pair of columns over the rows complete
    in both. A task finds those of some megabytes of rows at a time, pair by pair, so no row
    is multiplied by the number of pairs."""
    names = list(dict.fromkeys(c for p in pairs for c in p))
    places = [(names.index(a), names.index(b)) for a, b in pairs]

    def distinct(held):
        coded = [pa.chunked_array([c for b in held for c in [b.column(i)]]).combine_chunks().dictionary_encode() for i in range(len(names))]
        at, us, vs = [], [], []
        for k, (i, j) in enumerate(places):
            a, b = (np.asarray(coded[x].indices.fill_null(-1), np.int64) for x in (i, j))
            own, width = (a >= 0) & (b >= 0), len(coded[j].dictionary)
            both = np.unique(a[own] * width + b[own])
            at.append(np.full(len(both), k, np.int32))
            us.append(coded[i].dictionary.take(pa.array(both // max(width, 1))))
            vs.append(coded[j].dictionary.take(pa.array(both % max(width, 1))))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.concat_arrays(us), pa.concat_arrays(vs)], ["at", "u", "v"])

    def found(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= CHUNK_BYTES:
                yield distinct(held)
                held, size = [], 0
        if held:
            yield distinct(held)

    texts = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(names)])
    sides = [F.element_at(F.array(*[F.lit(p[i]) for p in pairs]), F.col("at") + 1).alias(n) for i, n in enumerate(("left", "right"))]
    return texts.mapInArrow(found, "at int, u string, v string").distinct().select(*sides, "u", "v")


def _named(names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in names]), F.col("at") + 1).alias("column")


def numeric_facts(df: DataFrame, specs: Sequence[ColumnSpec], levels: Sequence[float]) -> DataFrame:
    """(column, n_rows, n_valid, n_unique, min, max, zero_share, quantiles) of the numeric columns, the
    quantiles exact. Distinct values are told apart up to three, all that a subtype needs,
    so columns without repeated values are never grouped by value."""
    nums = [s.name for s in specs if s.kind == "numeric"]
    return _facts_of_cells(df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("at"), finite(c).alias("d")) for i, c in enumerate(nums)]))), nums, levels)


def _facts_of_cells(cells: DataFrame, nums: Sequence[str], levels: Sequence[float]) -> DataFrame:
    """``numeric_facts`` of (at, d), the finite values of column ``nums[at]``."""
    d = F.col("d")
    facts = materialise(cells.groupBy("at").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(d).alias("n_valid"), F.min(d).alias("min"), F.max(d).alias("max"),
        (F.count_if(d == 0) / F.nullif(F.count(d), F.lit(0))).alias("zero_share"),
    ))
    # One row per profiled column.
    more = cells.join(F.broadcast(facts.select("at", "min", "max")), "at").groupBy("at").agg(F.max((d > F.col("min")) & (d < F.col("max"))).alias("_more"))
    quantiles = exact_quantiles(cells.withColumn("n", F.lit(1).cast("bigint")), ["at"], "d", "n", list(levels))
    n_unique = F.when(F.col("n_valid") == 0, 0).when(F.col("min") == F.col("max"), 1).when(F.col("_more"), 3).otherwise(2)
    out = facts.join(more, "at").join(quantiles, "at", "left")
    return out.select(_named(nums), "n_rows", "n_valid", n_unique.cast("bigint").alias("n_unique"), "min", "max", "zero_share", "quantiles")


def matching_source(
    df: DataFrame, specs: Sequence[ColumnSpec], bins: int = 10, max_categories: int = 64, min_pairs: int = 30,
    pairs: Sequence[tuple[str, str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``profile_source`` with just the passport fields that matching and noise read. No numeric value is
    counted (``n_unique`` of numerics is 3 from three on); passports and bin edges of
    numerics come from one set of exact quantiles."""
    names, kinds = [s.name for s in specs], {s.kind for s in specs}
    wanted = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]] if pairs is None else list(pairs)
    counts = materialise(category_counts(df, specs)) if "categorical" in kinds else None
    facts = (lambda levels: numeric_facts(df, specs, levels)) if "numeric" in kinds else None
    out, books = _matching_passports(counts, facts, value_lists, bins, max_categories)
    return out, _dependences(value_pair_counts(df, specs, books, wanted), wanted, min_pairs)


def packed_source(
    table: Packed, pairs: Sequence[tuple[str, str]], bins: int = 10, max_categories: int = 64, min_pairs: int = 30,
) -> tuple[DataFrame, DataFrame]:
    """``matching_source`` of packed columns."""
    counts = materialise(table.category_counts()) if table.categories else None
    cells = table.numeric_cells().select("at", finite("d").alias("d"))
    facts = (lambda levels: _facts_of_cells(cells, table.numbers, levels)) if table.numbers else None
    out, books = _matching_passports(counts, facts, table.positions, bins, max_categories)
    return out, _dependences(packed_pair_counts(table, books, pairs), pairs, min_pairs)


def _matching_passports(counts, facts, listed, bins: int, max_categories: int) -> tuple[DataFrame, dict[str, list]]:
    """Passports and code books from value counts of the categories, ``facts`` of the numerics for given
    levels, and ``listed``, which makes lists of kept categories."""
    parts, books = [], {}
    if counts is not None:
        stats = _statistics(counts).withColumn("_top3", F.lit(None).cast("bigint"))
        blank = [F.lit(None).cast("double").alias("zero_share"), F.lit(None).cast("array<double>").alias("quantiles")]
        entropy, top1, _ = _categorical_fields()
        bounds = [F.lit(None).cast("double").alias(c) for c in ("min", "max")]
        parts.append(stats.select("column", "kind", "n_rows", "n_valid", "n_unique", _shares()[0], entropy, top1, *blank, *bounds))
        books |= listed(kept_categories(counts, max_categories))
    if facts is not None:
        steps = [i / bins for i in range(bins + 1)]
        levels = sorted({*QUANTILE_LEVELS, *steps})
        facts = materialise(facts(levels))
        at = lambda some: F.array(*[F.get("quantiles", F.lit(levels.index(q))) for q in some])
        valid = F.col("quantiles").isNotNull()
        blank = [F.lit(None).cast("double").alias(c) for c in ("entropy_norm", "top1_share")]
        own = F.when(valid, at(QUANTILE_LEVELS)).alias("quantiles")
        parts.append(facts.select("column", F.lit("numeric").alias("kind"), "n_rows", "n_valid", "n_unique", _shares()[0], *blank, "zero_share", own, "min", "max"))
        books |= edge_lists(facts.where(valid).select("column", _interior(at(steps))))
    out = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    out = out.select(
        "column", "kind", "n_rows", "n_valid", "n_unique", "null_share", "entropy_norm", "top1_share", "min", "max", "zero_share", *_numeric_fields())
    return materialise(out), books


# -- rank correlation ------------------------------------------------------------------


#: A value in more than this part of all cells is common; there are at most as many as its inverse.
COMMON_PART = 1000


def _average_ranks(cells: DataFrame, key: list[str], c: str) -> DataFrame:
    """Mid-rank of every distinct value of ``c`` per pair, and the number of its cells."""
    counts = materialise(cells.groupBy(*key, c).agg(F.sum("n").alias("_m"), F.count(F.lit(1)).alias("_cells")))
    run = running_totals(value_bucketed(counts, c), key, [F.asc(c)], {"_upto": "_m"})
    rank = F.col("_upto") - F.col("_m") + (F.col("_m") + 1) / F.lit(2.0)
    return materialise(run.select(*key, c, rank.alias(f"_r{c}"), "_cells"))


def _with_ranks(cells: DataFrame, key: list[str], c: str) -> DataFrame:
    """Cells with the mid-rank of their ``c``. Common values are few and looked up in every task, so
    that none of them brings its cells into one task; the others are joined."""
    ranks = _average_ranks(cells, key, c)
    total = ranks.agg(F.sum("_cells").alias("n")).scalar()
    common = F.col("_cells") * COMMON_PART > total
    few = ranks.where(common).drop("_cells")
    seen = cells.join(F.broadcast(few), [*key, c], "left")
    rest = seen.where(F.col(f"_r{c}").isNull()).drop(f"_r{c}").join(ranks.where(~common).drop("_cells"), [*key, c])
    return seen.where(F.col(f"_r{c}").isNotNull()).unionByName(rest)


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(left, right, n, distinct_left, distinct_right, rho) over pairwise-complete rows."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), finite(a).alias("x"), finite(b).alias("y"))
            for a, b in pairs
        ]
    )
    key = ["left", "right"]
    joint = (
        df.select(F.inline(cells))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy(*key, "x", "y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    joint = materialise(joint)
    r = _with_ranks(_with_ranks(joint, key, "x"), key, "y")
    n, a, b = F.col("n"), F.col("_rx"), F.col("_ry")
    total = F.sum(n).cast("double")
    mid = (total + 1) / F.lit(2.0)
    cov = F.sum(n * a * b) / total - mid * mid
    va = F.sum(n * a * a) / total - mid * mid
    vb = F.sum(n * b * b) / total - mid * mid
    stats = r.groupBy(*key).agg(
        F.sum(n).alias("n"), (va > 0).alias("_da"), (vb > 0).alias("_db"),
        (cov / F.sqrt(F.nullif(va, F.lit(0.0)) * F.nullif(vb, F.lit(0.0)))).alias("rho"),
    )
    return stats.select(*key, "n", (F.col("_da") & F.col("_db")).alias("varies"), "rho")


def correlation_diagnostics(
    a: DataFrame, b: DataFrame, matches: Sequence[tuple[str, str]], min_pairs: int = 30, warning: float = 0.3
) -> DataFrame:
    """Compare the rank correlations of matched numeric columns (source, field) in both
    tables: WARNING when they differ by more than ``warning``."""
    idx = [(i, j) for i in range(len(matches)) for j in range(i + 1, len(matches))]
    if not idx:
        raise ValueError("needs two or more matched numeric columns")
    sa = spearman(a, [(matches[i][0], matches[j][0]) for i, j in idx])
    sb = spearman(b, [(matches[i][1], matches[j][1]) for i, j in idx])
    names = a.sparkSession.createDataFrame(
        [(matches[i][0], matches[j][0], matches[i][1], matches[j][1]) for i, j in idx],
        "source_1 string, source_2 string, field_1 string, field_2 string",
    )
    sa = sa.select(
        F.col("left").alias("source_1"), F.col("right").alias("source_2"),
        F.col("n").alias("n_a"), F.col("varies").alias("_va"), F.col("rho").alias("_ra"),
    )
    sb = sb.select(
        F.col("left").alias("field_1"), F.col("right").alias("field_2"),
        F.col("n").alias("n_b"), F.col("varies").alias("_vb"), F.col("rho").alias("_rb"),
    )
    j = names.join(sa, ["source_1", "source_2"], "left").join(sb, ["field_1", "field_2"], "left")
    ok = F.coalesce(
        (F.least("n_a", "n_b") >= min_pairs) & F.col("_va") & F.col("_vb"), F.lit(False)
    )
    delta = F.abs(F.col("_ra") - F.col("_rb"))
    return j.select(
        "source_1", "source_2", "field_1", "field_2",
        F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"),
        F.when(ok, F.col("_ra")).alias("rho_a"), F.when(ok, F.col("_rb")).alias("rho_b"),
        F.when(ok, delta).alias("delta"),
        F.when(~ok, "SKIPPED").when(delta > warning, "WARNING").otherwise("CONSISTENT").alias("status"),
    )
