"""Controlled corruption of a ledger, for measuring how robust the matching is."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.draws import all_hashed, hashed, key_text
from ledgerflow.functions.packed import Packed, code_type
from ledgerflow.functions.ranks import number_rows
from ledgerflow.functions.scalars import finite
from ledgerflow.operators.profile import category_value
from ledgerflow.schema import ColumnSpec
from ledgerflow.sources.readers import attach_row, materialise

# Fixed values: (numeric strength, category probability) of the named conditions.
NOISE_LEVELS = {
    "clean": (0.0, 0.0),
    "mixed_015": (0.15, 0.15),
    "mixed_030": (0.30, 0.30),
    "categorical_015": (0.0, 0.15),
    "numeric_015": (0.15, 0.0),
}

ARRAY_VALUES = 1024  # values of a category that are looked up in an array


def _check(numeric_noise: float, category_noise: float, seed: int) -> None:
    if not (math.isfinite(numeric_noise) and numeric_noise >= 0 and 0 <= category_noise <= 1 and seed >= 0):
        raise ValueError("needs strength >= 0, probability in [0, 1] and a nonnegative seed")


def corrupt(
    df: DataFrame,
    specs: Sequence[ColumnSpec],
    passports: DataFrame,
    numeric_noise: float,
    category_noise: float,
    seed: int,
    key: Sequence[str],
) -> DataFrame:
    """Noisy copy of ``df``; category columns become text.

    Draws depend on (seed, column position, row key) alone: a stronger noise reuses the
    Gaussian draws and replaces a superset of the categories. Numerics: Gaussian noise in
    units of the clean central span on finite non-zero values of continuous columns.
    Categories: replaced by a different observed value, chosen evenly."""
    names = {s.name for s in specs}
    noisy = corrupt_cases(df, specs, passports, [("", numeric_noise, category_noise, seed)], key, [c for c in df.columns if c not in names])
    return noisy.select(*[F.col(f"`{case_column('', c)}`").alias(c) if c in names else F.col(c) for c in df.columns])


def case_column(case: str, column: str) -> str:
    return f"{case}|{column}"


def corrupt_cases(
    df: DataFrame, specs: Sequence[ColumnSpec], passports: DataFrame, cases: Sequence[tuple[str, float, float, int]],
    key: Sequence[str], keep: Sequence[str] = (),
) -> DataFrame:
    """Noisy copies side by side: for every case (name, numeric strength, category probability,
    seed) and column the column ``name|column``, next to ``keep``. One projection of the ledger.
    Copies that agree in a column are views of one noisy column, see ``corrupt_variants``."""
    out, own = corrupt_variants(df, specs, passports, cases, key, keep)
    columns = [F.col(f"`{own[name, s.name]}`").alias(case_column(name, s.name)) for name, *_ in cases for s in specs]
    return out.select(*[F.col(c) for c in keep], *columns)


@dataclass(frozen=True)
class _Noise:
    """A table with what noise on it needs, and what is drawn: ``strengths`` and ``chances`` name the cases
    of each (strength or probability, seed)."""

    out: DataFrame
    nums: list[tuple[int, ColumnSpec]]
    cats: list[tuple[int, ColumnSpec]]
    strengths: dict[tuple, list[str]]
    chances: dict[tuple, list[str]]
    sizes: dict[str, int]
    large: set[int]
    book: DataFrame | None
    normal: dict[tuple[int, int], int]
    picked: list[tuple[int, float, int]]

    def place(self, i: int):
        """Place of a row's value among those of the category in column ``i``."""
        name = dict(self.cats)[i].name
        return (F.col(f"_own{i}") if i in self.large else F.array_position(F.col(f"_values.{name}"), F.col(f"_text{i}")) - 1).cast("int")


def _prepared(
    df: DataFrame, specs: Sequence[ColumnSpec], passports: DataFrame, cases: Sequence[tuple[str, float, float, int]], key: Sequence[str], listed: bool = False,
) -> _Noise:
    """``listed``: the values of the categories are wanted even if no case replaces any."""
    for _, numeric_noise, category_noise, seed in cases:
        _check(numeric_noise, category_noise, seed)
    out, types = df, dict(df.dtypes)
    nums = [(i, s) for i, s in enumerate(specs) if s.kind == "numeric"]
    cats = [(i, s) for i, s in enumerate(specs) if s.kind == "categorical"]
    # (strength, seed) -> the cases that have it; without noise the seed makes no difference
    strengths: dict[tuple, list[str]] = {}
    chances: dict[tuple, list[str]] = {}
    for name, lam, p, seed in cases:
        strengths.setdefault((lam, seed if lam > 0 else None), []).append(name)
        chances.setdefault((p, seed if p > 0 else None), []).append(name)

    if nums and any(lam > 0 for lam, _ in strengths):
        continuous = (F.col("kind") == "numeric") & (F.col("numeric_subtype") == "continuous")
        # one value per numeric column
        scale = F.struct(*[F.max(F.when(continuous & (F.col("column") == s.name), F.col("quantile_scale"))).alias(s.name) for _, s in nums])
        out = attach_row(out, materialise(passports.agg(scale.alias("_scale"))))
    sizes: dict[str, int] = {}
    book = None
    if cats and (listed or any(p > 0 for p, _ in chances)):
        cells = F.array(*[F.struct(F.lit(s.name).alias("column"), category_value(df, s.name).alias("value")) for _, s in cats])
        seen = df.select(F.inline(cells)).where(F.col("value").isNotNull()).distinct()
        book = materialise(number_rows(seen, ["column"], [F.asc("value")], "position"))
        sizes = {r["column"]: r["n"] for r in book.groupBy("column").agg(F.max("position").alias("n")).collect()}
        small = [s.name for _, s in cats if sizes.get(s.name, 0) <= ARRAY_VALUES]
        lists = book.where(F.col("column").isin(small)).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("position", "value")))["value"].alias("_v"))
        if small:
            out = attach_row(out, materialise(lists.agg(F.struct(*[F.max(F.when(F.col("column") == c, F.col("_v"))).alias(c) for c in small]).alias("_values"))))
    large = {i for i, s in cats if sizes.get(s.name, 0) > ARRAY_VALUES}
    # numbers become text once
    out = out.withColumns({f"_text{i}": _text(types, s.name) for i, s in cats}) if cats else out
    for i, s in cats:
        if i in large:
            mine = book.where(F.col("column") == s.name).select(F.col("value").alias("_value"), (F.col("position") - 1).alias(f"_own{i}"))
            out = out.join(mine, F.col(f"_text{i}") == F.col("_value"), "left").drop("_value")
    noisy_seeds = list(dict.fromkeys(seed for lam, seed in strengths if lam > 0))
    normal = {(i, seed): k for k, (i, seed) in enumerate((i, seed) for i, _ in nums for seed in noisy_seeds)}
    picked = [(i, p, seed) for p, seed in chances if p > 0 for i, s in cats if sizes.get(s.name, 0) > 1]
    return _Noise(out, nums, cats, strengths, chances, sizes, large, book, normal, picked)


def _normal_draws():
    """Normal draws from the uniform ones."""
    return F.zip_with("_drawn.radius", "_drawn.angle", lambda r, a: F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - r)) * F.cos(F.lit(2.0 * math.pi) * a))


def corrupt_variants(
    df: DataFrame, specs: Sequence[ColumnSpec], passports: DataFrame, cases: Sequence[tuple[str, float, float, int]],
    key: Sequence[str], keep: Sequence[str] = (),
) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """(table, {(case, column): its column there}). A column's noise depends on its own strength and
    the seed only, so cases that share both share the column: it is named ``case|column``
    after the first of them. A draw is made once per seed, column and row, all draws of a batch
    of rows together.

    A category's observed values are one array of a one-row table, by value; a replacement is
    looked up there by its place. Columns of more than ARRAY_VALUES values are joined instead: to
    their own place once, and to the drawn one per variant, where rows without a draw are spread
    over keys that match nothing. A case without noise reads neither. Numeric noise that
    overflows raises."""
    g = _prepared(df, specs, passports, cases, key)
    out, columns = g.out, [F.col(c) for c in keep]
    own: dict[tuple[str, str], str] = {}

    def shared(names: list[str], column: str) -> str:
        own.update({(n, column): case_column(names[0], column) for n in names})
        return case_column(names[0], column)

    if g.normal or g.picked:
        order = sorted({i for i, _, _ in g.picked})
        draw = _drawer(list(g.normal), g.picked, order, {i: g.sizes[specs[i].name] for i in order})
        out = out.withColumn("_drawn", draw(key_text(*key), F.array(*[g.place(i) for i in order]).cast("array<int>")))
    if g.normal:
        out = out.withColumn("_normal", _normal_draws())
    at = {x: k for k, x in enumerate(g.picked)}
    for (lam, seed), names in g.strengths.items():
        for i, s in g.nums:
            new = F.col(s.name)
            if lam > 0:
                v = finite(s.name)
                width = F.coalesce(F.col(f"_scale.{s.name}"), F.lit(0.0))
                noisy = F.col(s.name) + F.lit(lam) * width * F.get("_normal", F.lit(g.normal[i, seed]))
                over = F.raise_error(F.lit(f"numeric noise overflows in {s.name}")).cast("double")
                noisy = F.when(finite(noisy).isNull(), over).otherwise(noisy)
                new = F.when(v.isNotNull() & (v != 0) & (width != 0), noisy).otherwise(F.col(s.name))
            columns.append(new.alias(shared(names, s.name)))
    for variant, ((p, seed), names) in enumerate(g.chances.items()):
        for i, s in g.cats:
            new = value = F.col(f"_text{i}")
            if p > 0 and g.sizes.get(s.name, 0) > 1:
                place = F.get("_drawn.places", F.lit(at[i, p, seed]))
                if i in g.large:
                    other = g.book.where(F.col("column") == s.name).select((F.col("position") - 1).alias("_place"), F.col("value").alias(f"_new{i}_{variant}"))
                    spread = F.lit(-1) - F.pmod(F.xxhash64(*key), F.lit(1 << 20))
                    out = out.withColumn("_to", F.when(place != F.col(f"_own{i}"), place).otherwise(spread)).join(other, F.col("_to") == F.col("_place"), "left").drop("_to", "_place")
                    new = F.coalesce(f"_new{i}_{variant}", value)
                else:
                    new = F.get(F.col(f"_values.{s.name}"), place)
            columns.append(new.alias(shared(names, s.name)))
    return out.select(*columns), own


def _drawer(normal: Sequence[tuple[int, int]], picked: Sequence[tuple[int, float, int]], order: Sequence[int], sizes: dict[int, int]):
    """Function of (key text, places of the values of the categories ``order``) that gives the uniform
    draws of ``normal`` (column, seed), and for each of ``picked`` (column, probability, seed) the
    place of the value that stands there afterwards, NULL for none."""
    places_of = _replaced(picked, order, sizes)
    radius, angle = ([f"{seed}:{i}:{part}" for i, seed in normal] for part in ("radius", "angle"))

    @F.arrow_udf("struct<radius: array<double>, angle: array<double>, places: array<int>>")
    def draw(keys: pa.Array, places: pa.Array) -> pa.Array:
        u = all_hashed([*radius, *angle], keys)
        own = np.asarray(places.flatten().fill_null(-1), np.int64).reshape(len(keys), len(order)).T
        out = places_of(keys, own).T.ravel().astype(np.int32)
        doubles = [pa.array(np.ascontiguousarray(x.T).ravel()) for x in (u[: len(normal)], u[len(normal) :])]
        arrays = [*zip(doubles, [len(normal)] * 2), (pa.array(out, mask=out < 0), len(picked))]
        return pa.StructArray.from_arrays([_lists(x, n, len(keys)) for x, n in arrays], ["radius", "angle", "places"])

    return draw


def _lists(values: pa.Array, n: int, rows: int) -> pa.Array:
    """Lists of ``n`` values each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * n, pa.int32()), values)


def _replaced(picked: Sequence[tuple[int, float, int]], order: Sequence[int], sizes: dict[int, int]):
    """Function of key texts and, by category of ``order``, the places of a batch's values (-1: none): for each
    of ``picked`` (column, probability, seed) the places of the values that stand there afterwards."""
    masks = list(dict.fromkeys((i, seed) for i, _, seed in picked))
    highest = [max(p for j, p, s in picked if (j, s) == m) for m in masks]
    mask, pick = ([f"{seed}:{i}:{part}" for i, seed in masks] for part in ("mask", "pick"))
    at = {i: k for k, i in enumerate(order)}

    def places(keys: pa.Array, own: np.ndarray) -> np.ndarray:
        out = np.empty((len(picked), len(keys)), np.int64)
        if not picked:
            return out
        chance = all_hashed(mask, keys)
        # only values that some probability replaces are drawn
        hit = [np.flatnonzero((c < p) & (own[at[i]] >= 0)) for c, p, (i, _) in zip(chance, highest, masks)]
        which = np.repeat(np.arange(len(masks)), [len(h) for h in hit])
        parts = np.split(hashed(pick, keys, which, np.concatenate(hit)), np.cumsum([len(h) for h in hit])[:-1])
        new = {}
        for (i, seed), rows, u, c in zip(masks, hit, parts, chance):
            d = np.floor(u * float(sizes[i] - 1)).astype(np.int64)
            new[i, seed] = rows, d + (d >= own[at[i]][rows]), c[rows]
        for k, (i, p, seed) in enumerate(picked):
            rows, other, c = new[i, seed]
            out[k] = own[at[i]]
            out[k, rows[c < p]] = other[c < p]
        return out

    return places


def packed_variants(
    df: DataFrame, specs: Sequence[ColumnSpec], passports: DataFrame, cases: Sequence[tuple[str, float, float, int]], key: Sequence[str],
) -> tuple[Packed, dict[tuple[str, str], str]]:
    """``corrupt_variants`` as codes: every category is a place among its values, all of a row's codes are one
    binary value and all its numerics one array. The columns are many, and as columns
    they would cost more than the noise; a replacement needs no join at any number of values."""
    g = _prepared(df, specs, passports, cases, key, listed=True)
    order, nums = [i for i, _ in g.cats], [s.name for _, s in g.nums]
    out = g.out
    if g.normal:
        nothing = F.array().cast("array<int>")
        out = out.withColumn("_drawn", _drawer(list(g.normal), [], [], {})(key_text(*key), nothing)).withColumn("_normal", _normal_draws())
        normal, width = F.col("_normal"), F.array(*[F.col(f"_scale.{c}") for c in nums])
    else:
        normal = width = F.array().cast("array<double>")
    places = F.array(*[g.place(i) for i in order]).cast("array<int>")
    out = out.select(key_text(*key).alias("key"), places.alias("places"), normal.alias("normal"), width.alias("width"), F.array(*[F.col(c).cast("double") for c in nums]).cast("array<double>").alias("values"))
    cats = [(x, i) for x in g.chances for i in order]
    numbers = [(x, n) for x in g.strengths for n in range(len(nums))]
    at = {x: k for k, x in enumerate(g.picked)}
    places_of = _replaced(g.picked, order, {i: g.sizes[specs[i].name] for i, _, _ in g.picked})
    type_ = code_type(max(g.sizes.values(), default=0))
    draws, index = g.normal, [i for i, _ in g.nums]
    widths = len(nums) if draws else 0

    def table(column: pa.Array, n: int, missing, kind) -> np.ndarray:
        return np.asarray(column.flatten().fill_null(missing), kind).reshape(len(column), n).T

    def packed(batches):
        for batch in batches:
            n = batch.num_rows
            keys, own = batch.column("key"), table(batch.column("places"), len(order), -1, np.int64)
            picked = places_of(keys, own)
            codes = np.empty((n, len(cats)), type_)
            for k, ((p, seed), i) in enumerate(cats):
                codes[:, k] = (picked[at[i, p, seed]] if (i, p, seed) in at else own[order.index(i)]) + 1
            normal, width = (table(batch.column(c), k, 0.0, np.float64) for c, k in (("normal", len(draws)), ("width", widths)))
            plain = batch.column("values").flatten()
            missing = np.asarray(plain.is_null()).reshape(n, len(nums)).T
            plain = table(batch.column("values"), len(nums), 0.0, np.float64)
            values = np.empty((n, len(numbers)))
            gone = np.empty((n, len(numbers)), bool)
            for k, ((lam, seed), j) in enumerate(numbers):
                v = plain[j]
                if lam > 0:
                    noisy = v + lam * width[j] * normal[draws[index[j], seed]]
                    moved = np.isfinite(v) & (v != 0) & (width[j] != 0)
                    if not np.isfinite(noisy[moved]).all():
                        raise ValueError(f"numeric noise overflows in {nums[j]}")
                    v = np.where(moved, noisy, v)
                values[:, k], gone[:, k] = v, missing[j]
            ends = np.arange(n + 1, dtype=np.int32) * codes.itemsize * len(cats)
            binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(codes.tobytes())])
            lists = _lists(pa.array(values.ravel(), mask=gone.ravel()), len(numbers), n)
            yield pa.RecordBatch.from_arrays([binary, lists], ["codes", "values"])

    own_names: dict[tuple[str, str], str] = {}
    for names, some in ((g.strengths, g.nums), (g.chances, g.cats)):
        for x in names.values():
            own_names.update({(n, s.name): case_column(x[0], s.name) for n in x for _, s in some})
    by_index = dict(enumerate(specs))
    return Packed(
        out.mapInArrow(packed, "codes binary, values array<double>"), [(case_column(g.chances[x][0], by_index[i].name), by_index[i].name) for x, i in cats],
        [case_column(g.strengths[x][0], nums[n]) for x, n in numbers], type_, g.sizes, g.book,
    ), own_names


def _text(types: dict[str, str], name: str):
    """Category as text, NULL where a floating value is not finite."""
    return finite(name).cast("string") if types[name] in ("double", "float") else F.col(name).cast("string")


def corruption_audit(clean: DataFrame, noisy: DataFrame, specs: Sequence[ColumnSpec], key: Sequence[str]) -> DataFrame:
    """(column, n_rows, n_eligible, n_changed) of a noisy copy joined on a unique key."""
    a = clean.select(*key, *[F.col(s.name).alias(f"a_{s.name}") for s in specs])
    b = noisy.select(*key, *[F.col(s.name).alias(f"b_{s.name}") for s in specs])
    j = a.join(b, list(key))
    types = dict(clean.dtypes)
    cells = []
    for s in specs:
        x, y = F.col(f"a_{s.name}"), F.col(f"b_{s.name}")
        if s.kind == "numeric":
            eligible = finite(x).isNotNull() & (x != 0)
            same = x.cast("double").eqNullSafe(y.cast("double"))
        else:
            text = finite(x).cast("string") if types[s.name] in ("double", "float") else x.cast("string")
            eligible = text.isNotNull()
            same = text.eqNullSafe(y)
        cells.append(
            F.struct(F.lit(s.name).alias("column"), eligible.alias("eligible"), (~same).alias("changed"))
        )
    return j.select(F.inline(F.array(*cells))).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("eligible").alias("n_eligible"),
        F.count_if("changed").alias("n_changed"),
    )


def corruption_report(
    clean: DataFrame, noisy: DataFrame, specs: Sequence[ColumnSpec], passports: DataFrame, key: Sequence[str],
    numeric_noise: float, category_noise: float,
) -> DataFrame:
    """The audit with what explains it: (column, kind, numeric_noise, category_noise, n_rows,
    n_valid, n_eligible, n_changed, changed_fraction, scale, skip_reason). Columns that noise
    leaves alone say why: numerics that are not continuous or have no span, categories of
    fewer than two values, which then have no eligible row either."""
    audit = corruption_audit(clean, noisy, specs, key)
    facts = passports.select("column", "kind", "n_valid", "n_unique", "numeric_subtype", F.coalesce("quantile_scale", F.lit(0.0)).alias("_scale"))
    j = audit.join(facts, "column")
    numeric = F.col("kind") == "numeric"
    skip = F.when(numeric & ((F.col("numeric_subtype") != "continuous") | (F.col("_scale") == 0)), "non_continuous_or_zero_scale").when(
        ~numeric & (F.col("n_unique") < 2), "fewer_than_two_categories").otherwise("")
    eligible = F.when(skip == "fewer_than_two_categories", 0).otherwise(F.col("n_eligible"))
    return j.select(
        "column", "kind", F.lit(numeric_noise).alias("numeric_noise"), F.lit(category_noise).alias("category_noise"), "n_rows", "n_valid",
        eligible.cast("bigint").alias("n_eligible"), "n_changed", F.coalesce(F.try_divide("n_changed", eligible), F.lit(0.0)).alias("changed_fraction"),
        F.when(numeric, F.col("_scale")).alias("scale"), skip.alias("skip_reason"),
    )
