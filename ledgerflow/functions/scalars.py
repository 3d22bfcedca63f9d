"""Row-level expressions. All stay in the JVM."""

from __future__ import annotations

import builtins

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW_ID_SEPARATOR = "::"
MISSING_CATEGORY = "<MISSING>"
HASH_BITS = 60


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_code(c: Column | str) -> Column:
    """Integer-like code stored as DOUBLE -> BIGINT, half-even; NaN and overflow give NULL."""
    return F.rint(_c(c).cast("double")).try_cast("bigint")


def finite(c: Column | str) -> Column:
    """The value as DOUBLE, NULL where it is NaN or infinite."""
    v = _c(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def category_key(c: Column | str, dtype: str = "string") -> Column:
    """Canonical category text: ``7``, ``7.0`` and ``'7.0'`` agree, missing is a category."""
    v = _c(c)
    if dtype in ("double", "float"):
        v = finite(v)
        text = F.when(
            (v == F.floor(v)) & (F.abs(v) < F.lit(2.0**53)), v.cast("bigint").cast("string")
        ).otherwise(v.cast("string"))
    elif dtype in ("bigint", "int", "smallint", "tinyint"):
        text = v.cast("string")  # has no point to cut
    else:
        text = F.regexp_replace(v.cast("string"), r"^(-?\d+)\.0+$", "$1")
    return F.coalesce(text, F.lit(MISSING_CATEGORY))


def epoch_seconds(c: Column | str) -> Column:
    return F.unix_seconds(_c(c).cast("timestamp"))


def hash60(seed: int | str, *cols: Column | str) -> Column:
    """Seeded 60-bit hash in [0, 2**60), the same in every SQL engine that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_c(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def uniform(seed: int | str, *cols: Column | str) -> Column:
    """Seeded uniform draw in [0, 1) per key."""
    return hash60(seed, *cols).cast("double") / F.lit(float(2**HASH_BITS))


def shard_of(n: int, *cols: Column | str, seed: int | str = "shard") -> Column:
    return F.pmod(hash60(seed, *cols), F.lit(n)).cast("int")


def stamp_window_id(client: Column | str, date: Column | str) -> Column:
    return F.concat(
        _c(client).cast("string"), F.lit(WINDOW_ID_SEPARATOR), _c(date).cast("string")
    )


def split_window_id(c: Column | str) -> tuple[Column, Column]:
    """Split at the right-most separator: client ids may contain it."""
    v = _c(c)
    date = F.substring_index(v, WINDOW_ID_SEPARATOR, -1)
    keep = F.length(v) - F.length(date) - F.lit(len(WINDOW_ID_SEPARATOR))
    return F.substr(v, F.lit(1), keep), date.cast("date")


def month_range(start: Column, end: Column) -> Column:
    """Array of the first days of all months from start to end, both included."""
    return F.sequence(
        F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("INTERVAL 1 MONTH")
    )


def emb_to_array(columns: list[str]) -> Column:
    ordered = sorted(columns, key=lambda c: int(c.rsplit("_", 1)[1]))
    if ordered != [f"emb_{i}" for i in builtins.range(len(ordered))]:
        raise ValueError("embedding columns must be contiguous emb_0..emb_N")
    return F.array(*[F.col(c) for c in ordered])


def emb_to_wide(c: Column | str, dim: int) -> list[Column]:
    return [F.get(_c(c), F.lit(i)).alias(f"emb_{i}") for i in builtins.range(dim)]


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def count_edges_at_most(edges: Column, v: Column, n: int) -> Column:
    """Number of the first ``n`` edges that are <= v, i.e. the index of the right-open bin
    v falls into. One short loop per column: unrolled tests of several columns make a method
    that is too long for the compiler and runs several times slower."""
    return F.coalesce(F.size(F.filter(F.slice(edges, 1, n), lambda e: e <= v)), F.lit(0))
