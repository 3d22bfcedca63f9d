"""Bring differently shaped ledgers and target panels to one layout; daily roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.functions.scalars import as_code
from ledgerflow.schema import EventSchema
from ledgerflow.sources.readers import materialise


def minmax_scale(df: DataFrame, c: str) -> DataFrame:
    """(c - min) / span with span 0 -> 1. The bounds are one aggregate row."""
    bounds = df.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias("b")).scalar()
    b = df.select("*", bounds.alias("_b"))
    span = F.col("_b.hi") - F.col("_b.lo")
    scaled = (F.col(c) - F.col("_b.lo")) / F.when(span > 0, span).otherwise(F.lit(1.0))
    return b.withColumn(c, scaled).drop("_b")


def conform_events(
    df: DataFrame,
    slots: Mapping[str, str],
    codes: Sequence[str] = (),
    placeholders: Sequence[str] = (),
    scale: str | None = None,
) -> DataFrame:
    """Named fields -> layout slots. ``codes`` are cast to BIGINT, ``placeholders`` are
    constant 0 slots, ``scale`` names the output slot to min-max scale."""
    out = df.select(
        *[(as_code(src) if src in codes else F.col(src)).alias(dst) for src, dst in slots.items()],
        *[F.lit(0).cast("bigint").alias(p) for p in placeholders],
    )
    return minmax_scale(out, scale) if scale else out


def daily_rollup(events: DataFrame, schema: EventSchema, value: str) -> DataFrame:
    """One row per (client, day, category combination); NULL categories form groups.
    The value is summed and never part of the key."""
    return events.groupBy(
        schema.client, F.to_date(schema.time).alias(schema.time), *schema.categories
    ).agg(F.sum(value).alias(value))


def daily_sum(events: DataFrame, client: str, time: str, value: str) -> DataFrame:
    return events.groupBy(client, F.to_date(time).alias("day")).agg(
        F.sum(F.col(value).cast("double")).alias("value")
    )


def rollup_audit(events: DataFrame, rolled: DataFrame, schema: EventSchema, value: str) -> DataFrame:
    """One row: duplicate groups, scaled range and client counts before and after. The roll-up
    is computed once and read from its table."""
    keys = [schema.client, schema.time, *schema.categories]
    rolled = materialise(rolled)
    groups = rolled.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    dup = groups.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.sum("n").alias("rolled_rows"),
        F.count_distinct(schema.client).alias("rolled_clients"),
    )
    span = minmax_scale(rolled, value).agg(
        F.min(value).alias("scaled_min"), F.max(value).alias("scaled_max")
    )
    before = events.agg(
        F.count(F.lit(1)).alias("event_rows"), F.count_distinct(schema.client).alias("event_clients")
    )
    one = F.lit(1).alias("_k")
    parts = [p.select("*", one) for p in (dup, span, before)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "_k")
    return out.drop("_k")


def conform_targets(
    df: DataFrame, client: str, month: str, labels: Mapping[str, str], fold: str | None = None
) -> DataFrame:
    """Month-end dated labels -> (id, month start, label slots[, fold])."""
    return df.select(
        F.col(client).alias("id"),
        F.trunc(F.to_date(month), "MM").alias("month"),
        *[F.col(src).cast("int").alias(dst) for src, dst in labels.items()],
        *([F.col(fold).cast("int").alias("fold")] if fold else []),
    )


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mapping_issue_counts(df: DataFrame, mapping: Mapping[str, str | None], categories: Sequence[str]) -> DataFrame:
    """Per category field: infinite and fractional source codes (both must be 0)."""
    used = [f for f in categories if mapping.get(f)]
    aggs = []
    for i, f in enumerate(used):
        v = F.col(mapping[f]).cast("double")
        inf = F.abs(v) == F.lit(float("inf"))
        aggs.append(F.count_if(inf).alias(f"i{i}"))
        aggs.append(F.count_if(~inf & ~F.isnan(v) & (v != F.floor(v))).alias(f"f{i}"))
    counts = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"), F.lit(mapping[f]).alias("source"),
                F.col(f"i{i}").alias("infinite"), F.col(f"f{i}").alias("fractional"),
            )
            for i, f in enumerate(used)
        ]
    )
    return counts.select(F.inline(rows))


def apply_mapping(
    df: DataFrame,
    keep: Sequence[str],
    mapping: Mapping[str, str | None],
    categories: Sequence[str],
    numerics: Sequence[str],
    slots: Mapping[str, str],
    layout: Sequence[str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Rows in the target layout. ``mapping`` is field -> source column or None; unfilled
    fields and slots without a field are 0. Bad category codes raise when ``strict``,
    checked inside the projection itself, so the data is read once."""
    numeric_slots = {slots[f] for f in numerics}
    out: dict[str, Column] = {
        s: F.lit(0.0) if s in numeric_slots else F.lit(0).cast("bigint")
        for s in (layout or list(slots.values()))
    }
    for field, source in mapping.items():
        slot = slots.get(field)
        if source is None or slot not in out:
            continue
        if field in categories:
            v = F.col(source).cast("double")
            code = F.when(~F.isnan(v), as_code(v))
            if strict:
                bad = (F.abs(v) == F.lit(float("inf"))) | (~F.isnan(v) & (v != F.floor(v)))
                message = F.lit(f"{source}: infinite or non-integer category code")
                code = F.when(bad, F.raise_error(message).cast("bigint")).otherwise(code)
            out[slot] = code
        else:
            out[slot] = F.col(source).cast("double")
    return df.select(*keep, *[c.alias(s) for s, c in out.items()])


def source_columns(keep: Sequence[str], mapping: Mapping[str, str | None], required: Sequence[str] | None = None) -> list[str]:
    """The columns of a mapped table that a consumer reads: ``keep`` and the sources of its
    ``required`` fields, each of which must be filled; without a list, the sources of all
    filled fields."""
    if required is not None:
        missing = sorted(f for f in required if mapping.get(f) is None)
        if missing:
            raise ValueError(f"required fields without a source: {missing}")
    sources = dict.fromkeys(mapping[f] for f in (mapping if required is None else required) if mapping[f] is not None)
    return [*keep, *[s for s in sources if s not in keep]]


def apply_for_consumer(
    df: DataFrame, keep: Sequence[str], mapping: Mapping[str, str | None], categories: Sequence[str], numerics: Sequence[str],
    slots: Mapping[str, str], required: Sequence[str] | None = None, layout: Sequence[str] | None = None, strict: bool = True,
) -> DataFrame:
    """``apply_mapping`` for a consumer that needs some fields only: reads their sources and
    returns their slots. Raises when a required field is unfilled or a source column absent."""
    columns = source_columns(keep, mapping, required)
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ValueError(f"mapped source columns missing: {absent}")
    if required is None:
        return apply_mapping(df.select(*columns), keep, mapping, categories, numerics, slots, layout, strict)
    own = {f: mapping[f] for f in required}
    return apply_mapping(df.select(*columns), keep, own, categories, numerics, slots, [slots[f] for f in required], strict)


def rebuild_ledger(
    df: DataFrame,
    keep: Sequence[str],
    mapping: Mapping[str, str | None],
    slots: Mapping[str, str],
    unknown_codes: Mapping[str, int],
    placeholders: Sequence[str] = (),
) -> DataFrame:
    """Project the whole ledger through a mapping. A field without a source gets its
    column's unknown code, not 0: the encoder then treats it as unseen."""
    missing = sorted({s for s in mapping.values() if s} - set(df.columns))
    if missing:
        raise ValueError(f"mapped source columns missing: {missing}")
    cols = []
    for field, slot in slots.items():
        source = mapping.get(field)
        if source is None:
            if slot not in unknown_codes:
                raise ValueError(f"{field}: only a category may be left unfilled")
            cols.append(F.lit(int(unknown_codes[slot])).cast("bigint").alias(slot))
        else:
            cols.append(F.col(source).alias(slot))
    return df.select(*keep, *cols, *[F.lit(0).cast("bigint").alias(p) for p in placeholders])
