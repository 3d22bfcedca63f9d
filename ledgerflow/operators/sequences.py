"""Vocabularies, encoding and event sequences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.functions.ranks import exact_quantiles, number_rows
from ledgerflow.functions.scalars import category_key, epoch_seconds, hash60, uniform
from ledgerflow.operators.windows import latest_events
from ledgerflow.schema import EventSchema
from ledgerflow.sources.readers import attach_row, materialise

DICTIONARY_VALUES = 256  # values of a column that are looked up in a list


def eligible_clients(events: DataFrame, client: str, n: int = 2) -> DataFrame:
    """Clients with at least ``n`` events."""
    counts = events.groupBy(client).agg(F.count(F.lit(1)).alias("n_events"))
    return counts.where(F.col("n_events") >= n)


def category_keys(events: DataFrame, columns: Sequence[str]) -> list[Column]:
    types = dict(events.dtypes)
    return [category_key(c, types[c]) for c in columns]


def fit_vocabulary(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, count, code): codes 1..N by (count desc, value asc); 0 is padding
    and N+1 unknown. One scan for all columns, counted before the shuffle."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), k.alias("value"))
            for c, k in zip(columns, category_keys(events, columns))
        ]
    )
    counts = (
        events.select(F.inline(cells))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return number_rows(counts, ["column"], [F.desc("count"), F.asc("value")], "code")


def vocabulary_sizes(vocabulary: DataFrame) -> DataFrame:
    """Codes plus padding and unknown."""
    return vocabulary.groupBy("column").agg((F.max("code") + 2).alias("size"))


def encode(events: DataFrame, vocabulary: DataFrame, columns: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Adds ``<column><suffix>``; unseen values get N+1.

    Columns of at most DICTIONARY_VALUES values are looked up in lists of one row that every
    task gets, all in one projection: a code is the place in its list. A larger column is
    joined by value, where the planner knows the materialised slice's real size."""
    vocabulary = materialise(vocabulary)
    sizes = {r["column"]: r["n"] for r in vocabulary.groupBy("column").agg(F.max("code").alias("n")).collect()}
    small = [c for c in columns if sizes.get(c, 0) <= DICTIONARY_VALUES]
    out = events
    if small:
        # at most DICTIONARY_VALUES values a column
        listed = vocabulary.where(F.col("column").isin(small)).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("code", "value")))["value"].alias("_v"))
        book = listed.agg(F.struct(*[F.coalesce(F.max(F.when(F.col("column") == c, F.col("_v"))), F.array().cast("array<string>")).alias(c) for c in small]).alias("_book"))
        out = attach_row(out, materialise(book))
    codes = {}
    for c, k in zip(columns, category_keys(events, columns)):
        unknown = F.lit(sizes.get(c, 0) + 1)
        if c in small:
            code = F.nullif(F.array_position(F.col(f"_book.`{c}`"), k), F.lit(0))
        else:
            part = vocabulary.where(F.col("column") == c).select(F.col("value").alias("_key"), F.col("code").alias(f"_code_{c}"))
            out = out.withColumn("_k", k).join(part, F.col("_k") == F.col("_key"), "left").drop("_k", "_key")
            code = F.col(f"_code_{c}")
        codes[c] = F.coalesce(code.cast("bigint"), unknown.cast("bigint"))
    return out.select(*[F.col(c) for c in events.columns], *[v.alias(f"{c}{suffix}") for c, v in codes.items()])


def unknown_counts(coded: DataFrame, vocabulary: DataFrame, columns: Sequence[str], by: Sequence[str] = (), suffix: str = "_code") -> DataFrame:
    """(by, column, n_rows, n_unknown) of encoded rows: one aggregate over the code columns."""
    sizes = {r["column"]: r["n"] for r in vocabulary.groupBy("column").agg(F.max("code").alias("n")).collect()}
    aggs = [F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f"{c}{suffix}") > sizes.get(c, 0)).alias(f"_u{i}") for i, c in enumerate(columns)]]
    cells = [F.struct(F.lit(c).alias("column"), F.col("_rows").alias("n_rows"), F.col(f"_u{i}").alias("n_unknown")) for i, c in enumerate(columns)]
    return coded.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*cells)))


def unknown_rates(events: DataFrame, vocabulary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows per column whose value is not in the vocabulary."""
    vocabulary = materialise(vocabulary)
    counts = unknown_counts(encode(events, vocabulary, columns), vocabulary, columns)
    return counts.withColumn("unknown_rate", F.try_divide("n_unknown", "n_rows"))


def factorise(df: DataFrame, c: str) -> DataFrame:
    """(value, count, code): sorted 0-based codes of the non-null marks of a column."""
    marks = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(
        F.count(F.lit(1)).alias("count")
    )
    numbered = number_rows(marks, [], [F.asc("value")], "code")
    return numbered.withColumn("code", F.col("code") - 1)


def drop_unseen(df: DataFrame, codes: DataFrame, c: str) -> DataFrame:
    """Rows whose mark is known, with its ``code``."""
    known = materialise(codes).select(F.col("value").alias(c), "code")
    return df.join(known, c, "inner")


def unseen_report(df: DataFrame, codes: DataFrame, c: str) -> DataFrame:
    """Per unseen mark: the number of rows that ``drop_unseen`` drops."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n_dropped"))
    return counts.join(codes.select(F.col("value").alias(c)), c, "left_anti")


def _field(array: str, name: str) -> Column:
    return F.transform(array, lambda e: e[name])


def _sorted_events(schema: EventSchema, fields: Mapping[str, Column]) -> Column:
    """Oldest-first array of the group's events. Sort keys lead the struct, so the order
    is total; NULLs sort first."""
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate((schema.time, *schema.features))]
    payload = F.struct(*[v.alias(n) for n, v in fields.items()]).alias("e")
    items = F.sort_array(F.collect_list(F.struct(*keys, payload)))
    return F.transform(items, lambda x: x["e"])


def feature_sequences(
    events: DataFrame,
    schema: EventSchema,
    vocabulary: DataFrame,
    max_events: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    """One row per client (or per client and ``keys``): aligned arrays of epoch seconds,
    category codes and numerics. Sequences are capped to the newest ``max_events`` of each
    client (and ``keys``) before they are gathered, which is also what bounds a group."""
    capped = latest_events(events, max_events, schema, keys)
    coded = encode(capped, vocabulary, schema.categories)
    fields = {"event_time": epoch_seconds(schema.time)}
    fields |= {c: F.col(f"{c}_code") for c in schema.categories}
    fields |= {c: F.col(c).cast("float") for c in schema.numerics}
    seq = coded.groupBy(schema.client, *keys).agg(_sorted_events(schema, fields).alias("_s"))
    return seq.select(
        schema.client, *keys, *[_field("_s", n).alias(n) for n in fields]
    )


def event_sequences(
    events: DataFrame, schema: EventSchema, mark: str, codes: DataFrame, max_events: int
) -> DataFrame:
    """Marked point-process sequences per client: whole days since the client's first
    event, day gaps (first 0.0) and 0-based mark codes; events with unseen marks drop."""
    capped = drop_unseen(latest_events(events, max_events, schema), codes, mark)
    fields = {"t": F.col(schema.time), "code": F.col("code")}
    seq = capped.groupBy(schema.client).agg(_sorted_events(schema, fields).alias("_s"))
    start = F.unix_seconds(F.col("_s")[0]["t"].cast("timestamp"))
    days = F.transform(
        "_s", lambda e: F.floor((F.unix_seconds(e["t"].cast("timestamp")) - start) / F.lit(86400))
    )
    seq = seq.select(schema.client, days.alias("times"), F.transform("_s", lambda e: e["code"]).alias("types"))
    gaps = F.transform(
        "times",
        lambda d, i: F.when(i == 0, F.lit(0.0)).otherwise(
            (d - F.get("times", i - 1)).cast("double")
        ),
    )
    return seq.select(
        schema.client,
        F.transform("times", lambda d: d.cast("double")).alias("times"),
        gaps.alias("deltas"),
        "types",
    )


def _by_client(schema: EventSchema):
    return Window.partitionBy(schema.client).orderBy(*schema.oldest_first())


def days_since_first(events: DataFrame, schema: EventSchema) -> DataFrame:
    """``days`` since the client's own first event and ``delta_days`` to the previous."""
    first = F.min(schema.time).over(Window.partitionBy(schema.client))
    t, t0 = epoch_seconds(schema.time), epoch_seconds(first)
    days = F.floor((t - t0) / F.lit(86400))
    out = events.withColumn("days", days)
    gap = F.col("days") - F.lag("days").over(_by_client(schema))
    return out.withColumn("delta_days", F.coalesce(gap, F.lit(0)))


def client_gaps(capped: DataFrame, schema: EventSchema) -> DataFrame:
    """Per event the seconds since the client's previous event, NULL for its first."""
    t = epoch_seconds(schema.time)
    return capped.withColumn("gap", t - F.lag(t).over(_by_client(schema)))


def prepare_audit(capped: DataFrame, schema: EventSchema, split: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row of preparation counts for an already capped ledger.

    ``split`` has (client, valid). Unknown values are counted over eligible clients
    (two or more events) and category columns, by split."""
    gaps = client_gaps(capped, schema)
    per_client = gaps.groupBy(schema.client).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("gap") == 0).alias("zero_gaps"),
        (F.min(schema.time) == F.max(schema.time)).alias("same_day"),
    )
    clients = materialise(per_client.join(split, schema.client))
    ok = F.col("n") >= 2
    totals = clients.agg(
        F.count(F.lit(1)).alias("clients_total"),
        F.sum("n").alias("events_retained"),
        F.count_if(~ok).alias("short_clients_excluded"),
        F.count_if(ok & ~F.col("valid")).alias("train_clients"),
        F.count_if(ok & F.col("valid")).alias("valid_clients"),
        F.sum("zero_gaps").alias("zero_gap_events"),
        F.count_if("same_day").alias("all_same_day_clients"),
    )
    unknown = split_unknowns(capped, schema, clients.where(ok), vocabulary).agg(
        F.coalesce(F.sum(F.when(~F.col("valid"), F.col("n_unknown"))), F.lit(0)).alias("unknown_train"),
        F.coalesce(F.sum(F.when(F.col("valid"), F.col("n_unknown"))), F.lit(0)).alias("unknown_valid"),
    )
    k = F.lit(1).alias("_k")
    return totals.select("*", k).join(unknown.select("*", k), "_k").drop("_k")


def split_unknowns(capped: DataFrame, schema: EventSchema, clients: DataFrame, vocabulary: DataFrame, strict: bool = False) -> DataFrame:
    """(valid, column, n_rows, n_unknown) over the events of ``clients`` (client, valid). A value of the
    training side that the vocabulary lacks means that it was fitted on something else:
    ``strict`` raises then."""
    vocabulary = materialise(vocabulary)
    coded = encode(capped, vocabulary, schema.categories).join(clients.select(schema.client, "valid"), schema.client)
    counts = materialise(unknown_counts(coded, vocabulary, schema.categories, ["valid"]))
    if strict:
        bad = counts.where("NOT valid AND n_unknown > 0").orderBy("column").collect()  # at most one row a column
        if bad:
            raise ValueError(f"incomplete train vocabulary: {', '.join(f'{r.column} ({r.n_unknown})' for r in bad)}")
    return counts


def interval_stats(capped: DataFrame, schema: EventSchema, train: DataFrame) -> DataFrame:
    """p99 of the train clients' inter-event days and the mean of the intervals up to it."""
    gaps = client_gaps(capped.join(train.select(schema.client), schema.client, "left_semi"), schema)
    days = gaps.where(F.col("gap").isNotNull()).select((F.col("gap") / F.lit(86400.0)).alias("days"))
    counts = materialise(days.groupBy("days").agg(F.count(F.lit(1)).alias("n")))
    p99 = exact_quantiles(counts, [], "days", "n", [0.99]).select(F.col("quantiles")[0].alias("p99"))
    kept = counts.withColumn("p99", p99.scalar())
    return kept.groupBy("p99").agg(
        F.sum("n").alias("n_intervals"),
        F.sum(F.when(F.col("days") <= F.col("p99"), F.col("n"))).alias("n_retained"),
        (
            F.sum(F.when(F.col("days") <= F.col("p99"), F.col("days") * F.col("n")))
            / F.sum(F.when(F.col("days") <= F.col("p99"), F.col("n")))
        ).alias("truncated_mean"),
    )


def next_event_pairs(capped: DataFrame, schema: EventSchema) -> DataFrame:
    """Each event with the features of the client's next one; last events have no pair."""
    w = _by_client(schema)
    nxt = [F.lead(c).over(w).alias(f"next_{c}") for c in (schema.time, *schema.features)]
    step = F.row_number().over(w).alias("position")
    last = F.lead(F.lit(1)).over(w).alias("_more")
    return capped.select("*", step, *nxt, last).where(F.col("_more") == 1).drop("_more")


def masked_events(capped: DataFrame, schema: EventSchema, p: float, seed: int) -> DataFrame:
    """Adds ``position`` and ``masked``: each event with probability ``p``, and the
    lowest-hash event of a client that would otherwise have none."""
    c = schema.client
    placed = capped.withColumn("position", F.row_number().over(_by_client(schema)))
    drawn = placed.withColumn("_h", hash60(seed, c, "position")).withColumn(
        "_u", uniform(seed, c, "position")
    )
    client = Window.partitionBy(c)
    lowest = (F.col("_h") == F.min("_h").over(client)) & (F.min("_u").over(client) >= p)
    return drawn.withColumn("masked", (F.col("_u") < p) | lowest).drop("_h", "_u")


def subsequence_views(
    capped: DataFrame, schema: EventSchema, k: int, shortest: int, longest: int, seed: int
) -> DataFrame:
    """``k`` random contiguous slices per client, as rows (client, view, position, ...).

    Length is uniform in [shortest, longest] cut to the sequence; the start is uniform
    over what fits. Start and length follow from (client, view) alone, so no join; an event is
    copied only into the views that it is in."""
    c = schema.client
    placed = capped.withColumn("position", F.row_number().over(_by_client(schema)) - 1)
    placed = placed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(c)))
    views = F.sequence(F.lit(0), F.lit(k - 1))
    draws = F.transform(views, lambda v: F.struct(
        v.alias("view"),
        (F.lit(shortest) + F.floor(uniform(f"{seed}:len", c, v) * F.lit(longest - shortest + 1))).alias("wanted"),
        uniform(f"{seed}:start", c, v).alias("u")))
    # drawn once per client, on its first event; NULL on the others
    first = F.when(F.col("position") == 0, draws)
    placed = placed.withColumn("_draws", F.first(first, ignorenulls=True).over(Window.partitionBy(c)))
    fits = F.transform("_draws", lambda d: F.struct(d["view"].alias("view"), F.least(d["wanted"], F.col("_n")).alias("len"), d["u"].alias("u")))
    placed = placed.withColumn("_fits", fits)

    def inside(d):
        start = F.floor(d["u"] * (F.col("_n") - d["len"] + 1))
        return (F.col("position") >= start) & (F.col("position") < start + d["len"])

    mine = F.transform(F.filter("_fits", inside), lambda d: d["view"])
    return placed.withColumn("view", F.explode(mine)).drop("_n", "_draws", "_fits")
