"""Point-in-time windows over a ledger, and the regular daily series cut from them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.schema import EventSchema

WINDOW_ROWS = 100_000  # rows of windows that a task holds on average


def latest_events(events: DataFrame, n: int, schema: EventSchema, keys: Sequence[str] = ()) -> DataFrame:
    """The ``n`` newest events per client (and ``keys``). ``row_number <= n`` prunes every map task to
    ``n`` rows per client before the shuffle, so a very active client stays small."""
    w = Window.partitionBy(schema.client, *keys).orderBy(*schema.newest_first())
    return events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def _grid(dates: Sequence[str | date]) -> list[date]:
    days = sorted({date.fromisoformat(str(d)) for d in dates})
    if not days:
        raise ValueError("no target dates")
    return days


def in_order(events: DataFrame, schema: EventSchema) -> DataFrame:
    """A capped ledger with each client's events together, oldest first, NULLs first."""
    placed = events.repartition(schema.client)
    return placed.sortWithinPartitions(F.col(schema.client), *schema.oldest_first())


class _Grid:
    """Sorted target dates with their trailing windows.

    An event lies in the windows from the first date it precedes to the last one whose
    start it follows: both are counts over the grid, so its windows are a slice of the
    grid. No join with the dates is needed."""

    def __init__(self, t: Column, dates: Sequence[str | date], months: int, include_cutoff: bool):
        days = _grid(dates)
        self.t, self.months, self.include_cutoff = t, months, include_cutoff
        self.days = days
        self.ends = F.array(*[F.lit(d) for d in days])
        self.bounds = self.before(F.lit(days[-1])) & (t > self.start(F.lit(days[0])))
        self.bits = len(days).bit_length()

    def start(self, d: Column) -> Column:
        return F.add_months(d, -self.months)

    def before(self, d: Column) -> Column:
        return self.t <= d if self.include_cutoff else self.t < d

    def _count(self, df: DataFrame, name: str, test) -> DataFrame:
        """Adds the number of leading grid dates that pass ``test``: binary search, one
        generated projection per bit."""
        df = df.withColumn(name, F.lit(0))
        for bit in reversed(range(self.bits)):
            step = 1 << bit
            passes = test(F.get(self.ends, F.col(name) + F.lit(step - 1)))
            df = df.withColumn(name, F.col(name) + F.when(passes, step).otherwise(0))
        return df

    @staticmethod
    def explode(df: DataFrame, ends: Column) -> DataFrame:
        mine = F.slice(ends, F.col("_passed") + 1, F.col("_started") - F.col("_passed"))
        return df.withColumn("target_date", F.explode(mine)).drop("_passed", "_started")

    def place(self, df: DataFrame) -> DataFrame:
        """Rows between the first start and the last date, with their slice of the grid. It is empty
        where the grid leaves a gap; explode drops those rows. A filter on both counts here would
        be pushed below the projections, each test repeated once per bit and more."""
        placed = self._count(df.where(self.bounds), "_passed", lambda d: ~self.before(d))
        return self._count(placed, "_started", lambda d: self.t > self.start(d))


def windows(
    events: DataFrame,
    schema: EventSchema,
    dates: Sequence[str | date],
    months: int,
    max_events: int | None = None,
    include_cutoff: bool = False,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """History of each (client, target date): ``t > d - months`` and ``t < d`` (``<=``
    with ``include_cutoff``), newest ``max_events`` kept.

    Windows overlap, and shuffling the exploded rows would move each event once per
    window. Instead the cap is applied first per (client, grid segment): no window ever
    splits a segment, hence the newest N of a segment contain the newest N of every
    window. That bounds a client to N rows per segment, and the rows are then placed by client
    alone. There an event's rank in a window is its rank among all of the client's events
    less the number of those newer than the window, so rows are sorted once, before they
    are exploded, and only rows that stay are exploded. A first pass over the times counts the
    rows of all windows; their number decides the number of tasks, so a task's memory does
    not grow with the ledger.

    ``wanted`` (client, target_date) says which windows are asked for; events are not copied into
    others. Each client's dates, at most those of the grid, come to its events.
    """
    grid = _Grid(F.col(schema.time), dates, months, include_cutoff)
    placed = grid.place(events)
    if max_events is None:
        out = grid.explode(placed, grid.ends)
        return out if wanted is None else out.join(wanted.select(schema.client, "target_date"), [schema.client, "target_date"], "left_semi")
    by_segment = Window.partitionBy(schema.client, "_passed", "_started").orderBy(*schema.newest_first())
    total = placed.agg(F.sum(F.col("_started") - F.col("_passed"))).first()[0] or 0
    tasks = max(events.sparkSession.sparkContext.defaultParallelism, -(-total // WINDOW_ROWS))
    capped = (
        placed.withColumn("_rn", F.row_number().over(by_segment))
        .where(F.col("_rn") <= max_events)
        .drop("_rn")
        .repartition(tasks, schema.client)
    )
    if wanted is not None:
        own = wanted.groupBy(schema.client).agg(F.collect_set(F.col("target_date").cast("date")).alias("_wanted"))
        capped = capped.join(own, schema.client)
    client = Window.partitionBy(schema.client)
    newest = client.orderBy(*schema.newest_first())
    # rows of the client per segment start, in the order of the grid
    newer = F.array(*[F.count_if(F.col("_passed") > g).over(client) for g in range(len(grid.days))])
    ranked = capped.withColumn("_rn", F.row_number().over(newest)).withColumn("_newer", newer)
    ends = F.filter(
        F.transform(grid.ends, lambda d, g: F.when((g >= F.col("_passed")) & (g < F.col("_started")) & (F.col("_rn") - F.get("_newer", g) <= max_events), d)),
        lambda d: d.isNotNull(),
    )
    if wanted is not None:
        ends = F.array_intersect(ends, "_wanted")
    return ranked.withColumn("target_date", F.explode(ends)).drop("_passed", "_started", "_rn", "_newer", "_wanted")


def labelled_only(events: DataFrame, targets: DataFrame, client: str) -> DataFrame:
    return events.join(targets.select(client), client, "left_semi")


def dense_daily(daily: DataFrame, client: str, day: str = "day", value: str = "value") -> DataFrame:
    """Every day from a client's first to last one; days without events are 0."""
    span = daily.groupBy(client).agg(
        F.explode(F.sequence(F.min(day), F.max(day))).alias(day)
    )
    return span.join(daily, [client, day], "left").select(
        client, day, F.coalesce(F.col(value), F.lit(0.0)).alias(value)
    )


def window_series(
    daily: DataFrame,
    client: str,
    dates: Sequence[str | date],
    months: int,
    day: str = "day",
    value: str = "value",
) -> DataFrame:
    """One fixed-length array per (client, date): daily values strictly between the
    window's start day and the date, zero where nothing happened. Clients without a
    single day in a window get no row. ``daily`` has one row per client and day, so an
    array never exceeds the days of a window.

    A client's days are brought together once, whatever the number of windows; each window takes
    its days from that sorted array, and its series is laid out in one pass over them: the
    zeros since the last day, then the day's value."""
    grid = _Grid(F.col(day), dates, months, include_cutoff=False)
    own = grid.place(daily).groupBy(client).agg(
        F.array_sort(F.collect_list(F.struct(F.col(day).cast("date").alias("d"), F.col(value).cast("float").alias("v")))).alias("_days")
    )
    rows = own.select(client, "_days", F.explode(grid.ends).alias("target_date")).withColumn("_start", F.add_months("target_date", -months))
    rows = rows.withColumn("_days", F.filter("_days", lambda e: (e["d"] > F.col("_start")) & (e["d"] < F.col("target_date")))).where(F.size("_days") > 0)
    zero = F.lit(0.0).cast("float")

    def laid(e, i):
        before = F.coalesce(F.get("_days", i - 1)["d"], F.col("_start"))
        return F.concat(F.array_repeat(zero, F.date_diff(e["d"], before) - 1), F.array(F.coalesce(e["v"], zero)))

    rest = F.array_repeat(zero, F.date_diff("target_date", F.element_at("_days", -1)["d"]) - 1)
    series = F.concat(F.flatten(F.transform("_days", laid)), rest)
    return rows.select(client, "target_date", series.alias("series"))
