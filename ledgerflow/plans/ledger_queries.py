"""Queries over ledgers: sources, conforming, roll-ups, windows and daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.functions import scalars as S
from ledgerflow.operators import conform, windows
from ledgerflow.plans.registry import query
from ledgerflow.plans.standins import (
    CATEGORIES, DOUBLE_CODES, FEATURES_DESC, LEDGER, LEDGER_SQL, PANEL_SQL, RAW_SQL, SLOTS, TARGETS_SQL, capped_sql,
    ledger, panel, raw_ledger, sql_hash, sql_shard, table, targets,
)
from ledgerflow.schema import EventSchema
from ledgerflow.sources import readers, writers

# -- sources ---------------------------------------------------------------------------


@query("ledger_scan", "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders")
def _(spark, sf):
    df = readers.read_ledger(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    return df.withColumn("o_orderdate", F.to_date("o_orderdate")).withColumnRenamed("o_orderdate", "day")


@query("client_ids", "SELECT DISTINCT o_custkey FROM orders")
def _(spark, sf):
    return readers.client_ids(table(spark, sf, "orders"), "o_custkey")


@query("sample_clients", f"""SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders)
  ORDER BY {sql_hash('7', 'o_custkey')}, o_custkey LIMIT 100""")
def _(spark, sf):
    return readers.sample_clients(table(spark, sf, "orders"), "o_custkey", 100, 7)


@query("sample_rows", f"""SELECT event_id, user_id, value FROM events
  ORDER BY {sql_hash('11', 'event_id')}, event_id LIMIT 500""")
def _(spark, sf):
    return readers.sample_rows(table(spark, sf, "events"), 500, 11, ["event_id"]).select("event_id", "user_id", "value")


@query("rows_for_clients", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
  WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(spark, sf):
    ids = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return readers.rows_for_clients(table(spark, sf, "orders"), ids, "o_custkey", ["o_orderkey", "o_custkey", "o_totalprice"])


@query("shard_counts", f"""SELECT {sql_shard(16, 'o_custkey')} AS shard, count(*) AS n_rows,
  count(DISTINCT o_custkey) AS n_clients FROM orders GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("shard", S.shard_of(16, "o_custkey"))
    return o.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_clients"))


def _expected_shards(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(S.shard_of(64, "o_custkey").alias("shard"), F.year("o_orderdate").alias("year")).distinct()


_EXPECTED = f"exp AS (SELECT DISTINCT {sql_shard(64, 'o_custkey')} AS shard, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)"
_RUNS = f"""runs AS (SELECT {sql_shard(64, 'o_custkey')} AS shard, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE WHEN max(o_totalprice) > 480000 THEN 'b' ELSE 'a' END AS settings
  FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1, 2)"""


def _runs(spark, sf):
    """Finished parts: a part is done when its shard and year had an urgent, filled order."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
    return o.groupBy(S.shard_of(64, "o_custkey").alias("shard"), F.year("o_orderdate").alias("year")).agg(
        F.when(F.max("o_totalprice") > 480000, "b").otherwise("a").alias("settings")
    )


@query("pending_parts", f"WITH {_EXPECTED}, {_RUNS} SELECT shard, year FROM exp ANTI JOIN runs USING (shard, year)")
def _(spark, sf):
    return writers.pending(_expected_shards(spark, sf), _runs(spark, sf), ["shard", "year"])


@query("pending_work", f"""WITH {_EXPECTED}, {_RUNS}
  SELECT shard, year, 'a' AS settings, runs.settings IS NOT NULL AS conflict
  FROM exp LEFT JOIN runs USING (shard, year) WHERE runs.settings IS NULL OR runs.settings <> 'a'""")
def _(spark, sf):
    expected = _expected_shards(spark, sf).withColumn("settings", F.lit("a"))
    return writers.pending_work(expected, _runs(spark, sf), ["shard", "year"])


@query("finalize_missing", f"""WITH {_EXPECTED}, {_RUNS}, done AS (SELECT shard, count(DISTINCT year) AS n FROM runs GROUP BY 1),
  want AS (SELECT shard, count(DISTINCT year) AS n_expected FROM exp GROUP BY 1)
  SELECT shard, n_expected, coalesce(n, 0) AS n_done, coalesce(n, 0) = n_expected AS complete
  FROM want LEFT JOIN done USING (shard)""")
def _(spark, sf):
    want = _expected_shards(spark, sf).groupBy("shard").agg(F.count_distinct("year").alias("n_expected"))
    missing = writers.pending(_expected_shards(spark, sf), _runs(spark, sf), ["shard", "year"])
    gaps = missing.groupBy("shard").agg(F.count(F.lit(1)).alias("_m"))
    n_missing = F.coalesce("_m", F.lit(0))
    return want.join(gaps, "shard", "left").select(
        "shard", "n_expected", (F.col("n_expected") - n_missing).alias("n_done"), (n_missing == 0).alias("complete")
    )


@query("cohort_fingerprint", f"""WITH {TARGETS_SQL}, h AS (SELECT fold, {sql_hash('cohort', 'id', 'month', 'y1', 'y2', 'y3')} AS h FROM tgt)
  SELECT fold, count(*) AS n_rows, bit_xor(h) AS hash_xor, CAST(sum(h % 1000000007) AS BIGINT) AS hash_sum FROM h GROUP BY 1""")
def _(spark, sf):
    t = targets(spark, sf)
    return t.groupBy("fold").agg(*writers.cohort_hash(["id", "month", "y1", "y2", "y3"]))


# -- projections and predicates --------------------------------------------------------


@query("conform_events", f"""WITH {RAW_SQL}, b AS (SELECT min(amount) AS lo, max(amount) AS hi FROM raw)
  SELECT client_id AS id, epoch(event_time)::BIGINT AS t, CAST(round_even(event_type, 0) AS BIGINT) AS col_2, event_subtype AS col_3,
    currency AS col_4, CAST(round_even(src_a, 0) AS BIGINT) AS col_5, CAST(round_even(src_b, 0) AS BIGINT) AS col_6,
    dst_a AS col_7, CAST(round_even(dst_b, 0) AS BIGINT) AS col_8, round((amount - lo) / (hi - lo), 9) AS col_11,
    balance AS col_12, 0::BIGINT AS col_15, 0::BIGINT AS col_16 FROM raw, b""")
def _(spark, sf):
    slots = {"client_id": "id", "event_time": "t", **SLOTS}
    df = conform.conform_events(raw_ledger(spark, sf), slots, DOUBLE_CODES, ["col_15", "col_16"], "col_11")
    return df.withColumn("t", S.epoch_seconds("t")).withColumn("col_11", F.round("col_11", 9))


@query("integer_codes", """SELECT CAST(round_even(l_extendedprice / 1000, 0) AS BIGINT) AS code, count(*) AS n,
  CAST(sum(CASE WHEN l_tax = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_untaxed FROM lineitem GROUP BY 1""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(S.as_code(F.col("l_extendedprice") / 1000).alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_tax") == 0).alias("n_untaxed")
    )


@query("minmax_scale", """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
  SELECT o_orderkey, round((o_totalprice - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 9) AS o_totalprice FROM orders, b""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return conform.minmax_scale(o, "o_totalprice").withColumn("o_totalprice", F.round("o_totalprice", 9))


@query("conform_targets", f"""WITH {TARGETS_SQL} SELECT id, month, y1 AS col_2, y2 AS col_3, y3 AS col_4, fold FROM tgt""")
def _(spark, sf):
    raw = targets(spark, sf).withColumn("mon", F.last_day("month").cast("string"))
    return conform.conform_targets(raw, "id", "mon", {"y1": "col_2", "y2": "col_3", "y3": "col_4"}, "fold")


@query("window_ids", """SELECT o_orderkey, o_custkey || '::' || o_orderpriority || '::' || strftime(o_orderdate, '%Y-%m-%d') AS window_id,
  o_custkey || '::' || o_orderpriority AS client, CAST(o_orderdate AS DATE) AS date FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    client = F.concat_ws("::", F.col("o_custkey").cast("string"), "o_orderpriority")
    o = o.select("o_orderkey", S.stamp_window_id(client, F.to_date("o_orderdate")).alias("window_id"))
    client, date = S.split_window_id("window_id")
    return o.select("o_orderkey", "window_id", client.alias("client"), date.alias("date"))


_ODD = """CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE WHEN l_linenumber = 6 THEN 'Infinity'::DOUBLE
  WHEN l_linenumber = 5 THEN '-Infinity'::DOUBLE WHEN l_linenumber = 4 THEN NULL ELSE l_extendedprice END"""


@query("finite_values", f"""WITH v AS (SELECT l_returnflag, {_ODD} AS v FROM lineitem)
  SELECT l_returnflag, count(*) AS n_rows, count(v) FILTER (WHERE isfinite(v)) AS n_finite,
    round(max(v) FILTER (WHERE isfinite(v)), 2) AS max_v FROM v GROUP BY 1""")
def _(spark, sf):
    n = F.col("l_linenumber")
    odd = (
        F.when(n == 7, F.lit(float("nan"))).when(n == 6, F.lit(float("inf"))).when(n == 5, F.lit(float("-inf")))
        .when(n == 4, F.lit(None).cast("double")).otherwise(F.col("l_extendedprice"))
    )
    li = table(spark, sf, "lineitem").select("l_returnflag", S.finite(odd).alias("v"))
    return li.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_finite"), F.round(F.max("v"), 2).alias("max_v")
    )


@query("category_keys", f"""WITH {RAW_SQL}, k AS (
    SELECT 'event_type' AS field, coalesce(CAST(CAST(event_type AS BIGINT) AS VARCHAR), '<MISSING>') AS key FROM raw
    UNION ALL SELECT 'currency', coalesce(CAST(currency AS VARCHAR), '<MISSING>') FROM raw
    UNION ALL SELECT 'dst_b', coalesce(CAST(CAST(dst_b AS BIGINT) AS VARCHAR), '<MISSING>') FROM raw
    UNION ALL SELECT 'text', CAST(event_subtype AS VARCHAR) FROM raw)
  SELECT field, key, count(*) AS n FROM k GROUP BY 1, 2""")
def _(spark, sf):
    raw = raw_ledger(spark, sf)
    cells = F.array(
        F.struct(F.lit("event_type").alias("field"), S.category_key("event_type", "double").alias("key")),
        F.struct(F.lit("currency").alias("field"), S.category_key("currency", "bigint").alias("key")),
        F.struct(F.lit("dst_b").alias("field"), S.category_key("dst_b", "double").alias("key")),
        F.struct(F.lit("text").alias("field"), S.category_key(F.concat(F.col("event_subtype").cast("string"), F.lit(".0"))).alias("key")),
    )
    return raw.select(F.inline(cells)).groupBy("field", "key").agg(F.count(F.lit(1)).alias("n"))


_MAPPING = {
    "event_type": "event_type", "event_subtype": "event_type", "currency": None, "src_a": "dst_a",
    "src_b": "currency", "dst_a": "event_subtype", "dst_b": "event_subtype", "amount": "balance", "balance": None,
}


@query("apply_mapping", f"""WITH {RAW_SQL} SELECT client_id, l_orderkey, CAST(event_type AS BIGINT) AS col_2, CAST(event_type AS BIGINT) AS col_3,
    0::BIGINT AS col_4, dst_a AS col_5, currency AS col_6, event_subtype AS col_7, event_subtype AS col_8, balance AS col_11, 0.0::DOUBLE AS col_12
  FROM raw""")
def _(spark, sf):
    raw = raw_ledger(spark, sf)
    return conform.apply_mapping(raw, ["client_id", "l_orderkey"], _MAPPING, CATEGORIES, ("amount", "balance"), SLOTS)


@query("apply_for_consumer", f"""WITH {RAW_SQL} SELECT client_id, l_orderkey, CAST(event_type AS BIGINT) AS col_2, balance AS col_11 FROM raw""")
def _(spark, sf):
    """What a consumer of one category and one number gets from the mapped ledger."""
    raw = raw_ledger(spark, sf)
    return conform.apply_for_consumer(raw, ["client_id", "l_orderkey"], _MAPPING, CATEGORIES, ("amount", "balance"), SLOTS, ["event_type", "amount"])


@query("mapping_issue_counts", f"""WITH {RAW_SQL}, v AS (SELECT 'event_type' AS field, 'event_type' AS source, event_type AS v FROM raw
    UNION ALL SELECT 'src_a', 'src_a', src_a FROM raw UNION ALL SELECT 'src_b', 'amount', amount FROM raw
    UNION ALL SELECT 'dst_b', 'balance', CASE WHEN balance > 400000 THEN 'Infinity'::DOUBLE ELSE balance END FROM raw)
  SELECT field, source, count(*) FILTER (WHERE isinf(v)) AS infinite, count(*) FILTER (WHERE isfinite(v) AND v <> floor(v)) AS fractional
  FROM v GROUP BY 1, 2""")
def _(spark, sf):
    raw = raw_ledger(spark, sf)
    raw = raw.withColumn("balance", F.when(F.col("balance") > 400000, F.lit(float("inf"))).otherwise(F.col("balance")))
    mapping = {"event_type": "event_type", "src_a": "src_a", "src_b": "amount", "dst_b": "balance", "dst_a": None}
    return conform.mapping_issue_counts(raw, mapping, CATEGORIES)


@query("rebuild_ledger", f"""WITH {LEDGER_SQL}, n AS (SELECT count(DISTINCT currency) + 1 AS u FROM led)
  SELECT client_id, event_type AS col_2, event_type AS col_3, 6::BIGINT AS col_4, dst_a AS col_5, currency AS col_6, event_subtype AS col_7,
    event_subtype AS col_8, balance AS col_11, balance AS col_12, 0::BIGINT AS col_15 FROM led""")
def _(spark, sf):
    mapping = {**_MAPPING, "balance": "balance"}
    return conform.rebuild_ledger(ledger(spark, sf), ["client_id"], mapping, SLOTS, {"col_4": 6}, ["col_15"])


@query("epoch_seconds", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", S.epoch_seconds("ts").alias("seconds"))


@query("month_grid", """SELECT o_custkey, CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS DATE) AS month
  FROM orders GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    span = o.groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return span.select("o_custkey", F.explode(S.month_range(F.col("a"), F.col("b"))).alias("month"))


@query("embedding_wide", "SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS emb_{i}" for i in range(64)) + " FROM embeddings")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    wide = e.select("vec_id", *S.emb_to_wide("embedding", 64))
    back = wide.select("vec_id", S.emb_to_array([c for c in wide.columns if c != "vec_id"]).alias("v"))
    return back.select("vec_id", *[F.get("v", F.lit(i)).cast("double").alias(f"emb_{i}") for i in range(64)])


@query("window_history", f"""WITH {LEDGER_SQL}, d AS (SELECT unnest([DATE '1996-07-01', DATE '1998-01-01', DATE '1998-03-01']) AS target_date)
  SELECT client_id, target_date, count(*) AS n_events, round(sum(amount), 2) AS amount FROM led, d
  WHERE event_time <= target_date AND event_time > target_date - INTERVAL 6 MONTH GROUP BY 1, 2""")
def _(spark, sf):
    w = windows.windows(ledger(spark, sf), LEDGER, ["1998-03-01", "1996-07-01", "1998-01-01"], 6, include_cutoff=True)
    return w.groupBy("client_id", "target_date").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("amount"), 2).alias("amount"))


@query("fold_members", f"""WITH {TARGETS_SQL} SELECT id, month, fold FROM tgt WHERE fold IN (0, 3) AND month IN (DATE '1997-01-01', DATE '1998-06-01')""")
def _(spark, sf):
    t = targets(spark, sf)
    return t.where(F.col("fold").isin(0, 3) & F.col("month").isin(F.lit("1997-01-01").cast("date"), F.lit("1998-06-01").cast("date"))).select("id", "month", "fold")


# -- joins and windows -----------------------------------------------------------------

MONTHS_1998 = [f"1998-{m:02d}-01" for m in range(1, 13)]


@query("windows_latest_n", f"""WITH {LEDGER_SQL}, d AS (SELECT CAST(unnest(generate_series(DATE '1998-01-01', DATE '1998-12-01', INTERVAL 1 MONTH)) AS DATE) AS target_date),
  w AS (SELECT * FROM led, d WHERE event_time < target_date AND event_time > target_date - INTERVAL 12 MONTH
    QUALIFY row_number() OVER (PARTITION BY client_id, target_date ORDER BY {FEATURES_DESC}) <= 5)
  SELECT client_id || '::' || CAST(target_date AS VARCHAR) AS window_id, count(*) AS n_events, round(sum(amount), 2) AS amount,
    CAST(sum(event_type) AS BIGINT) AS type_sum, min(CAST(event_time AS DATE)) AS first_day, max(CAST(event_time AS DATE)) AS last_day
  FROM w GROUP BY client_id, target_date""")
def windows_latest_n(spark, sf):
    """For each client and month start, the last five events of the trailing year."""
    w = windows.windows(ledger(spark, sf), LEDGER, MONTHS_1998, 12, max_events=5)
    g = w.groupBy("client_id", "target_date").agg(
        F.count(F.lit(1)).alias("n_events"), F.round(F.sum("amount"), 2).alias("amount"),
        F.sum("event_type").alias("type_sum"), F.min(F.to_date("event_time")).alias("first_day"),
        F.max(F.to_date("event_time")).alias("last_day"),
    )
    return g.select(S.stamp_window_id("client_id", "target_date").alias("window_id"), *g.columns[2:])


@query("latest_events", f"""WITH {capped_sql(10)} SELECT client_id, CAST(epoch(event_time) AS BIGINT) AS t, event_type, event_subtype,
  currency, src_a, amount FROM cap""")
def _(spark, sf):
    df = windows.latest_events(ledger(spark, sf), 10, LEDGER)
    return df.select("client_id", S.epoch_seconds("event_time").alias("t"), "event_type", "event_subtype", "currency", "src_a", "amount")


@query("labelled_events", f"""WITH {LEDGER_SQL}, {TARGETS_SQL} SELECT client_id, count(*) AS n, round(sum(balance), 2) AS balance FROM led
  WHERE client_id IN (SELECT id FROM tgt WHERE y2 = 1 AND month >= DATE '2000-01-01') GROUP BY 1""")
def _(spark, sf):
    t = targets(spark, sf).where("y2 = 1 AND month >= DATE '2000-01-01'").select(F.col("id").alias("client_id"))
    df = windows.labelled_only(ledger(spark, sf), t, "client_id")
    return df.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


_DAILY = "day AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS value FROM events GROUP BY 1, 2)"


@query("daily_sum", f"WITH {_DAILY} SELECT user_id, day, round(value, 4) AS value FROM day")
def _(spark, sf):
    return conform.daily_sum(table(spark, sf, "events"), "user_id", "ts", "value").withColumn("value", F.round("value", 4))


@query("dense_daily", f"""WITH {_DAILY}, span AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM day GROUP BY 1)
  SELECT user_id, day, round(coalesce(value, 0), 4) AS value FROM span LEFT JOIN day USING (user_id, day)""")
def _(spark, sf):
    daily = conform.daily_sum(table(spark, sf, "events"), "user_id", "ts", "value")
    return windows.dense_daily(daily, "user_id").withColumn("value", F.round("value", 4))


@query("window_series", f"""WITH {LEDGER_SQL}, d AS (SELECT unnest([DATE '1998-01-01', DATE '1998-03-31']) AS target_date),
  day AS (SELECT client_id, CAST(event_time AS DATE) AS day, sum(amount) AS value FROM led GROUP BY 1, 2),
  w AS (SELECT client_id, target_date, day - CAST(target_date - INTERVAL 1 MONTH AS DATE) AS pos, CAST(value AS FLOAT) AS value,
      target_date - CAST(target_date - INTERVAL 1 MONTH AS DATE) - 1 AS len
    FROM day, d WHERE day < target_date AND day > CAST(target_date - INTERVAL 1 MONTH AS DATE))
  SELECT client_id, target_date, CAST(max(len) AS BIGINT) AS length, CAST(min(pos) AS BIGINT) AS first_pos, count(*) FILTER (WHERE value <> 0) AS n_nonzero,
    round(sum(CAST(value AS DOUBLE)), 1) AS total FROM w GROUP BY 1, 2""")
def _(spark, sf):
    daily = conform.daily_sum(ledger(spark, sf), "client_id", "event_time", "amount")
    s = windows.window_series(daily, "client_id", ["1998-01-01", "1998-03-31"], 1)
    # The array holds a day with a zero sum as zero too; the first day with events is read from the ledger side.
    present = daily.select("client_id", "day")
    first = s.join(present, "client_id").where(
        (F.col("day") < F.col("target_date")) & (F.col("day") > F.add_months("target_date", -1))
    ).groupBy("client_id", "target_date").agg(
        F.min(F.date_diff("day", F.add_months("target_date", -1))).cast("bigint").alias("first_pos")
    )
    total = F.aggregate("series", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return s.select(
        "client_id", "target_date", F.size("series").cast("bigint").alias("length"),
        F.size(F.filter("series", lambda x: x != 0)).cast("bigint").alias("n_nonzero"), F.round(total, 1).alias("total"),
    ).join(first, ["client_id", "target_date"])


# -- roll-ups --------------------------------------------------------------------------

_CATS = ", ".join(CATEGORIES)
_ROLLED = f"rolled AS (SELECT client_id, CAST(event_time AS DATE) AS event_time, {_CATS}, sum(amount) AS amount FROM led GROUP BY ALL)"


@query("daily_rollup", f"WITH {LEDGER_SQL}, {_ROLLED} SELECT client_id, event_time, {_CATS}, round(amount, 2) AS amount FROM rolled")
def _(spark, sf):
    return conform.daily_rollup(ledger(spark, sf), LEDGER, "amount").withColumn("amount", F.round("amount", 2))


@query("daily_rollup_events", """SELECT user_id, CAST(ts AS DATE) AS ts, event_type, round(sum(value), 4) AS value FROM events GROUP BY 1, 2, 3""")
def _(spark, sf):
    schema = EventSchema("user_id", "ts", ("event_type",), ("value",))
    return conform.daily_rollup(table(spark, sf, "events"), schema, "value").withColumn("value", F.round("value", 4))


@query("rollup_audit", f"""WITH {LEDGER_SQL}, {_ROLLED} SELECT 0::BIGINT AS duplicate_groups, (SELECT count(*) FROM rolled) AS rolled_rows,
  0.0::DOUBLE AS scaled_min, 1.0::DOUBLE AS scaled_max, (SELECT count(*) FROM led) AS event_rows,
  (SELECT count(DISTINCT client_id) FROM led) AS event_clients, (SELECT count(DISTINCT client_id) FROM rolled) AS rolled_clients""")
def _(spark, sf):
    events = ledger(spark, sf)
    return conform.rollup_audit(events, conform.daily_rollup(events, LEDGER, "amount"), LEDGER, "amount")


# -- sets ------------------------------------------------------------------------------


@query("union_parts", """SELECT 'events' AS part, user_id AS client_id, CAST(ts AS DATE) AS day, round(value, 4) AS amount FROM events
  UNION ALL SELECT 'orders', o_custkey, CAST(o_orderdate AS DATE), round(o_totalprice, 4) FROM orders""")
def _(spark, sf):
    e = table(spark, sf, "events").select(F.lit("events").alias("part"), F.col("user_id").alias("client_id"), F.to_date("ts").alias("day"), F.round("value", 4).alias("amount"))
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("client_id"), F.lit("orders").alias("part"), F.round("o_totalprice", 4).alias("amount"))
    return conform.union_parts([e, o])


@query("missing_days_of_clients", """SELECT DISTINCT o_custkey AS client_id FROM orders EXCEPT SELECT user_id FROM events""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("client_id")).distinct()
    e = table(spark, sf, "events").select(F.col("user_id").alias("client_id"))
    return o.join(e, "client_id", "left_anti")


@query("distinct_rows", """SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem""")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()


@query("common_client_dates", f"""WITH {TARGETS_SQL}, {PANEL_SQL} SELECT id, month AS date FROM tgt INTERSECT SELECT id, date FROM pan""")
def _(spark, sf):
    t = targets(spark, sf).select("id", F.col("month").alias("date"))
    return t.intersect(panel(spark, sf).select("id", "date"))
