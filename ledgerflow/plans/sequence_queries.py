"""Queries over vocabularies, encodings and event sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.functions.scalars import epoch_seconds, shard_of
from ledgerflow.operators import sequences as Q
from ledgerflow.operators import targets as T
from ledgerflow.operators.windows import latest_events, windows
from ledgerflow.plans.registry import query
from ledgerflow.plans.standins import (
    CATEGORIES, FEATURES_ASC, FEATURES_DESC, LEDGER, LEDGER_SQL, MAX_EVENTS, capped_sql, ledger, sql_hash, sql_shard, sql_uniform, table,
)
from ledgerflow.schema import EventSchema
from ledgerflow.sources.readers import materialise

FRACTION, SEED = 0.2, 0

EVENTS = EventSchema("user_id", "ts", ("event_type",), ("value",))
CAP = capped_sql()

SPLIT_SQL = f"""ids AS (SELECT DISTINCT client_id FROM cap),
split AS (SELECT client_id, row_number() OVER (ORDER BY {sql_hash(str(SEED), 'client_id')}, client_id)
    <= least(count(*) OVER () - 1, greatest(1, floor(count(*) OVER () * {FRACTION}::DOUBLE))) AS valid FROM ids)"""

_KEYS = " UNION ALL ".join(
    f"SELECT client_id, '{c}' AS \"column\", coalesce(CAST({c} AS VARCHAR), '<MISSING>') AS value FROM cap" for c in CATEGORIES
)
VOCAB_SQL = f"""sized AS (SELECT client_id, count(*) AS n FROM cap GROUP BY 1),
keys AS ({_KEYS}),
vocab AS (SELECT "column", value, count(*) AS count, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS code
  FROM keys JOIN split USING (client_id) JOIN sized USING (client_id) WHERE NOT valid AND n >= 2 GROUP BY 1, 2)"""


def capped(spark, sf):
    """The prepared ledger all sequence work starts from; written once, read often."""
    return materialise(latest_events(ledger(spark, sf), MAX_EVENTS, LEDGER))


def split(cap):
    return T.fixed_split(cap, "client_id", SEED, FRACTION)


def train_events(cap):
    ok = Q.eligible_clients(cap, "client_id", 2).select("client_id")
    train = split(cap).where("NOT valid").join(ok, "client_id", "left_semi")
    return cap.join(materialise(train.select("client_id")), "client_id", "left_semi")


def vocabulary(cap):
    return Q.fit_vocabulary(train_events(cap), CATEGORIES)


@query("eligible_clients", f"WITH {LEDGER_SQL} SELECT client_id, count(*) AS n_events FROM led GROUP BY 1 HAVING count(*) >= 30")
def _(spark, sf):
    return Q.eligible_clients(ledger(spark, sf), "client_id", 30)


@query("fixed_split", f"WITH {CAP}, {SPLIT_SQL} SELECT client_id, valid FROM split")
def _(spark, sf):
    return split(capped(spark, sf))


@query("vocabulary", f"WITH {CAP}, {SPLIT_SQL}, {VOCAB_SQL} SELECT \"column\", value, count, code FROM vocab")
def _(spark, sf):
    return vocabulary(capped(spark, sf))


@query("vocabulary_sizes", f"WITH {CAP}, {SPLIT_SQL}, {VOCAB_SQL} SELECT \"column\", max(code) + 2 AS size FROM vocab GROUP BY 1")
def _(spark, sf):
    return Q.vocabulary_sizes(vocabulary(capped(spark, sf)))


# Held-out clients, a third of them, use values that no training client has: what the vocabulary
# of the training clients does not know.
_ODD = {c: f"CASE WHEN valid AND {sql_shard(3, 'client_id', seed='odd')} = 0 THEN {c} + 1000 ELSE {c} END AS {c}" for c in ("event_type", "src_b", "currency")}
ODD_SQL = LEDGER_SQL.replace("led AS (", "led0 AS (", 1) + ", " + SPLIT_SQL.replace("FROM cap", "FROM led0") + f""",
led AS (SELECT * EXCLUDE (valid) REPLACE ({", ".join(_ODD.values())}) FROM (SELECT led0.*, valid FROM led0 JOIN split USING (client_id)))"""
ODD_CAP = ODD_SQL + CAP[len(LEDGER_SQL):]
_ODD_VOCAB = VOCAB_SQL + """, dear AS (SELECT "column", value, code FROM vocab)"""


def odd_ledger(spark, sf):
    """The ledger with the odd values; which clients have them is worked out once per client."""
    led = ledger(spark, sf)
    hit = F.col("valid") & (shard_of(3, "client_id", seed="odd") == 0)
    both = led.join(materialise(split(led).select("client_id", hit.alias("_odd"))), "client_id")
    return both.select(*[F.when(F.col("_odd"), F.col(c) + 1000).otherwise(F.col(c)).alias(c) if c in _ODD else F.col(c) for c in led.columns])


def odd_capped(spark, sf):
    return materialise(latest_events(odd_ledger(spark, sf), MAX_EVENTS, LEDGER))


_ENCODED = "SELECT client_id, CAST(epoch(event_time) AS BIGINT) AS t, " + ", ".join(
    f"CAST(coalesce((SELECT code FROM dear WHERE \"column\" = '{c}' AND value = coalesce(CAST({c} AS VARCHAR), '<MISSING>')), "
    f"(SELECT max(code) + 1 FROM dear WHERE \"column\" = '{c}')) AS BIGINT) AS {c}_code" for c in CATEGORIES
) + " FROM cap"


@query("encode_events", f"WITH {ODD_CAP}, {_ODD_VOCAB} {_ENCODED}")
def _(spark, sf):
    cap = odd_capped(spark, sf)
    coded = Q.encode(cap, vocabulary(cap), CATEGORIES)
    return coded.select("client_id", epoch_seconds("event_time").alias("t"), *[F.col(f"{c}_code").cast("bigint").alias(f"{c}_code") for c in CATEGORIES])


_ALL_KEYS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", coalesce(CAST({c} AS VARCHAR), '<MISSING>') AS value FROM cap" for c in CATEGORIES
)


@query("unknown_rates", f"""WITH {ODD_CAP}, {_ODD_VOCAB}, k AS ({_ALL_KEYS})
  SELECT "column", count(*) AS n_rows, count(*) FILTER (WHERE code IS NULL) AS n_unknown,
    round(count(*) FILTER (WHERE code IS NULL) / count(*)::DOUBLE, 9) AS unknown_rate
  FROM k LEFT JOIN dear USING ("column", value) GROUP BY 1""")
def _(spark, sf):
    cap = odd_capped(spark, sf)
    return Q.unknown_rates(cap, vocabulary(cap), CATEGORIES).withColumn("unknown_rate", F.round("unknown_rate", 9))


_MARKS = "marks AS (SELECT event_type AS value, count(*) AS count, row_number() OVER (ORDER BY event_type) - 1 AS code FROM cap JOIN split USING (client_id) WHERE NOT valid AND event_type IS NOT NULL GROUP BY 1)"


def _marks(cap):
    """The marks of the training clients."""
    return Q.factorise(cap.join(split(cap).where("NOT valid"), "client_id", "left_semi"), "event_type")


@query("factorise", "SELECT event_type AS value, count(*) AS count, row_number() OVER (ORDER BY event_type) - 1 AS code FROM events GROUP BY 1")
def _(spark, sf):
    return Q.factorise(table(spark, sf, "events"), "event_type")


@query("drop_unseen", f"WITH {ODD_CAP}, {_MARKS} SELECT client_id, CAST(epoch(event_time) AS BIGINT) AS t, event_type, code FROM cap JOIN marks ON value = event_type")
def _(spark, sf):
    cap = odd_capped(spark, sf)
    return Q.drop_unseen(cap, _marks(cap), "event_type").select("client_id", epoch_seconds("event_time").alias("t"), "event_type", "code")


@query("unseen_report", f"WITH {ODD_CAP}, {_MARKS} SELECT event_type, count(*) AS n_dropped FROM cap WHERE event_type NOT IN (SELECT value FROM marks) GROUP BY 1")
def _(spark, sf):
    cap = odd_capped(spark, sf)
    return Q.unseen_report(cap, _marks(cap), "event_type")


_SEQ_CODES = ", ".join(
    f"CAST(coalesce((SELECT code FROM dear WHERE \"column\" = '{c}' AND value = coalesce(CAST({c} AS VARCHAR), '<MISSING>')), "
    f"(SELECT max(code) + 1 FROM dear WHERE \"column\" = '{c}')) AS BIGINT) AS {c}_code" for c in CATEGORIES
)


@query("feature_sequences", f"""WITH {ODD_CAP}, {_ODD_VOCAB}, coded AS (SELECT *, {_SEQ_CODES} FROM cap)
  SELECT client_id, array_to_string(list(CAST(epoch(event_time) AS BIGINT) ORDER BY {FEATURES_ASC}), ',') AS event_time,
    {", ".join(f"array_to_string(list({c}_code ORDER BY {FEATURES_ASC}), ',') AS {c}" for c in CATEGORIES)},
    array_to_string(list(CAST(round(CAST(CAST(amount AS FLOAT) AS DOUBLE) * 100) AS BIGINT) ORDER BY {FEATURES_ASC}), ',') AS amount
  FROM coded GROUP BY 1""")
def _(spark, sf):
    cap = odd_capped(spark, sf)  # the newest of the newest are the same events
    s = Q.feature_sequences(cap, LEDGER, vocabulary(cap), MAX_EVENTS)
    joined = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("event_time", *CATEGORIES)]
    # amounts are FLOAT inside a sequence; compare what is stored, in cents
    return s.select("client_id", *joined, F.array_join(F.transform("amount", lambda x: F.round(x.cast("double") * 100).cast("bigint").cast("string")), ",").alias("amount"))


@query("window_sequences", f"""WITH {ODD_SQL}, d AS (SELECT CAST(unnest([DATE '1998-01-01', DATE '1998-07-01']) AS DATE) AS target_date),
  w AS (SELECT * FROM led, d WHERE event_time < target_date AND event_time > target_date - INTERVAL 12 MONTH
    QUALIFY row_number() OVER (PARTITION BY client_id, target_date ORDER BY {FEATURES_DESC}) <= 5)
  SELECT client_id, target_date, array_to_string(list(CAST(epoch(event_time) AS BIGINT) ORDER BY {FEATURES_ASC}), ',') AS event_time,
    array_to_string(list(CAST(round(CAST(CAST(amount AS FLOAT) AS DOUBLE) * 100) AS BIGINT) ORDER BY {FEATURES_ASC}), ',') AS amount FROM w GROUP BY 1, 2""")
def _(spark, sf):
    """Per client and window the newest five events; the windows themselves are not capped."""
    led = materialise(odd_ledger(spark, sf))
    w = windows(led, LEDGER, ["1998-01-01", "1998-07-01"], 12)
    s = Q.feature_sequences(w, LEDGER, vocabulary(materialise(latest_events(led, MAX_EVENTS, LEDGER))), 5, ["target_date"])
    cents = F.transform("amount", lambda x: F.round(x.cast("double") * 100).cast("bigint").cast("string"))
    times = F.transform("event_time", lambda x: x.cast("string"))
    return s.select("client_id", "target_date", F.array_join(times, ",").alias("event_time"), F.array_join(cents, ",").alias("amount"))


@query("event_sequences", f"""WITH {ODD_CAP}, {_MARKS}, kept AS (
    SELECT cap.*, code FROM cap JOIN marks ON value = event_type),
  d AS (SELECT *, CAST(floor((epoch(event_time) - min(epoch(event_time)) OVER (PARTITION BY client_id)) / 86400) AS BIGINT) AS days FROM kept),
  g AS (SELECT *, days - coalesce(lag(days) OVER (PARTITION BY client_id ORDER BY {FEATURES_ASC}), days) AS delta FROM d)
  SELECT client_id, array_to_string(list(days ORDER BY {FEATURES_ASC}), ',') AS times,
    array_to_string(list(delta ORDER BY {FEATURES_ASC}), ',') AS deltas,
    array_to_string(list(code ORDER BY {FEATURES_ASC}), ',') AS types FROM g GROUP BY 1""")
def _(spark, sf):
    cap = odd_capped(spark, sf)
    s = Q.event_sequences(cap, LEDGER, "event_type", _marks(cap), MAX_EVENTS)
    return s.select("client_id", *[F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), ",").alias(c) for c in ("times", "deltas", "types")])


@query("days_since_first", f"""WITH {CAP}, d AS (SELECT *, CAST(floor((epoch(event_time) - min(epoch(event_time)) OVER (PARTITION BY client_id)) / 86400) AS BIGINT) AS days FROM cap)
  SELECT client_id, CAST(epoch(event_time) AS BIGINT) AS t, days,
    days - coalesce(lag(days) OVER (PARTITION BY client_id ORDER BY {FEATURES_ASC}), days) AS delta_days FROM d""")
def _(spark, sf):
    return Q.days_since_first(capped(spark, sf), LEDGER).select("client_id", epoch_seconds("event_time").alias("t"), "days", "delta_days")


_AUDIT_UNKNOWN = """unk AS (SELECT coalesce(CAST(sum(CASE WHEN code IS NULL AND NOT valid THEN 1 ELSE 0 END) AS BIGINT), 0) AS unknown_train,
    coalesce(CAST(sum(CASE WHEN code IS NULL AND valid THEN 1 ELSE 0 END) AS BIGINT), 0) AS unknown_valid
  FROM keys JOIN sized USING (client_id) JOIN split USING (client_id) LEFT JOIN dear USING ("column", value) WHERE n >= 2)"""


@query("prepare_audit", f"""WITH {ODD_CAP}, {_ODD_VOCAB}, {_AUDIT_UNKNOWN},
  g AS (SELECT client_id, event_time, event_time = lag(event_time) OVER (PARTITION BY client_id ORDER BY {FEATURES_ASC}) AS zero FROM cap),
  c AS (SELECT client_id, count(*) AS n, count(*) FILTER (WHERE zero) AS z, min(event_time) = max(event_time) AS same FROM g GROUP BY 1)
  SELECT count(*) AS clients_total, CAST(sum(n) AS BIGINT) AS events_retained, count(*) FILTER (WHERE n < 2) AS short_clients_excluded,
    count(*) FILTER (WHERE n >= 2 AND NOT valid) AS train_clients, count(*) FILTER (WHERE n >= 2 AND valid) AS valid_clients,
    CAST(sum(z) AS BIGINT) AS zero_gap_events, count(*) FILTER (WHERE same) AS all_same_day_clients,
    any_value(unknown_train) AS unknown_train, any_value(unknown_valid) AS unknown_valid
  FROM c JOIN split USING (client_id), unk""")
def _(spark, sf):
    cap = odd_capped(spark, sf)
    return Q.prepare_audit(cap, LEDGER, split(cap), vocabulary(cap))


@query("split_unknowns", f"""WITH {ODD_CAP}, {_ODD_VOCAB}
  SELECT valid, "column", count(*) AS n_rows, count(*) FILTER (WHERE code IS NULL) AS n_unknown
  FROM keys JOIN sized USING (client_id) JOIN split USING (client_id) LEFT JOIN dear USING ("column", value) WHERE n >= 2 GROUP BY 1, 2""")
def _(spark, sf):
    """Unknown values per column and split; none on the training side, or the query raises."""
    cap = odd_capped(spark, sf)
    clients = split(cap).join(Q.eligible_clients(cap, "client_id", 2), "client_id")
    return Q.split_unknowns(cap, LEDGER, materialise(clients), vocabulary(cap), strict=True)


@query("zero_gap_events", f"""WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(ts AS DATE) - lag(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_type, value) AS gap FROM events)
  SELECT user_id, count(*) AS n_events, count(*) FILTER (WHERE gap = 0) AS zero_gaps, count(*) FILTER (WHERE gap IS NULL) AS first_rows FROM g GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_type", "value")
    gaps = Q.client_gaps(e.withColumn("ts", F.col("day").cast("timestamp_ntz")), EVENTS)
    return gaps.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("gap") == 0).alias("zero_gaps"),
        F.count_if(F.col("gap").isNull()).alias("first_rows"),
    )


@query("interval_stats", f"""WITH {CAP}, {SPLIT_SQL},
  g AS (SELECT (epoch(event_time) - lag(epoch(event_time)) OVER (PARTITION BY client_id ORDER BY {FEATURES_ASC})) / 86400.0::DOUBLE AS days
    FROM cap JOIN split USING (client_id) WHERE NOT valid),
  p AS (SELECT quantile_cont(days, 0.99) AS p99 FROM g WHERE days IS NOT NULL)
  SELECT round(p99, 6) AS p99, count(*) AS n_intervals, count(*) FILTER (WHERE days <= p99) AS n_retained,
    round(avg(days) FILTER (WHERE days <= p99), 6) AS truncated_mean FROM g, p WHERE days IS NOT NULL GROUP BY p99""")
def _(spark, sf):
    cap = capped(spark, sf)
    s = Q.interval_stats(cap, LEDGER, split(cap).where("NOT valid"))
    return s.select(F.round("p99", 6).alias("p99"), "n_intervals", "n_retained", F.round("truncated_mean", 6).alias("truncated_mean"))


@query("next_event_pairs", f"""WITH {CAP}, p AS (SELECT *, row_number() OVER w AS position, lead(event_type) OVER w AS next_type,
    lead(amount) OVER w AS next_amount, lead(event_time) OVER w AS next_time FROM cap WINDOW w AS (PARTITION BY client_id ORDER BY {FEATURES_ASC}))
  SELECT client_id, CAST(position AS INTEGER) AS position, event_type, next_type, round(next_amount, 2) AS next_amount,
    CAST(epoch(next_time) - epoch(event_time) AS BIGINT) AS seconds FROM p WHERE next_time IS NOT NULL""")
def _(spark, sf):
    p = Q.next_event_pairs(capped(spark, sf), LEDGER)
    return p.select(
        "client_id", "position", "event_type", F.col("next_event_type").alias("next_type"), F.round("next_amount", 2).alias("next_amount"),
        (epoch_seconds("next_event_time") - epoch_seconds("event_time")).alias("seconds"),
    )


@query("masked_events", f"""WITH {CAP}, p AS (SELECT client_id, event_type, row_number() OVER (PARTITION BY client_id ORDER BY {FEATURES_ASC}) AS position FROM cap),
  u AS (SELECT *, {sql_hash('5', 'client_id', 'position')} AS h FROM p),
  v AS (SELECT *, h / 1152921504606846976.0::DOUBLE AS u FROM u)
  SELECT client_id, CAST(position AS INTEGER) AS position, event_type,
    u < 0.15 OR (h = min(h) OVER (PARTITION BY client_id) AND min(u) OVER (PARTITION BY client_id) >= 0.15) AS masked FROM v""")
def _(spark, sf):
    return Q.masked_events(capped(spark, sf), LEDGER, 0.15, 5).select("client_id", "position", "event_type", "masked")


@query("subsequence_views", f"""WITH {CAP}, p AS (SELECT client_id, event_type, row_number() OVER (PARTITION BY client_id ORDER BY {FEATURES_ASC}) - 1 AS position,
    count(*) OVER (PARTITION BY client_id) AS n FROM cap),
  v AS (SELECT *, CAST(unnest([0, 1, 2, 3, 4]) AS INTEGER) AS "view" FROM p),
  l AS (SELECT *, least(15 + CAST(floor({sql_uniform('3:len', 'client_id', '"view"')} * 136.0::DOUBLE) AS BIGINT), n) AS len FROM v),
  s AS (SELECT *, CAST(floor({sql_uniform('3:start', 'client_id', '"view"')} * (n - len + 1)) AS BIGINT) AS start FROM l)
  SELECT client_id, "view", CAST(position AS INTEGER) AS position, event_type FROM s WHERE position >= start AND position < start + len""")
def _(spark, sf):
    return Q.subsequence_views(capped(spark, sf), LEDGER, 5, 15, 150, 3).select("client_id", "view", "position", "event_type")
