"""Queries over column passports and dependency structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.operators import profile as P
from ledgerflow.operators import sketches as K
from ledgerflow.plans.registry import query
from ledgerflow.plans.standins import CATEGORIES, LEDGER_SQL, NUMERICS, SPECS, fold, ledger, table
from ledgerflow.schema import ColumnSpec
from ledgerflow.sources.readers import materialise

LEVELS = "[" + ", ".join(str(q) for q in P.QUANTILE_LEVELS) + "]"
BINS, MAX_CATEGORIES = 10, 64

_CAT_LONG = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM led" for c in CATEGORIES)
_NUM_LONG = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM led" for c in NUMERICS)
LONG_SQL = f"cats AS ({_CAT_LONG}), nums AS ({_NUM_LONG})"


def counts(spark, sf):
    return materialise(P.value_counts_long(ledger(spark, sf), SPECS))


def rounded(df, k, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, k))
    return df


@query("profile_base", f"""WITH {LEDGER_SQL}, {LONG_SQL}, b AS (
    SELECT "column", 'categorical' AS kind, count(*) AS n_rows, count(v) AS n_valid, count(DISTINCT v) AS n_unique FROM cats GROUP BY 1
    UNION ALL SELECT "column", 'numeric', count(*), count(v), count(DISTINCT v) FROM nums GROUP BY 1)
  SELECT *, round(1.0::DOUBLE - n_valid / n_rows::DOUBLE, 9) AS null_share, round(n_unique / n_rows::DOUBLE, 9) AS uniqueness FROM b""")
def _(spark, sf):
    return rounded(P.base_profile(counts(spark, sf)), 9, "null_share", "uniqueness")


@query("profile_categorical", f"""WITH {LEDGER_SQL}, {LONG_SQL}, c AS (SELECT "column", v, count(*)::DOUBLE AS n FROM cats WHERE v IS NOT NULL GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC) AS r, sum(n) OVER (PARTITION BY "column") AS t FROM c)
  SELECT "column", round(CASE WHEN count(*) > 1 THEN -sum(n / t * log2(n / t)) / log2(count(*)) ELSE 0 END, 9) AS entropy_norm,
    round(max(n) / any_value(t), 9) AS top1_share, round(sum(CASE WHEN r <= 3 THEN n ELSE 0 END) / any_value(t), 9) AS top3_share
  FROM r GROUP BY 1""")
def _(spark, sf):
    return rounded(P.categorical_profile(counts(spark, sf)), 9, "entropy_norm", "top1_share", "top3_share")


@query("profile_categorical_v1", f"""WITH c AS (SELECT CASE WHEN p_size > 45 THEN NULL ELSE p_name || p_size END AS v, count(*)::DOUBLE AS n FROM part GROUP BY 1),
  r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v NULLS LAST) AS r FROM c), k AS (SELECT *, sum(n) OVER () AS t FROM r WHERE r <= 1000)
  SELECT 'name' AS "column", round(-sum(n / t * log2(n / t)) / log2(count(*)), 4) AS entropy_norm, round(max(n) / any_value(t), 4) AS top1_share,
    round(sum(CASE WHEN r <= 3 THEN n ELSE 0 END) / any_value(t), 4) AS top3_share FROM k""")
def _(spark, sf):
    p = table(spark, sf, "part")
    v = F.when(F.col("p_size") <= 45, F.concat("p_name", F.col("p_size").cast("string")))
    return P.categorical_profile_v1(P.value_counts_long(p.select(v.alias("name")), [ColumnSpec("name", "categorical")]))


@query("category_ranks", f"""WITH {LEDGER_SQL}, {LONG_SQL}, c AS (SELECT "column", v AS value, count(*) AS n FROM cats WHERE v IS NOT NULL GROUP BY 1, 2)
  SELECT "column", value, n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM c QUALIFY rank <= 4""")
def _(spark, sf):
    c = counts(spark, sf).where("kind = 'categorical' AND s IS NOT NULL")
    return P.category_ranks(c, 4).select("column", F.col("s").alias("value"), "n", "rank")


_NUMERIC = f"""WITH {LEDGER_SQL}, {LONG_SQL}, q AS (SELECT "column", count(DISTINCT v) AS k, min(v) AS lo, max(v) AS hi, avg(v) AS mean, stddev_samp(v) AS std,
    avg(CASE WHEN v = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS zero_share, avg(CASE WHEN v = trunc(v) THEN 1.0::DOUBLE ELSE 0.0 END) AS integer_share,
    quantile_cont(v, {LEVELS}) AS q FROM nums WHERE isfinite(v) GROUP BY 1)"""


@query("profile_numeric", _NUMERIC + """ SELECT "column", lo AS min, hi AS max, round(mean, 4) AS mean, round(std, 4) AS std, round(zero_share, 9) AS zero_share,
    round(integer_share, 9) AS integer_share, CASE k WHEN 1 THEN 'constant' WHEN 2 THEN 'binary' ELSE 'continuous' END AS numeric_subtype,
    round(q[2], 4) AS q05, round(q[6], 4) AS q25, round(q[11], 4) AS q50, round(q[16], 4) AS q75, round(q[20], 4) AS q95 FROM q""")
def _(spark, sf):
    p = P.numeric_profile(counts(spark, sf))
    q = {"q05": 1, "q25": 5, "q50": 10, "q75": 15, "q95": 19}
    p = rounded(p, 9, "zero_share", "integer_share")
    p = rounded(p, 4, "mean", "std")
    return p.select(
        "column", "min", "max", "mean", "std", "zero_share", "integer_share", "numeric_subtype",
        *[F.round(F.get("quantiles", F.lit(i)), 4).alias(n) for n, i in q.items()],
    )


@query("profile_sketched", f"""WITH {LEDGER_SQL}, {LONG_SQL}, b AS (
    SELECT "column", 'categorical' AS kind, count(*) AS n_rows, count(v) AS n_valid, count(DISTINCT v) AS n_unique, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean,
      NULL::DOUBLE AS std, NULL::DOUBLE AS zero_share, NULL::DOUBLE AS integer_share, NULL::VARCHAR AS numeric_subtype, NULL::BOOLEAN AS quantiles_within FROM cats GROUP BY 1
    UNION ALL SELECT "column", 'numeric', count(*), count(v), count(DISTINCT v), min(v), max(v), avg(v), stddev_samp(v), avg(CASE WHEN v = 0 THEN 1.0::DOUBLE ELSE 0.0 END),
      avg(CASE WHEN v = trunc(v) THEN 1.0::DOUBLE ELSE 0.0 END), CASE count(DISTINCT v) WHEN 1 THEN 'constant' WHEN 2 THEN 'binary' ELSE 'continuous' END, true FROM nums GROUP BY 1)
  SELECT "column", kind, n_rows, n_valid, n_unique, true AS n_unique_within, min, max, round(mean, 4) AS mean, round(std, 4) AS std, round(zero_share, 9) AS zero_share,
    round(integer_share, 9) AS integer_share, numeric_subtype, quantiles_within FROM b""")
def _(spark, sf):
    """Passports from sketches of five folds, merged: exact figures, and whether the approximate
    ones are as near to the exact ones as stated."""
    led = ledger(spark, sf).withColumn("fold", fold("client_id"))
    parts = materialise(K.sketch_columns(led, SPECS, ["fold"]))
    passports = materialise(K.sketched_passports(K.merge_sketches(parts)))
    c = counts(spark, sf)
    exact = P.base_profile(c).select("column", F.col("n_unique").alias("exact"))
    near = F.abs(F.col("n_unique") - F.col("exact")) <= K.distinct_error() * F.col("exact")
    out = passports.join(exact, "column").join(K.quantile_rank_errors(passports, c), "column", "left").select(
        "column", "kind", "n_rows", "n_valid", F.col("exact").alias("n_unique"), near.alias("n_unique_within"), "min", "max", "mean", "std", "zero_share", "integer_share",
        "numeric_subtype", (F.col("rank_error") <= K.rank_error()).alias("quantiles_within"))
    return rounded(rounded(out, 9, "zero_share", "integer_share"), 4, "mean", "std")


_FLAT = f"""WITH v AS (SELECT 'value' AS "column", value AS v FROM events UNION ALL SELECT 'mostly_zero', CASE WHEN event_id % 40 = 0 THEN value ELSE 0 END FROM events
    UNION ALL SELECT 'rare', CASE WHEN event_id = 0 THEN 1 ELSE 0 END FROM events UNION ALL SELECT 'flat', 1.0 FROM events),
  q AS (SELECT "column", min(v) AS lo, max(v) AS hi, quantile_cont(v, {LEVELS}) AS q FROM v GROUP BY 1),
  s AS (SELECT *, CASE WHEN q[20] <> q[2] THEN q[20] - q[2] WHEN q[21] <> q[1] THEN q[21] - q[1] ELSE hi - lo END AS scale,
    CASE WHEN q[20] <> q[2] THEN 'none' WHEN q[21] <> q[1] THEN 'q01_q99' WHEN hi <> lo THEN 'range' ELSE 'constant' END AS fallback FROM q),
  x AS (SELECT *, unnest(range(21)) AS level FROM s)
  SELECT "column", CAST(level AS INTEGER) AS level, round(scale, 6) AS scale, fallback,
    round(CASE WHEN scale = 0 THEN 0 ELSE (q[level + 1] - q[11]) / scale END, 6) + 0.0 AS shape FROM x"""


@query("quantile_shape", _FLAT)
def _(spark, sf):
    e = table(spark, sf, "events").select(
        "value", F.when(F.col("event_id") % 40 == 0, F.col("value")).otherwise(0.0).alias("mostly_zero"),
        F.when(F.col("event_id") == 0, 1.0).otherwise(0.0).alias("rare"), F.lit(1.0).alias("flat"),
    )
    specs = [ColumnSpec(c, "numeric") for c in e.columns]
    p = P.numeric_profile(materialise(P.value_counts_long(e, specs)))
    return p.select(
        "column", F.round("quantile_scale", 6).alias("scale"), F.col("quantile_fallback").alias("fallback"),
        F.posexplode("quantile_shape").alias("level", "shape"),
    ).withColumn("shape", F.round("shape", 6) + F.lit(0.0))


@query("equal_width_hist", f"""WITH {LEDGER_SQL}, {LONG_SQL}, b AS (SELECT "column", min(v) AS lo, max(v) AS hi, count(*) AS n FROM nums GROUP BY 1),
  f AS (SELECT "column", least(CAST(floor((v - lo) / ((hi - lo) / 20.0::DOUBLE)) AS INTEGER), 19) AS bin, count(*) AS c FROM nums JOIN b USING ("column") GROUP BY 1, 2),
  g AS (SELECT "column", n, CAST(unnest(range(20)) AS INTEGER) AS bin FROM b)
  SELECT "column", bin, round(coalesce(c, 0) / n::DOUBLE, 9) AS share FROM g LEFT JOIN f USING ("column", bin)""")
def _(spark, sf):
    return rounded(P.equal_width_hist(counts(spark, sf)), 9, "share")


@query("hist_entropy", f"""WITH {LEDGER_SQL}, {LONG_SQL}, b AS (SELECT "column", min(v) AS lo, max(v) AS hi, count(*) AS n FROM nums GROUP BY 1),
  f AS (SELECT "column", least(CAST(floor((v - lo) / ((hi - lo) / 20.0::DOUBLE)) AS INTEGER), 19) AS bin, count(*) / any_value(n)::DOUBLE AS p FROM nums JOIN b USING ("column") GROUP BY 1, 2)
  SELECT "column", round(-sum(p * log2(p)) / log2(20), 9) AS entropy_norm FROM f GROUP BY 1""")
def _(spark, sf):
    return rounded(P.hist_entropy(P.equal_width_hist(counts(spark, sf))), 9, "entropy_norm")


@query("value_counts", """SELECT l_partkey AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY count DESC, value LIMIT 25""")
def _(spark, sf):
    return P.value_counts(table(spark, sf, "lineitem"), "l_partkey", 25)


# -- dependency ------------------------------------------------------------------------

_EDGES = f"[{', '.join(str(i / BINS) for i in range(BINS + 1))}]"


def _code_sql():
    parts = []
    for c in CATEGORIES:
        parts.append(f"""{c}_c AS (SELECT {c} AS v, count(*) AS n, count(*) OVER () AS k, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS r
          FROM led WHERE {c} IS NOT NULL GROUP BY 1),
        {c}_k AS (SELECT v, r FROM {c}_c WHERE k <= {MAX_CATEGORIES} OR n > (SELECT n FROM {c}_c WHERE r = {MAX_CATEGORIES - 1}))""")
    for c in NUMERICS:
        parts.append(f"{c}_e AS (SELECT list_sort(list_distinct(quantile_cont({c}, {_EDGES}))) AS e FROM led)")
    cols = [
        f"CASE WHEN {c} IS NULL THEN NULL ELSE coalesce((SELECT CAST(r AS INTEGER) FROM {c}_k WHERE v = {c}), 0) END AS {c}" for c in CATEGORIES
    ] + [
        f"CAST(len(list_filter((SELECT e[2:len(e) - 1] FROM {c}_e), lambda x: x <= {c})) AS INTEGER) AS {c}" for c in NUMERICS
    ]
    return ", ".join(parts) + ", codes AS (SELECT client_id, event_time, " + ", ".join(cols) + " FROM led)"


CODES_SQL = _code_sql()
_NAMES = [s.name for s in SPECS]
_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {a} AS u, {b} AS v FROM codes WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for i, a in enumerate(_NAMES) for b in _NAMES[i + 1:]
)


@query("structure_codes", f"WITH {LEDGER_SQL}, {CODES_SQL} SELECT {', '.join(_NAMES)}, count(*) AS n FROM codes GROUP BY ALL")
def _(spark, sf):
    return P.structure_codes(materialise(ledger(spark, sf)), SPECS, BINS, MAX_CATEGORIES).groupBy(*_NAMES).agg(F.count(F.lit(1)).alias("n"))


@query("pair_support", f"""WITH {LEDGER_SQL}, {CODES_SQL}, p AS ({_PAIRS}) SELECT "left", "right", count(*) AS n_pairs, count(DISTINCT (u, v)) AS n_cells FROM p GROUP BY 1, 2""")
def _(spark, sf):
    codes = P.structure_codes(materialise(ledger(spark, sf)), SPECS, BINS, MAX_CATEGORIES)
    return P.pair_counts(codes, _NAMES).groupBy("left", "right").agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_cells"))


@query("nmi_matrix", f"""WITH {LEDGER_SQL}, {CODES_SQL}, p AS ({_PAIRS}), c AS (SELECT "left", "right", u, v, count(*)::DOUBLE AS n FROM p GROUP BY ALL),
  m AS (SELECT *, sum(n) OVER (PARTITION BY "left", "right") AS t, sum(n) OVER (PARTITION BY "left", "right", u) AS nu, sum(n) OVER (PARTITION BY "left", "right", v) AS nv FROM c),
  s AS (SELECT "left", "right", CAST(any_value(t) AS BIGINT) AS n_pairs, count(DISTINCT u) AS ku, count(DISTINCT v) AS kv,
    sum(n / t * ln(n * t / (nu * nv))) AS i, -sum(n / t * ln(nu / t)) AS hu, -sum(n / t * ln(nv / t)) AS hv FROM m GROUP BY 1, 2)
  SELECT "left", "right", n_pairs, n_pairs >= 30 AND ku > 1 AND kv > 1 AS usable,
    CASE WHEN n_pairs >= 30 AND ku > 1 AND kv > 1 THEN round(2 * i / (hu + hv), 8) + 0.0 END AS nmi,
    round(CASE WHEN n_pairs >= 30 AND ku > 1 AND kv > 1 THEN 1 - greatest(0, least(1, 2 * i / (hu + hv))) ELSE 1 END, 8) AS distance FROM s""")
def _(spark, sf):
    m = P.dependency_matrix(materialise(ledger(spark, sf)), SPECS, BINS, MAX_CATEGORIES, 30)
    return rounded(m, 8, "nmi", "distance").withColumn("nmi", F.col("nmi") + F.lit(0.0))


_RANKS = """r AS (SELECT *, rank() OVER (PARTITION BY side ORDER BY x) + (count(*) OVER (PARTITION BY side, x) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY side ORDER BY y) + (count(*) OVER (PARTITION BY side, y) - 1) / 2.0::DOUBLE AS ry FROM xy)"""


@query("correlation_diagnostics", f"""WITH {LEDGER_SQL}, xy AS (SELECT 'a' AS side, amount AS x, balance AS y FROM led WHERE dst_a = 1
    UNION ALL SELECT 'b', amount, event_type * 1000 + balance / 1000 FROM led WHERE dst_a <> 1 AND event_type IS NOT NULL), {_RANKS},
  c AS (SELECT side, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY 1)
  SELECT 'col_1' AS source_1, 'col_2' AS source_2, 'amount' AS field_1, 'mix' AS field_2, a.n AS n_a, b.n AS n_b, round(a.rho, 7) AS rho_a, round(b.rho, 7) AS rho_b,
    round(abs(a.rho - b.rho), 7) AS delta, CASE WHEN abs(a.rho - b.rho) > 0.01 THEN 'WARNING' ELSE 'CONSISTENT' END AS status
  FROM c a, c b WHERE a.side = 'a' AND b.side = 'b'""")
def _(spark, sf):
    led = ledger(spark, sf)
    a = led.where("dst_a = 1").select(F.col("amount").alias("col_1"), F.col("balance").alias("col_2"))
    b = led.where("dst_a <> 1").select("amount", (F.col("event_type") * 1000 + F.col("balance") / 1000).alias("mix"))
    d = P.correlation_diagnostics(a, b, [("col_1", "amount"), ("col_2", "mix")], 30, 0.01)
    return rounded(d, 7, "rho_a", "rho_b", "delta")
