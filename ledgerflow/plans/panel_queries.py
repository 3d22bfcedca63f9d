"""Queries over embedding panels, targets, evaluation and probes."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow.fs
from pyspark.sql import functions as F

from ledgerflow.functions.scalars import hash60
from ledgerflow.operators import embed as B
from ledgerflow.operators import metrics as E
from ledgerflow.operators import panel as D
from ledgerflow.operators import targets as T
from ledgerflow.operators import windows as W
from ledgerflow.operators.conform import daily_sum
from ledgerflow.operators.sequences import feature_sequences, fit_vocabulary
from ledgerflow.plans.profile_queries import rounded
from ledgerflow.plans.registry import query
from ledgerflow.plans.standins import (
    CATEGORIES, FEATURES_DESC, LEDGER, LEDGER_SQL, MAX_EVENTS, NUMERICS, PANEL_SQL, SCORES_SQL, TARGETS_SQL, ledger, panel, scores,
    sql_hash, table, targets,
)
from ledgerflow.sources.readers import attach_row, materialise, scratch_dir

KEYS = ["id", "date"]


def dated_targets(spark, sf):
    return targets(spark, sf).withColumnRenamed("month", "date")


DATED = TARGETS_SQL + ", dt AS (SELECT id, month AS date, y1, y2, y3, fold FROM tgt)"

# -- panels ----------------------------------------------------------------------------


def _flawed(spark, sf):
    """The panel with a repeated client, a NaN and a missing key worked in."""
    p = panel(spark, sf)
    bad = F.when(F.col("id") % 50 == 7, F.transform("emb", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("emb"))
    p = p.withColumn("emb", bad).withColumn("id", F.when(F.col("id") % 90 != 11, F.col("id")))
    return p.unionByName(p.where("id % 40 = 3"))


_FLAWED = """fl AS (SELECT CASE WHEN id % 90 <> 11 THEN id END AS id, date, id % 50 = 7 AS nan, len(emb) AS dim FROM pan),
  fw AS (SELECT * FROM fl UNION ALL SELECT * FROM fl WHERE id % 40 = 3)"""


@query("validate_panel", f"""WITH {PANEL_SQL}, {_FLAWED}, k AS (SELECT date, id, count(*) AS n, count(*) FILTER (WHERE nan) AS bad, min(dim) AS lo, max(dim) AS hi FROM fw GROUP BY 1, 2)
  SELECT date, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (WHERE id IS NULL) AS missing_keys, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
    CAST(sum(bad) AS BIGINT) AS non_finite_rows, CAST(min(lo) AS INTEGER) AS min_dim, CAST(max(hi) AS INTEGER) AS max_dim FROM k GROUP BY 1""")
def _(spark, sf):
    return D.panel_violations(_flawed(spark, sf), "id", "date", "emb")


@query("join_panel", f"WITH {DATED}, {PANEL_SQL} SELECT id, date, y1, y2, y3, fold, round(list_sum(list_transform(emb, lambda x: CAST(x AS DOUBLE))), 6) + 0.0 AS emb_sum FROM dt JOIN pan USING (id, date)")
def _(spark, sf):
    j = D.join_panel(dated_targets(spark, sf), panel(spark, sf), KEYS)
    total = F.aggregate("emb", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return j.select("id", "date", "y1", "y2", "y3", "fold", (F.round(total, 6) + F.lit(0.0)).alias("emb_sum"))


_VARIANT_B = "pb AS (SELECT vec_id AS id, CAST(DATE '1997-01-01' + to_months(label) AS DATE) AS date, embedding AS emb FROM embeddings WHERE embedding[1] > 0)"


def _variant_b(spark, sf):
    return panel(spark, sf).where(F.get("emb", F.lit(0)) > 0)


@query("paired_cohort", f"WITH {DATED}, {PANEL_SQL}, {_VARIANT_B} SELECT id, date, y1 FROM dt SEMI JOIN pan USING (id, date) SEMI JOIN pb USING (id, date)")
def _(spark, sf):
    c = D.paired_cohort(dated_targets(spark, sf), [panel(spark, sf), _variant_b(spark, sf)], KEYS)
    return c.select("id", "date", "y1")


@query("common_keys", f"WITH {DATED}, {_VARIANT_B} SELECT id, date FROM dt INTERSECT SELECT id, date FROM pb")
def _(spark, sf):
    return D.common_keys(dated_targets(spark, sf), _variant_b(spark, sf), KEYS)


@query("features_for", f"WITH {DATED}, {_VARIANT_B} SELECT id, date, CAST(emb[2] AS DOUBLE) AS e1, emb IS NOT NULL AS complete FROM dt LEFT JOIN pb USING (id, date)")
def _(spark, sf):
    f = D.features_for(dated_targets(spark, sf).select(*KEYS), _variant_b(spark, sf), KEYS, "emb", strict=False)
    return f.select("id", "date", F.get("emb", F.lit(1)).cast("double").alias("e1"), "complete")


@query("coverage", f"""WITH {DATED}, {PANEL_SQL}, w AS (SELECT date, count(DISTINCT id) AS expected FROM dt GROUP BY 1), h AS (SELECT date, count(DISTINCT id) AS actual, count(*) AS n FROM pan GROUP BY 1)
  SELECT date, expected, coalesce(actual, 0) AS actual, coalesce(n, 0) AS n_rows, round(coalesce(actual, 0) / expected::DOUBLE, 9) AS coverage,
    CASE WHEN actual IS NULL OR actual / expected::DOUBLE < 0.95 THEN 'FAIL' ELSE 'OK' END AS status FROM w LEFT JOIN h USING (date)""")
def _(spark, sf):
    return rounded(D.coverage(dated_targets(spark, sf), panel(spark, sf), "id", "date"), 9, "coverage")


@query("panel_gaps", f"""WITH {DATED}, {PANEL_SQL}, e AS (SELECT DISTINCT date FROM dt), p AS (SELECT date, CASE WHEN max(id) % 2 = 0 THEN 'a' ELSE 'b' END AS s FROM pan GROUP BY 1)
  SELECT date, CASE WHEN s IS NULL THEN 'missing' ELSE 'other_settings' END AS issue FROM e LEFT JOIN p USING (date) WHERE s IS NULL OR s <> 'a'""")
def _(spark, sf):
    e = dated_targets(spark, sf).select("date").distinct().withColumn("settings", F.lit("a"))
    p = panel(spark, sf).groupBy("date").agg(F.when(F.max("id") % 2 == 0, "a").otherwise("b").alias("settings"))
    return D.panel_gaps(e, p, ["date"])


_PSI = f"""WITH {PANEL_SQL}, c AS (SELECT date, unnest(range(len(emb))) AS dim, CAST(unnest(emb) AS DOUBLE) AS v FROM pan), f AS (SELECT min(date) AS d FROM pan),
  e AS (SELECT dim, list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM c, f WHERE date = d GROUP BY 1),
  i AS (SELECT dim, q[2:len(q) - 1] AS q FROM e),
  b AS (SELECT date, dim, len(list_filter(q, lambda x: x <= v)) AS bin, count(*) AS n FROM c JOIN i USING (dim) GROUP BY 1, 2, 3),
  g AS (SELECT date, dim, unnest(range(len(q) + 1)) AS bin FROM i, (SELECT DISTINCT date FROM pan)),
  s AS (SELECT g.date, g.dim, g.bin, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.date, g.dim) + 1e-6::DOUBLE AS p FROM g LEFT JOIN b ON g.date = b.date AND g.dim = b.dim AND g.bin = b.bin),
  psi AS (SELECT a.date, CAST(a.dim AS INTEGER) AS dim, sum((a.p - r.p) * ln(a.p / r.p)) AS psi FROM s a JOIN s r ON a.dim = r.dim AND a.bin = r.bin, f WHERE r.date = d AND a.date <> d GROUP BY 1, 2)"""


def _psi(spark, sf):
    return D.psi_by_dimension(panel(spark, sf), "date", "emb")


@query("psi_by_dimension", _PSI + " SELECT date, dim, round(psi, 8) AS psi FROM psi")
def _(spark, sf):
    return rounded(_psi(spark, sf), 8, "psi")


@query("psi_by_date", _PSI + " SELECT date, round(avg(psi), 8) AS mean_psi, count(*) AS n_dims, CASE WHEN avg(psi) > 0.1 THEN 'FAIL' ELSE 'OK' END AS verdict FROM psi GROUP BY 1")
def _(spark, sf):
    return rounded(D.psi_by_date(_psi(spark, sf), "date"), 8, "mean_psi")


@query("psi_worst", _PSI + """, r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY psi DESC, dim) AS rank, avg(psi) OVER (PARTITION BY date) AS m FROM psi)
  SELECT date, dim, round(psi, 8) AS psi, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5 AND m > 0.1""")
def _(spark, sf):
    return rounded(D.psi_worst(materialise(_psi(spark, sf)), "date"), 8, "psi")


@query("fit_standardiser", f"""WITH {PANEL_SQL}, c AS (SELECT unnest(range(len(emb))) AS dim, CAST(unnest(emb) AS DOUBLE) AS v FROM pan WHERE date < DATE '1997-07-01')
  SELECT CAST(dim AS INTEGER) AS dim, round(avg(v), 8) + 0.0 AS center, round(sqrt(greatest(var_pop(v), 1e-12)), 8) AS scale FROM c GROUP BY 1""")
def _(spark, sf):
    s = D.fit_standardiser(panel(spark, sf).where("date < DATE '1997-07-01'"), "emb")
    return rounded(s, 8, "center", "scale").withColumn("center", F.col("center") + F.lit(0.0))


@query("standardise", f"""WITH {PANEL_SQL}, c AS (SELECT id, date, unnest(range(len(emb))) AS dim, CAST(unnest(emb) AS DOUBLE) AS v FROM pan),
  s AS (SELECT dim, avg(v) AS m, sqrt(greatest(var_pop(v), 1e-12)) AS sd FROM c WHERE date < DATE '1997-07-01' GROUP BY 1)
  SELECT id, round(sum(greatest(-2, least(2, (v - m) / sd))), 6) + 0.0 AS total FROM c JOIN s USING (dim) GROUP BY 1""")
def _(spark, sf):
    p = panel(spark, sf)
    z = D.standardise(p, D.fit_standardiser(p.where("date < DATE '1997-07-01'"), "emb"), "emb", 2.0)
    return z.select("id", (F.round(F.aggregate("emb", F.lit(0.0), lambda a, x: a + x), 6) + F.lit(0.0)).alias("total"))


# -- encoders --------------------------------------------------------------------------

_DATES = ["1997-06-01", "1998-01-01", "1999-01-01"]
_WIN = f"""d AS (SELECT unnest([DATE '1997-06-01', DATE '1998-01-01', DATE '1999-01-01']) AS target_date),
  w AS (SELECT * FROM led, d WHERE event_time < target_date AND event_time > target_date - INTERVAL 12 MONTH
    QUALIFY row_number() OVER (PARTITION BY client_id, target_date ORDER BY {FEATURES_DESC}) <= 30)"""


def _windows(spark, sf):
    return W.windows(ledger(spark, sf), LEDGER, _DATES, 12, max_events=30)


_STATS = ", ".join(
    f"round(sum({c}), 2) AS {c}_sum, round(avg({c}), 7) AS {c}_mean, round(stddev_pop({c}), 4) AS {c}_std, round(min({c}), 2) AS {c}_min, round(max({c}), 2) AS {c}_max" for c in NUMERICS
)
_TOPS = ", ".join(
    f"count(DISTINCT {c}) AS {c}_distinct, round(coalesce(list_max(map_values(histogram({c}))), 0) / count(*)::DOUBLE, 9) AS {c}_top_share" for c in CATEGORIES
)


@query("stat_features", f"""WITH {LEDGER_SQL}, {_WIN} SELECT client_id, target_date, count(*) AS n_events, CAST(min(target_date - CAST(event_time AS DATE)) AS INTEGER) AS recency_days,
  CAST(max(target_date - CAST(event_time AS DATE)) AS INTEGER) AS span_days, {_STATS}, {_TOPS} FROM w GROUP BY 1, 2""")
def _(spark, sf):
    s = B.stat_features(_windows(spark, sf), LEDGER)
    for c in NUMERICS:
        s = rounded(rounded(rounded(s, 2, f"{c}_sum", f"{c}_min", f"{c}_max"), 7, f"{c}_mean"), 4, f"{c}_std")
    return rounded(s, 9, *[f"{c}_top_share" for c in CATEGORIES])


_EMB_DIM, _EMB_ROWS = 8, 64


def _bag_weights(spark) -> str:
    """The file of a frozen encoder: a vector of small whole numbers per column and code."""
    c, r, k = np.ogrid[: len(CATEGORIES), :_EMB_ROWS, :_EMB_DIM]
    path = f"{scratch_dir(spark)}/ledgerflow-weights-{uuid.uuid4().hex}.npy"
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_output_stream(at) as out:
        np.save(out, ((r * 31 + k * 17 + c * 7) % 101 - 50).astype(np.float32))
    return path


def _bag(path: str):
    """Adds up the vectors of a window's codes, all columns together."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        table = np.load(io.BytesIO(f.read()))

    def encode(columns, rows):
        return sum(columns[c].sums(table[i][columns[c].values % _EMB_ROWS]) for i, c in enumerate(CATEGORIES))

    return encode


def _phases(_: str):
    """Thousands of a daily series by the day's place modulo the width."""

    def encode(columns, rows):
        s = columns["series"]
        hot = s.places()[:, None] % _EMB_DIM == np.arange(_EMB_DIM)
        return s.sums(hot * np.floor(s.values.astype(np.float64) / 1000)[:, None])

    return encode


def _shown(emb):
    """Embeddings of whole numbers as text, which compares exactly."""
    return emb.withColumn("emb", F.array_join(F.transform("emb", lambda x: x.cast("bigint").cast("string")), ","))


_WIN_KEYS = " UNION ALL ".join(f"SELECT client_id, target_date, {i} AS c, coalesce(CAST({c} AS VARCHAR), '<MISSING>') AS v FROM w" for i, c in enumerate(CATEGORIES))


@query("embed_windows", f"""WITH {LEDGER_SQL}, {_WIN}, keys AS ({_WIN_KEYS}),
  code AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, v) % {_EMB_ROWS} AS r FROM keys GROUP BY 1, 2),
  e AS (SELECT client_id, target_date, k, sum((r * 31 + k * 17 + c * 7) % 101 - 50) AS x FROM keys JOIN code USING (c, v), (SELECT unnest(range({_EMB_DIM})) AS k) GROUP BY ALL)
  SELECT client_id, target_date, string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS emb FROM e GROUP BY 1, 2""")
def _(spark, sf):
    """Windows as sequence records through a frozen encoder whose weights lie in a file."""
    w = materialise(_windows(spark, sf))
    seq = feature_sequences(w, LEDGER, fit_vocabulary(w, CATEGORIES), 30, keys=["target_date"])
    return _shown(B.embed_ragged(seq, ["client_id", "target_date"], _bag, _bag_weights(spark), _EMB_DIM, CATEGORIES))


@query("embed_series", f"""WITH {LEDGER_SQL}, d AS (SELECT unnest([DATE '1997-06-01', DATE '1998-01-01', DATE '1999-01-01']) AS target_date),
  day AS (SELECT client_id, CAST(event_time AS DATE) AS day, CAST(sum(amount) AS FLOAT) AS value FROM led GROUP BY 1, 2),
  x AS (SELECT client_id, target_date, (day - CAST(target_date - INTERVAL 12 MONTH AS DATE) - 1) % {_EMB_DIM} AS k, sum(floor(CAST(value AS DOUBLE) / 1000)) AS x
    FROM day, d WHERE day < target_date AND day > CAST(target_date - INTERVAL 12 MONTH AS DATE) GROUP BY ALL),
  g AS (SELECT * FROM (SELECT DISTINCT client_id, target_date FROM x), (SELECT unnest(range({_EMB_DIM})) AS k))
  SELECT client_id, target_date, string_agg(CAST(CAST(coalesce(x, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS emb FROM g LEFT JOIN x USING (client_id, target_date, k) GROUP BY 1, 2""")
def _(spark, sf):
    daily = daily_sum(ledger(spark, sf), "client_id", "event_time", "amount")
    series = W.window_series(daily, "client_id", _DATES, 12)
    return _shown(B.embed_ragged(series, ["client_id", "target_date"], _phases, "phases", _EMB_DIM))


# -- targets and splits ----------------------------------------------------------------


def _dirty(spark, sf):
    """One target row per order: keys repeat, some labels contradict or are odd."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("id"), F.trunc("o_orderdate", "MM").alias("month"),
        F.when(F.col("o_totalprice") > 495000, F.lit(None).cast("int")).when(F.col("o_totalprice") > 490000, 2).otherwise((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("y1"),
        (F.col("o_totalprice") > 300000).cast("int").alias("y2"),
    )


_DIRTY = """dirty AS (SELECT o_custkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
  CASE WHEN o_totalprice > 495000 THEN NULL WHEN o_totalprice > 490000 THEN 2 ELSE CAST(o_orderpriority = '1-URGENT' AS INTEGER) END AS y1, CAST(o_totalprice > 300000 AS INTEGER) AS y2 FROM orders)"""


@query("clean_targets", f"""WITH {_DIRTY} SELECT id, month, min(y1) AS y1, min(y2) AS y2 FROM dirty GROUP BY 1, 2
  HAVING count(*) = count(y1) AND count(*) = count(y2) AND min(y1) = max(y1) AND min(y2) = max(y2) AND min(y1) IN (0, 1)""")
def _(spark, sf):
    return T.clean_targets(_dirty(spark, sf), ["id", "month"], ["y1", "y2"], strict=False)


@query("target_issues", f"""WITH {_DIRTY}, k AS (SELECT count(*) AS n, coalesce(min(y1) <> max(y1), false) OR min(y2) <> max(y2) AS conflict, count(*) FILTER (WHERE y1 IS NULL OR y2 IS NULL) AS nulls,
    count(*) FILTER (WHERE y1 NOT IN (0, 1) OR y2 NOT IN (0, 1)) AS odd FROM dirty GROUP BY id, month)
  SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(nulls) AS BIGINT) AS null_rows, CAST(sum(odd) AS BIGINT) AS non_binary_rows,
    CAST(sum(CASE WHEN NOT conflict THEN n - 1 ELSE 0 END) AS BIGINT) AS collapsed_rows, count(*) FILTER (WHERE conflict) AS conflicting_keys FROM k""")
def _(spark, sf):
    return T.target_issues(_dirty(spark, sf), ["id", "month"], ["y1", "y2"])


@query("fold_roles", f"WITH {TARGETS_SQL} SELECT id, month, fold, CASE WHEN fold = 0 THEN 'test' WHEN fold = 4 THEN 'val' ELSE 'train' END AS role FROM tgt")
def _(spark, sf):
    return T.fold_roles(targets(spark, sf), 0).select("id", "month", "fold", "role")


@query("rotate_folds", f"""WITH {TARGETS_SQL}, r AS (SELECT *, CAST(unnest(range(5)) AS INTEGER) AS test_fold FROM tgt)
  SELECT test_fold, CASE WHEN fold = test_fold THEN 'test' WHEN fold = (test_fold + 4) % 5 THEN 'val' ELSE 'train' END AS role, count(*) AS n, CAST(sum(y1) AS BIGINT) AS y1 FROM r GROUP BY 1, 2""")
def _(spark, sf):
    return T.rotate_folds(targets(spark, sf)).groupBy("test_fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("y1").alias("y1"))


_TRAIN, _TEST = ["1997-01-01", "1997-02-01", "1997-03-01"], ["1998-01-01", "1998-02-01"]


@query("calendar_split", f"""WITH {TARGETS_SQL} SELECT id, month, y1, CASE WHEN month < DATE '1998-01-01' THEN 'train' ELSE 'test' END AS role FROM tgt
  WHERE month IN (DATE '1997-01-01', DATE '1997-02-01', DATE '1997-03-01', DATE '1998-01-01', DATE '1998-02-01')""")
def _(spark, sf):
    return T.calendar_split(targets(spark, sf), _TRAIN, _TEST).select("id", "month", "y1", "role")


_GROUPS = f"""ids AS (SELECT id, row_number() OVER (ORDER BY {sql_hash('13', 'id')}, id) <= ceil(0.2::DOUBLE * count(*) OVER ()) AS valid FROM (SELECT DISTINCT id FROM tgt))"""


@query("group_split", f"WITH {TARGETS_SQL}, {_GROUPS} SELECT id, month, valid FROM tgt JOIN ids USING (id)")
def _(spark, sf):
    return T.group_split(targets(spark, sf), "id", 0.2, 13).select("id", "month", "valid")


@query("leak_report", f"""WITH {TARGETS_SQL}, r AS (SELECT *, CASE WHEN fold = 1 THEN 'test' WHEN fold = 0 THEN 'val' WHEN month > DATE '2000-12-01' THEN 'val' ELSE 'train' END AS role FROM tgt),
  c AS (SELECT id, count(DISTINCT fold) AS f, bool_or(role = 'train') AS a, bool_or(role = 'val') AS b, bool_or(role = 'test') AS t FROM r GROUP BY 1)
  SELECT count(*) FILTER (WHERE f > 1) AS clients_in_two_folds, count(*) FILTER (WHERE a AND b) AS clients_train_and_val, count(*) FILTER (WHERE a AND t) AS clients_train_and_test,
    0::BIGINT AS rows_in_two_roles, 0 AS empty_partitions, 0 AS one_class_partitions FROM c""")
def _(spark, sf):
    t = targets(spark, sf)
    leaky = T.fold_roles(t, 1).withColumn("role", F.when((F.col("role") == "train") & (F.col("month") > "2000-12-01"), "val").otherwise(F.col("role")))
    return T.leak_report(leaky, "id", ["id", "month"], ["y1", "y2"])


@query("undersample", f"""WITH {TARGETS_SQL}, q AS (SELECT fold, floor(count(*) FILTER (WHERE y1 = 1) * 1.5::DOUBLE) AS quota FROM tgt GROUP BY 1),
  n AS (SELECT id, month, fold, y1, row_number() OVER (PARTITION BY fold ORDER BY {sql_hash('3', 'id', 'month')}, id, month) AS r FROM tgt WHERE y1 = 0)
  SELECT id, month, fold, y1 FROM tgt WHERE y1 = 1 UNION ALL SELECT id, month, fold, y1 FROM n JOIN q USING (fold) WHERE r <= quota""")
def _(spark, sf):
    return T.undersample(targets(spark, sf), "y1", 1.5, 3, ["id", "month"], ["fold"]).select("id", "month", "fold", "y1")


@query("tune_cohort", f"""WITH {TARGETS_SQL} SELECT id, month FROM tgt WHERE id IN (SELECT id FROM (SELECT DISTINCT id FROM tgt) ORDER BY {sql_hash('5', 'id')}, id LIMIT 200)""")
def _(spark, sf):
    return T.tune_cohort(targets(spark, sf), "id", 200, 5).select("id", "month")


@query("class_balance", f"""WITH {TARGETS_SQL}, l AS (SELECT fold, 'y1' AS label, y1 AS y FROM tgt UNION ALL SELECT fold, 'y2', y2 FROM tgt UNION ALL SELECT fold, 'y3', y3 FROM tgt)
  SELECT fold, label, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 9) AS prevalence, round((count(*) - sum(y)) / greatest(sum(y), 1)::DOUBLE, 9) AS pos_weight FROM l GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(T.class_balance(targets(spark, sf), ["y1", "y2", "y3"], ["fold"]), 9, "prevalence", "pos_weight")


@query("missing_months", f"""WITH {TARGETS_SQL}, m AS (SELECT CAST(unnest(generate_series(DATE '1994-06-01', max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM tgt)
  SELECT month FROM m WHERE month NOT IN (SELECT month FROM tgt)""")
def _(spark, sf):
    t = targets(spark, sf)
    grid = t.agg(F.explode(F.sequence(F.lit("1994-06-01").cast("date"), F.max("month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return T.missing_months(t, grid)


# -- metrics ---------------------------------------------------------------------------

_BY = ["model", "lang"]
_STEPS = f"""WITH {SCORES_SQL}, st AS (SELECT model, lang, score, CAST(sum(y) AS BIGINT) AS p, CAST(count(*) - sum(y) AS BIGINT) AS n FROM sc GROUP BY 1, 2, 3),
  cu AS (SELECT *, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp FROM st WINDOW w AS (PARTITION BY model, lang ORDER BY score DESC))"""


@query("cumulative_confusion", _STEPS + " SELECT model, lang, round(score, 9) AS score, p, n, tp, fp FROM cu")
def _(spark, sf):
    return rounded(E.cumulative_confusion(scores(spark, sf), "y", "score", _BY), 9, "score")


# A group with one class has no ROC-AUC or average precision: NULL and a status, on both sides.


@query("roc_auc", f"""WITH {SCORES_SQL}, g AS (SELECT model, lang, CAST(sum(y) AS DOUBLE) AS p, count(*) AS n FROM sc GROUP BY 1, 2),
  pr AS (SELECT model, lang, sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) AS wins
    FROM sc a JOIN sc b USING (model, lang) WHERE a.y = 1 AND b.y = 0 GROUP BY 1, 2)
  SELECT model, lang, n AS n_rows, round(wins / (p * (n - p)), 9) AS roc_auc FROM g LEFT JOIN pr USING (model, lang)""")
def _(spark, sf):
    m = E.ranking_metrics(scores(spark, sf), "y", "score", _BY)
    return rounded(m.select("model", "lang", "n_rows", "roc_auc"), 9, "roc_auc")


@query("average_precision", _STEPS + " SELECT model, lang, CAST(sum(p) AS BIGINT) AS positives, round(sum(p) / sum(p + n), 9) AS prevalence, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN round(sum(p * tp / (tp + fp)::DOUBLE) / sum(p), 9) END AS pr_auc, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN 'OK' ELSE 'ONE_CLASS' END AS status FROM cu GROUP BY 1, 2")
def _(spark, sf):
    m = E.ranking_metrics(scores(spark, sf), "y", "score", _BY)
    return rounded(m.select("model", "lang", "positives", "prevalence", "pr_auc", "status"), 9, "prevalence", "pr_auc")


_TOP = f"""WITH {SCORES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY model) AS n, sum(y) OVER (PARTITION BY model) AS pos FROM sc),
  f AS (SELECT *, greatest(1, CAST(round_even(fraction * n, 0) AS BIGINT)) AS k FROM (SELECT *, unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS fraction FROM r)), t AS (SELECT * FROM f WHERE rank <= k)"""


@query("top_fraction", _TOP + " SELECT model, doc_id, rank, fraction, k FROM t")
def _(spark, sf):
    return E.top_fraction(scores(spark, sf), "score", ["model"], ["doc_id"]).select("model", "doc_id", "rank", "fraction", "k")


@query("precision_recall_at_k", _TOP + " SELECT model, fraction, k, round(sum(y) / k::DOUBLE, 9) AS precision, round(sum(y) / any_value(pos)::DOUBLE, 9) AS recall FROM t GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(E.precision_recall_at_k(scores(spark, sf), "y", "score", ["model"], ["doc_id"]), 9, "precision", "recall")


@query("precision_recall_at", f"""WITH {SCORES_SQL} SELECT model, lang, round(coalesce(count(*) FILTER (WHERE score >= 0.5 AND y = 1) / nullif(count(*) FILTER (WHERE score >= 0.5), 0)::DOUBLE, 0), 9) AS precision,
  round(coalesce(count(*) FILTER (WHERE score >= 0.5 AND y = 1) / nullif(count(*) FILTER (WHERE y = 1), 0)::DOUBLE, 0), 9) AS recall FROM sc GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(E.precision_recall_at(scores(spark, sf), "y", "score", _BY), 9, "precision", "recall")


def _results(spark, sf):
    """A result table: hashed scores of every order against three targets, by fold."""
    t = targets(spark, sf)
    cells = F.array(*[F.struct(F.lit(y).alias("target"), F.col(y).alias("y")) for y in ("y1", "y2", "y3")])
    long = t.select("id", "month", F.col("fold").alias("test_fold"), F.inline(cells))
    models = F.array(*[F.struct(F.lit(m).alias("model"), (hash60(m, "id") % 1000 / F.lit(1000.0)).alias("score")) for m in ("a", "b")])
    rows = long.select("test_fold", "target", "y", F.inline(models))
    return E.ranking_metrics(rows, "y", "score", ["model", "target", "test_fold"])


_RESULTS = f"""WITH {TARGETS_SQL}, l AS (SELECT id, fold AS test_fold, 'y1' AS target, y1 AS y FROM tgt UNION ALL SELECT id, fold, 'y2', y2 FROM tgt UNION ALL SELECT id, fold, 'y3', y3 FROM tgt),
  s AS (SELECT 'a' AS model, *, ({sql_hash('a', 'id')} % 1000) / 1000.0::DOUBLE AS score FROM l UNION ALL SELECT 'b', *, ({sql_hash('b', 'id')} % 1000) / 1000.0::DOUBLE FROM l),
  st AS (SELECT model, target, test_fold, score, sum(y)::DOUBLE AS p, (count(*) - sum(y))::DOUBLE AS n FROM s GROUP BY ALL),
  cu AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM st WINDOW w AS (PARTITION BY model, target, test_fold ORDER BY score DESC)),
  res AS (SELECT model, target, test_fold, CAST(sum(p + n) AS BIGINT) AS n_rows, sum(p) / sum(p + n) AS prevalence, sum(p * tp / (tp + fp)) / sum(p) AS pr_auc,
    1 - sum(p * (fp - n + n / 2)) / (sum(p) * sum(n)) AS roc_auc FROM cu GROUP BY 1, 2, 3),
  agg AS (SELECT model, target, count(DISTINCT test_fold) AS n_folds, CAST(sum(n_rows) AS BIGINT) AS n_test_rows_total, avg(prevalence) AS prevalence_mean, avg(pr_auc) AS pr_auc_mean,
    stddev_samp(pr_auc) AS pr_auc_std, avg(roc_auc) AS roc_auc_mean, stddev_samp(roc_auc) AS roc_auc_std FROM res GROUP BY 1, 2)"""
_MEANS = ["prevalence_mean", "pr_auc_mean", "pr_auc_std", "roc_auc_mean", "roc_auc_std"]


@query("fold_summary", _RESULTS + " SELECT model, target, n_folds, n_test_rows_total, " + ", ".join(f"round({c}, 8) AS {c}" for c in _MEANS) + " FROM agg")
def _(spark, sf):
    return rounded(E.summarise_folds(_results(spark, sf)), 8, *_MEANS)


@query("macro_summary", _RESULTS + " SELECT model, round(avg(roc_auc_mean), 8) AS mean_roc_auc_across_targets, round(avg(pr_auc_mean), 8) AS mean_pr_auc_across_targets FROM agg GROUP BY 1")
def _(spark, sf):
    m = E.macro(E.summarise_folds(_results(spark, sf)))
    return rounded(m, 8, "mean_roc_auc_across_targets", "mean_pr_auc_across_targets")


@query("settings_report", "SELECT o_custkey AS model, count(DISTINCT o_orderpriority) AS n_settings, count(DISTINCT o_orderpriority) = 1 AS same_settings FROM orders GROUP BY 1")
def _(spark, sf):
    return E.settings_report(table(spark, sf, "orders").withColumnRenamed("o_custkey", "model"), ["model"], "o_orderpriority")


@query("compare_runs", _RESULTS + """, f AS (SELECT target, test_fold, max(CASE WHEN model = 'a' THEN n_rows END) AS n_test, max(CASE WHEN model = 'a' THEN prevalence END) AS prevalence,
    max(CASE WHEN model = 'a' THEN pr_auc END) AS op, max(CASE WHEN model = 'b' THEN pr_auc END) AS np, max(CASE WHEN model = 'a' THEN roc_auc END) AS o, max(CASE WHEN model = 'b' THEN roc_auc END) AS n FROM res GROUP BY 1, 2)
  SELECT target, test_fold, n_test, round(prevalence, 8) AS prevalence, round(op, 8) AS old_pr_auc, round(np, 8) AS new_pr_auc, round(o, 8) AS old_roc_auc, round(n, 8) AS new_roc_auc,
    round(np - op, 8) + 0.0 AS delta_pr_auc, round(n - o, 8) + 0.0 AS delta_roc_auc, test_fold <> 2 AS comparable FROM f""")
def _(spark, sf):
    r = materialise(_results(spark, sf)).withColumn("cohort", F.concat("model", F.col("test_fold").cast("string")))
    one = r.withColumn("cohort", F.when(F.col("test_fold") == 2, F.col("cohort")).otherwise("same"))
    c = E.compare_runs(one.where("model = 'a'"), one.where("model = 'b'"), ("target", "test_fold"))
    c = rounded(c, 8, *[n for n in c.columns if n.endswith("_auc") or n == "prevalence"])
    return c.withColumn("delta_pr_auc", F.col("delta_pr_auc") + F.lit(0.0)).withColumn("delta_roc_auc", F.col("delta_roc_auc") + F.lit(0.0))


# -- probes ----------------------------------------------------------------------------


TRIALS, TUNE_CLIENTS = 4, 100_000


def _probe_panel(spark, sf):
    """Statistical window embeddings joined to next-month targets, with fold roles. Windows without
    a target have no part in the panel and are not computed."""
    dates = [f"1998-{m:02d}-01" for m in range(1, 13)]
    targets = dated_targets(spark, sf)
    labelled = targets.select(F.col("id").alias("client_id"), F.col("date").alias("target_date"))
    w = W.windows(ledger(spark, sf), LEDGER, dates, 12, max_events=MAX_EVENTS, wanted=labelled)
    # written once: the join reads the keys a second time
    emb = materialise(B.stat_panel(B.stat_features(w, LEDGER), "client_id").withColumnRenamed("client_id", "id"))
    return T.fold_roles(D.join_panel(targets, emb, KEYS), 4)


@query("gbt_probe")
def _(spark, sf):
    from ledgerflow.operators import probe as X

    p = materialise(_probe_panel(spark, sf))
    train, val, test = (p.where(F.col("role") == r) for r in ("train", "val", "test"))
    model, rounds = X.fit_gbt_probe(train, val, "y2", "emb", X.TreeParams())
    m = X.test_metrics(X.score_with(model, test, "emb"), "y2", KEYS)
    return m.withColumn("rounds", F.lit(rounds))


@query("mlp_probe")
def _(spark, sf):
    from ledgerflow.operators import probe as X

    p = materialise(_probe_panel(spark, sf))
    dim = len(p.first()["emb"])
    model, fitted = X.fit_mlp_probe(p.where("role <> 'test'"), "y2", "emb", dim, X.MlpParams())
    test = D.standardise(p.where("role = 'test'"), fitted, "emb", X.CLIP)
    return X.test_metrics(X.score_with(model, test, "emb"), "y2", KEYS)


@query("tune_and_test")
def _(spark, sf):
    from ledgerflow.operators import probe as X

    metrics, trials, chosen = X.tune_and_test(_probe_panel(spark, sf), "y2", "emb", "id", KEYS, X.tree_candidates(0, TRIALS), TUNE_CLIENTS)
    best = trials.agg(F.max("val_pr_auc").alias("best_val_pr_auc"), F.count(F.lit(1)).alias("trials"))
    return attach_row(metrics, best).withColumn("rounds", F.lit(chosen.rounds))


@query("score_only")
def _(spark, sf):
    from uuid import uuid4

    from ledgerflow.operators import probe as X

    p = materialise(_probe_panel(spark, sf))
    model, _ = X.fit_gbt_probe(p.where("role = 'train'"), None, "y1", "emb", X.TreeParams())
    path = f"{scratch_dir(spark)}/model-{uuid4().hex}"
    model.save(path)
    return X.score_only(spark, path, p.where("role = 'test'"), "y1", "emb", KEYS)
