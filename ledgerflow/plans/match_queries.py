"""Queries over schema matching: distances, selections, validation, recovery, noise, sweep."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerflow.operators import match as M
from ledgerflow.operators import metrics as E
from ledgerflow.operators import noise as N
from ledgerflow.operators import profile as P
from ledgerflow.operators import sweep as W
from ledgerflow.plans.profile_queries import LEVELS, rounded
from ledgerflow.plans.registry import query
from ledgerflow.plans.standins import (
    CATEGORIES, LEDGER, LEDGER_SQL, NUMERICS, SPECS, fold, ledger, raw_ledger, sql_shard, sql_uniform, table,
)
from ledgerflow.operators.conform import daily_rollup
from ledgerflow.schema import ColumnSpec
from ledgerflow.sources import mappings as J
from ledgerflow.sources.readers import attach_row, materialise, scratch_dir

#: The two sides of a match: the clients of three and of two of the five folds, all together.
HALF_A, HALF_B = "_f IN (0, 2, 4)", "_f IN (1, 3)"
ANON = {s.name: f"col_a{i}" for i, s in enumerate(SPECS)}
ANON_SPECS = [ColumnSpec(ANON[s.name], s.kind) for s in SPECS]


def side(spark, sf, which: str):
    """One half of the clients with anonymous names, or the other with its own."""
    led = ledger(spark, sf).withColumn("_f", fold("client_id"))
    if which == "a":
        return led.where(HALF_A).select(*[F.col(c).alias(a) for c, a in ANON.items()])
    return led.where(HALF_B).select(*ANON)


def passports(spark, sf):
    a = materialise(P.profile_columns(side(spark, sf, "a"), ANON_SPECS))
    return a, materialise(P.profile_columns(side(spark, sf, "b"), SPECS))


def category_passports(spark, sf, which: str, names):
    """``passports`` of the categorical columns of one half: all that pairs of categories need."""
    specs = [ColumnSpec(ANON[c] if which == "a" else c, "categorical") for c in names]
    df = side(spark, sf, which).select(*[s.name for s in specs])
    return materialise(P.profile_columns(df, specs, materialise(P.category_counts(df, specs))))


def _passport_sql(name: str, where: str, names: dict) -> str:
    cat = " UNION ALL ".join(f"SELECT '{names[c]}' AS c, CAST({c} AS VARCHAR) AS v FROM led WHERE {where}" for c in CATEGORIES)
    num = " UNION ALL ".join(f"SELECT '{names[c]}' AS c, {c} AS v FROM led WHERE {where}" for c in NUMERICS)
    return f"""{name}_v AS (SELECT c, v, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY c) AS rows FROM ({cat}) GROUP BY 1, 2),
  {name}_c AS (SELECT c, 'categorical' AS kind, any_value(rows)::DOUBLE AS n_rows, sum(n) FILTER (WHERE v IS NOT NULL) AS n_valid, count(v) AS n_unique,
    max(n) FILTER (WHERE v IS NOT NULL) AS top1, list(n) FILTER (WHERE v IS NOT NULL) AS ns FROM {name}_v GROUP BY 1),
  {name}_q AS (SELECT c, 'numeric' AS kind, count(*)::DOUBLE AS n_rows, count(v)::DOUBLE AS n_valid, count(DISTINCT v) AS n_unique, min(v) AS lo, max(v) AS hi,
    avg(CASE WHEN v = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS zero_share, quantile_cont(v, {LEVELS}) AS q FROM ({num}) GROUP BY 1),
  {name} AS (SELECT c, kind, n_valid, n_unique, 1 - n_valid / n_rows AS null_share,
      CASE WHEN n_unique > 1 THEN list_sum(list_transform(ns, lambda n: -n / n_valid * log2(n / n_valid))) / log2(n_unique) ELSE 0 END AS entropy,
      top1 / n_valid AS top1, NULL::DOUBLE AS zero_share, NULL::DOUBLE[] AS shape, NULL AS subtype FROM {name}_c
    UNION ALL SELECT c, kind, n_valid, n_unique, 1 - n_valid / n_rows, NULL, NULL, zero_share,
      list_transform(q, lambda v: (v - q[11]) / (q[20] - q[2])), CASE n_unique WHEN 1 THEN 'constant' WHEN 2 THEN 'binary' ELSE 'continuous' END FROM {name}_q)"""


_FOLD = sql_shard(5, "client_id", seed="fold")
_SAME = {c: c for c in ANON}


def _distance_sql(weights: str) -> str:
    wc, wn = M.WEIGHTS[weights]["categorical"], M.WEIGHTS[weights]["numeric"]
    return f"""{_passport_sql('pa', f'{_FOLD} IN (0, 2, 4)', ANON)}, {_passport_sql('pb', f'{_FOLD} IN (1, 3)', _SAME)},
  x AS (SELECT a.c AS source, b.c AS target, a.kind AS source_kind, b.kind AS target_kind, a.subtype AS s1, b.subtype AS s2,
      abs(a.null_share - b.null_share) AS d_null, abs(a.entropy - b.entropy) AS d_entropy, abs(a.top1 - b.top1) AS d_top1, abs(a.zero_share - b.zero_share) AS d_zero,
      log10(a.n_unique) - log10(b.n_unique) AS du, log10(a.n_valid) - log10(b.n_valid) AS dn,
      list_sum(list_transform(list_zip(a.shape, b.shape), lambda z: abs(z[1] - z[2]))) / 21 AS l1 FROM pa a, pb b),
  y AS (SELECT *, greatest(0, abs(du) - CASE WHEN du * dn > 0 THEN abs(dn) ELSE 0 END) / 0.75::DOUBLE AS card FROM x),
  z AS (SELECT *, CASE WHEN source_kind <> target_kind THEN 'different_kinds' WHEN source_kind = 'categorical' AND card > 1 THEN 'cardinality_gate'
      WHEN source_kind = 'numeric' AND s1 <> s2 THEN 'different_numeric_subtypes' ELSE 'compatible' END AS gate FROM y),
  w AS (SELECT *, CASE WHEN gate <> 'compatible' THEN 1 WHEN source_kind = 'categorical' THEN
      least(1, {wc['cardinality']}::DOUBLE * card + {wc['entropy']}::DOUBLE * d_entropy + {wc['top1']}::DOUBLE * d_top1 + {wc['null']}::DOUBLE * d_null)
      ELSE least(1, {wn['quantile']}::DOUBLE * (l1 / (1 + l1)) + {wn['zero']}::DOUBLE * d_zero + {wn['null']}::DOUBLE * d_null) END AS distance FROM z),
  dist AS (SELECT source, target, source_kind, target_kind, distance, gate = 'compatible' AND distance < 1 AND distance <= 0.7 AS allowed,
      CASE WHEN gate = 'compatible' AND NOT (distance < 1 AND distance <= 0.7) THEN 'distance_threshold' ELSE gate END AS reason FROM w)"""


DIST_SQL = f"WITH {LEDGER_SQL}, {_distance_sql('v2')}"


def distances(spark, sf, weights="v2"):
    return M.passport_distance(*passports(spark, sf), weights)


@query("passport_distance", DIST_SQL + " SELECT source, target, source_kind, target_kind, round(distance, 8) AS distance, allowed, reason FROM dist")
def _(spark, sf):
    d = distances(spark, sf).select("source", "target", "source_kind", "target_kind", "distance", "allowed", "reason")
    return rounded(d, 8, "distance")


@query("passport_distance_flat", f"WITH {LEDGER_SQL}, {_distance_sql('flat')} SELECT source, target, round(distance, 8) AS distance, reason FROM dist")
def _(spark, sf):
    return rounded(distances(spark, sf, "flat").select("source", "target", "distance", "reason"), 8, "distance")


@query("pair_diagnostics", f"""WITH {LEDGER_SQL}, {_distance_sql('v2')} SELECT source, target, CASE WHEN gate = 'compatible' THEN round(d_null, 8) END AS d_null,
  CASE WHEN gate = 'compatible' AND source_kind = 'categorical' THEN round(card, 8) END AS d_cardinality,
  CASE WHEN gate = 'compatible' THEN round(d_entropy, 8) END AS d_entropy, CASE WHEN gate = 'compatible' THEN round(d_top1, 8) END AS d_top1,
  CASE WHEN gate = 'compatible' THEN round(l1 / (1 + l1), 8) END AS d_quantile, CASE WHEN gate = 'compatible' THEN round(d_zero, 8) END AS d_zero FROM w""")
def _(spark, sf):
    parts = ["d_null", "d_cardinality", "d_entropy", "d_top1", "d_quantile", "d_zero"]
    return rounded(distances(spark, sf).select("source", "target", *parts), 8, *parts)


@query("allowed_pairs", DIST_SQL + " SELECT source, target, round(distance, 8) AS distance FROM dist WHERE allowed")
def _(spark, sf):
    return rounded(M.allowed_pairs(distances(spark, sf)), 8, "distance")


def _v1_sql(n: str, where: str, names: dict) -> str:
    num = " UNION ALL ".join(f"SELECT '{names[c]}' AS c, {c} AS v FROM led WHERE {where}" for c in NUMERICS)
    return f"""{n}_r AS (SELECT c, v, n, row_number() OVER (PARTITION BY c ORDER BY n DESC) AS r, sum(n) OVER (PARTITION BY c) AS t FROM {n}_v),
  {n}_1 AS (SELECT c, 'categorical' AS kind, count(v) AS n_unique, CASE WHEN count(*) > 1 THEN round(-sum(n / t * log2(n / t)) / log2(count(*)), 4) ELSE 0 END AS e,
    round(max(n) / any_value(t), 4) AS top1, NULL::DOUBLE AS zero, NULL::DOUBLE[] AS hist FROM {n}_r GROUP BY 1),
  {n}_b AS (SELECT c, least(floor((v - lo) / ((hi - lo) / 20.0::DOUBLE)), 19) AS b, count(*) / any_value(n_rows) AS p FROM ({num}) JOIN {n}_q USING (c) GROUP BY 1, 2),
  {n}_g AS (SELECT c, list(round(coalesce(p, 0), 6) ORDER BY b) AS hist FROM (SELECT c, unnest(range(20)) AS b FROM {n}_q) LEFT JOIN {n}_b USING (c, b) GROUP BY 1),
  {n}_2 AS (SELECT * FROM {n}_1 UNION ALL SELECT c, 'numeric', n_unique,
    round(list_sum(list_transform(list_filter(hist, lambda p: p > 0), lambda p: -p * log2(p))) / log2(20), 4), NULL, round(zero_share, 4), hist FROM {n}_q JOIN {n}_g USING (c))"""


def v1_passports(df, specs):
    counts = materialise(P.value_counts_long(df, specs))
    hist = P.equal_width_hist(counts).withColumn("share", F.round("share", 6))
    shares = hist.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("bin", "share"))).alias("h"))
    shares = shares.select("column", F.transform("h", lambda x: x["share"]).alias("hist"))
    cat = P.categorical_profile_v1(counts).select("column", "entropy_norm", "top1_share")
    num = P.numeric_profile(counts).select("column", F.round("zero_share", 4).alias("zero_share"))
    num_e = P.hist_entropy(hist).select("column", F.round("entropy_norm", 4).alias("_e"))
    base = P.base_profile(counts).select("column", "kind", "n_unique", "n_valid")
    j = base.join(cat, "column", "left").join(num, "column", "left").join(num_e, "column", "left").join(shares, "column", "left")
    return j.withColumn("entropy_norm", F.coalesce("entropy_norm", "_e")).drop("_e")


@query("passport_similarity_v1", f"""WITH {LEDGER_SQL}, {_passport_sql('pa', f'{_FOLD} IN (0, 2, 4)', ANON)}, {_passport_sql('pb', f'{_FOLD} IN (1, 3)', _SAME)},
  {_v1_sql('pa', f'{_FOLD} IN (0, 2, 4)', ANON)}, {_v1_sql('pb', f'{_FOLD} IN (1, 3)', _SAME)},
  x AS (SELECT a.c AS source, b.c AS target, a.kind AS kind, b.kind AS k2, abs(log10(a.n_unique) - log10(b.n_unique)) AS un, abs(a.e - b.e) AS de,
    abs(coalesce(a.top1, 0) - coalesce(b.top1, 0)) AS dt, abs(coalesce(a.zero, 0) - coalesce(b.zero, 0)) AS dz,
    list_sum(list_transform(list_zip(a.hist, b.hist), lambda z: abs(z[1] - z[2]))) / 2 AS l1 FROM pa_2 a, pb_2 b)
  SELECT source, target, kind, round(CASE WHEN kind <> k2 OR un > 0.75 THEN 0 WHEN kind = 'categorical' THEN greatest(0, 1 - (0.4 * un / 3 + 0.4 * de + 0.2 * dt))
    ELSE greatest(0, 1 - (0.25 * un / 3 + 0.25 * de + 0.2 * dz + 0.3 * l1)) END, 8) AS similarity FROM x""")
def _(spark, sf):
    a = v1_passports(side(spark, sf, "a"), ANON_SPECS)
    b = v1_passports(side(spark, sf, "b"), SPECS)
    return rounded(M.passport_similarity_v1(a, b), 8, "similarity")


_SELECT = """r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY allowed DESC, score DESC, distance, source) AS r,
    coalesce(lead(CASE WHEN allowed THEN score END) OVER (PARTITION BY target ORDER BY allowed DESC, score DESC, distance, source), 0) AS second,
    count(*) FILTER (WHERE allowed) OVER (PARTITION BY target) AS candidate_count, sum(CASE WHEN allowed THEN score ELSE 0 END) OVER (PARTITION BY target) AS mass FROM s),
  p AS (SELECT target, CASE WHEN mass > 0 THEN source END AS source, CASE WHEN mass > 0 THEN 'mapped' ELSE 'unfilled' END AS status, CASE WHEN mass > 0 THEN distance END AS distance,
    CASE WHEN mass > 0 THEN score END AS score, CASE WHEN mass > 0 THEN second END AS second_score, CASE WHEN mass > 0 THEN score - second END AS column_margin,
    CASE WHEN mass > 0 AND score - second <= 0.05 THEN 'AMBIGUOUS' WHEN mass > 0 THEN 'SEPARATED' END AS ambiguity, candidate_count FROM r WHERE r = 1),
  sel AS (SELECT *, CASE WHEN source IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY source) END AS source_reuse_count FROM p)"""
_SELECTED = " SELECT target, source, status, round(distance, 8) AS distance, round(score, 8) AS score, round(second_score, 8) AS second_score, round(column_margin, 8) AS column_margin, ambiguity, candidate_count, source_reuse_count FROM sel"


def _rounded_selection(sel):
    return rounded(sel, 8, "distance", "score", "second_score", "column_margin")


def _soft_scores(d):
    """Closeness shared out over a target's allowed sources; the last numeric field has none."""
    kept = F.col("allowed") & (F.col("target") != "balance")
    return d.withColumn("allowed", kept).withColumn("score", F.when(kept, 1 - F.col("distance")).otherwise(0.0))


_SOFT = "s AS (SELECT source, target, distance, allowed AND target <> 'balance' AS allowed, CASE WHEN allowed AND target <> 'balance' THEN 1 - distance ELSE 0 END AS score FROM dist)"


@query("select_columns", DIST_SQL + f", {_SOFT}, {_SELECT}" + _SELECTED)
def _(spark, sf):
    return _rounded_selection(M.select_columns(_soft_scores(distances(spark, sf))))


_NEAREST = "s AS (SELECT *, CASE WHEN allowed AND row_number() OVER (PARTITION BY target ORDER BY allowed DESC, distance, source) = 1 THEN 1.0::DOUBLE ELSE 0 END AS score FROM dist)"


@query("match_by_passport", DIST_SQL + f", {_NEAREST}, {_SELECT}" + _SELECTED)
def _(spark, sf):
    return _rounded_selection(M.match_by_passport(distances(spark, sf)))


@query("assignment_margins", DIST_SQL + f""", {_NEAREST}, {_SELECT}, u AS (SELECT source, target, 1 - distance AS sim FROM dist)
  SELECT u.source, u.target, round(u.sim, 8) AS similarity,
    round(u.sim - coalesce((SELECT max(o.sim) FROM u o WHERE o.source = u.source AND o.target <> u.target AND o.sim > 0 AND o.sim >= 0.3), 0), 8) + 0.0 AS row_margin,
    round(u.sim - coalesce((SELECT max(o.sim) FROM u o WHERE o.target = u.target AND o.source <> u.source AND o.sim > 0 AND o.sim >= 0.3), 0), 8) + 0.0 AS column_margin
  FROM u JOIN sel ON sel.source = u.source AND sel.target = u.target""")
def _(spark, sf):
    d = materialise(distances(spark, sf))
    sims = d.select("source", "target", (1 - F.col("distance")).alias("similarity"))
    m = rounded(M.assignment_margins(sims, M.match_by_passport(d).dropna(subset=["source"])), 8, "similarity", "row_margin", "column_margin")
    return m.withColumn("row_margin", F.col("row_margin") + F.lit(0.0)).withColumn("column_margin", F.col("column_margin") + F.lit(0.0))


@query("mapping_table", DIST_SQL + f""", {_SOFT}, {_SELECT}, cols AS (SELECT DISTINCT source AS c, source_kind AS kind FROM dist)
  SELECT 'col_time' AS source, 'time' AS kind, 'event_time' AS target, NULL::DOUBLE AS distance, 'fixed' AS status
  UNION ALL SELECT c, kind, target, round(distance, 8), CASE WHEN c IS NULL THEN 'unfilled' WHEN target IS NULL THEN 'dropped' ELSE 'mapped' END FROM cols FULL JOIN sel ON c = source""")
def _(spark, sf):
    d = materialise(distances(spark, sf))
    cols = d.select(F.col("source").alias("column"), F.col("source_kind").alias("kind")).distinct()
    t = M.mapping_table(cols, M.select_columns(_soft_scores(d)), [("col_time", "event_time")])
    return rounded(t, 8, "distance")


@query("reverse_map", DIST_SQL + f", {_SOFT}, {_SELECT} SELECT source, array_to_string(list(target ORDER BY target), ',') AS targets FROM sel WHERE source IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return M.reverse_map(M.select_columns(_soft_scores(distances(spark, sf)))).withColumn("targets", F.array_join("targets", ","))


@query("check_anchors", DIST_SQL + f""", {_SOFT}, {_SELECT}, cols AS (SELECT DISTINCT source FROM dist), tg AS (SELECT target, row_number() OVER (ORDER BY target) AS i FROM (SELECT DISTINCT target FROM dist)),
  anchors AS (SELECT source, target AS expected, CASE WHEN i <= 6 THEN 'hard' ELSE 'soft' END AS strength FROM cols, tg),
  one AS (SELECT source, min(target) AS assigned FROM sel WHERE source IS NOT NULL GROUP BY 1)
  SELECT a.source, expected, strength, assigned, CASE WHEN strength <> 'hard' THEN 'INFO' WHEN assigned = expected THEN 'OK'
    WHEN abs(e.distance - g.distance) <= 0.05 THEN 'AMBIGUOUS' ELSE 'FAIL' END AS verdict
  FROM anchors a LEFT JOIN one USING (source) LEFT JOIN dist e ON e.source = a.source AND e.target = expected LEFT JOIN dist g ON g.source = a.source AND g.target = assigned""")
def _(spark, sf):
    d = materialise(distances(spark, sf))
    sims = d.select("source", "target", (1 - F.col("distance")).alias("similarity"))
    hard = sorted(c for c in ANON)[:6]
    anchors = d.select("source", F.col("target").alias("expected"), F.when(F.col("target").isin(*hard), "hard").otherwise("soft").alias("strength"))
    one = M.select_columns(_soft_scores(d)).where(F.col("source").isNotNull()).groupBy("source").agg(F.min("target").alias("target"))
    return M.check_anchors(one, sims, anchors)


# -- structure objective and solvers ---------------------------------------------------

_CX = " UNION ALL ".join(
    f"SELECT '{a}' AS i, '{b}' AS j, (SELECT count(DISTINCT ({a}, {b})) FROM led WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS c" for a in CATEGORIES for b in CATEGORIES if a != b
)


def joint_structure(led, names, rename):
    """A cheap symmetric structure: 1 / (1 + log10 of the joint distinct count)."""
    pairs = [(rename[a], rename[b]) for i, a in enumerate(names) for b in names[i + 1:]]
    joint = P.joint_values(led.select(*[F.col(c).alias(rename[c]) for c in names]), pairs)
    g = joint.groupBy("left", "right").agg((F.lit(1.0) / (1 + F.log10(F.count(F.lit(1)).cast("double")))).alias("distance"))
    return M.symmetric(g)


def _uniform_plan(d):
    """Each target's mass spread evenly over its allowed sources."""
    ok = d.where("allowed")
    per = ok.groupBy("target").agg(F.count(F.lit(1)).alias("_k"))
    m = per.agg(F.count(F.lit(1)).alias("_m"))
    return attach_row(ok.join(per, "target"), m).select("source", "target", (F.lit(1.0) / F.col("_k") / F.col("_m")).alias("mass"))


_OBJ_X = _CX.replace("FROM led WHERE", f"FROM led WHERE {_FOLD} IN (0, 2, 4) AND")
_OBJ_Y = _CX.replace("FROM led WHERE", f"FROM led WHERE {_FOLD} IN (1, 3) AND")
for _c in CATEGORIES:
    _OBJ_X = _OBJ_X.replace(f"'{_c}'", f"'{ANON[_c]}'")


@query("fgw_objective", DIST_SQL + f""", cx AS (SELECT i, j, 1 / (1 + log10(c)) AS c FROM ({_OBJ_X})), cy AS (SELECT i, j, 1 / (1 + log10(c)) AS c FROM ({_OBJ_Y})),
  d AS (SELECT * FROM dist WHERE source_kind = 'categorical' AND target_kind = 'categorical'),
  t AS (SELECT source, target, 1.0::DOUBLE / count(*) OVER (PARTITION BY target) / (SELECT count(DISTINCT target) FROM d WHERE allowed) AS mass FROM d WHERE allowed),
  f AS (SELECT sum(d.distance * mass) AS feature FROM t JOIN d USING (source, target)),
  s AS (SELECT sum((coalesce(cx.c, 0) - coalesce(cy.c, 0)) ^ 2 * t1.mass * t2.mass) AS structure FROM t t1, t t2
    LEFT JOIN cx ON cx.i = t1.source AND cx.j = t2.source LEFT JOIN cy ON cy.i = t1.target AND cy.j = t2.target)
  SELECT round(feature, 8) AS feature_loss, round(structure, 8) AS structure_loss, round(0.5 * feature + 0.5 * structure, 8) AS objective FROM f, s""")
def _(spark, sf):
    names = list(CATEGORIES)
    d = materialise(M.passport_distance(*(category_passports(spark, sf, h, names) for h in "ab")))
    led = ledger(spark, sf).withColumn("_f", fold("client_id"))
    cx = joint_structure(led.where(HALF_A), names, ANON)
    cy = joint_structure(led.where(HALF_B), names, {c: c for c in names})
    o = M.fgw_objective(_uniform_plan(d), d, cx, cy, 0.5)
    return rounded(o, 8, "feature_loss", "structure_loss", "objective")


def _paired(case, one, other):
    """Distances and both dependency structures of two profiled tables, as a one-case problem."""
    (pa, ca), (pb, cb) = one, other
    named = F.lit(case).alias("case")
    d = M.passport_distance(pa, pb).select(named, "*")
    return d, M.symmetric(ca).select(named, "*"), M.symmetric(cb).select(named, "*")


def _recovered(selection, by=("case",)):
    rows = [(t, s) for t, s in ANON.items()]
    truth = selection.sparkSession.createDataFrame(rows, "target string, truth string")
    return selection.join(truth, "target").withColumnRenamed("source", "recovered")


@query("match_columns")
def _(spark, sf):
    """Semi-relaxed matching of the anonymous fold to the named one, three mixing weights."""
    a, b = materialise(side(spark, sf, "a")), materialise(side(spark, sf, "b"))
    d, cx, cy = _paired("folds", P.matching_source(a, ANON_SPECS), P.matching_source(b, SPECS))
    d = materialise(d)
    solved = materialise(M.solve_plans(M.match_problems(d, cx, cy), [0.0, 0.5, 1.0], n_init=5))
    sel = M.match_columns(d, solved)
    return sel.join(solved.select("case", "alpha", "objective", "gap", "converged"), ["case", "alpha"])


def testbed_sources(spark, sf):
    """Both halves of the clients, raw and rolled up by day, each profiled once: (table, shape) -> (passports, dependences)."""
    led = ledger(spark, sf).withColumn("_f", fold("client_id"))
    fields = [c for c in ANON if c != "balance"]
    specs = [s for s in SPECS if s.name != "balance"]
    out = {}
    for name, half in (("a", HALF_A), ("b", HALF_B)):
        raw = materialise(led.where(half).select("client_id", "event_time", *fields))
        for shape in ("raw", "daily"):
            # the first numeric is summed; the second is constant inside an order, not a key
            df = raw if shape == "raw" else materialise(daily_rollup(raw, LEDGER, "amount"))
            own = [ColumnSpec(ANON[s.name], s.kind) for s in specs] if name == "a" else specs
            out[name, shape] = P.matching_source(df.select(*[F.col(c).alias(s.name) for c, s in zip(fields, own)]), own)
    return out


@query("testbeds")
def _(spark, sf):
    """Known-truth recovery: fold vs fold, rolled-up fold vs fold, roll-up vs raw."""
    made = testbed_sources(spark, sf)
    parts = [_paired(case, made["a", x], made["b", y]) for case, x, y in (("folds", "raw", "raw"), ("daily_folds", "daily", "daily"), ("daily", "daily", "raw"))]
    d, cx, cy = parts[0]
    for p in parts[1:]:
        d, cx, cy = d.unionByName(p[0]), cx.unionByName(p[1]), cy.unionByName(p[2])
    d = materialise(d)
    solved = M.solve_plans(M.match_problems(d, cx, cy), [0.5])
    return M.recovery_metrics(_recovered(M.match_columns(d, materialise(solved))), ["case"])


@query("assign_one_to_one")
def _(spark, sf):
    d = distances(spark, sf).where("source_kind = target_kind")
    pairs = d.select(F.lit("folds").alias("pair"), F.col("source_kind").alias("kind"), "source", "target", (1 - F.col("distance")).alias("similarity"))
    return M.assign_one_to_one(pairs, ["pair", "kind"])


@query("assignment_gaps")
def _(spark, sf):
    d = distances(spark, sf).where("source_kind = target_kind")
    pairs = d.select(F.lit("folds").alias("pair"), F.col("source_kind").alias("kind"), "source", "target", (1 - F.col("distance")).alias("similarity"))
    return M.assignment_gaps(materialise(pairs), ["pair", "kind"])


# -- validation and recovery over tables of many mappings ------------------------------

_FIELDS = ["f1", "f2", "f3", "f4", "f5", "f6", "event_time"]


def _mappings(spark, sf):
    """Every order is a mapping: its line numbers are fields, its suppliers sources."""
    li = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("mapping_id"), (F.pmod("l_orderkey", F.lit(3)) == 0).alias("legacy"),
        F.when(n == 7, "event_time").otherwise(F.concat(F.lit("f"), n.cast("string"))).alias("field"),
        F.when(F.col("l_discount") > 0.09, F.lit(None).cast("string")).when((n == 7) & (F.col("l_tax") < 0.07), "col_1")
        .otherwise(F.concat(F.lit("col_"), F.pmod("l_suppkey", F.lit(9)).cast("string"))).alias("source"),
        "l_returnflag", "l_linestatus",
    )


_MAP_SQL = """m AS (SELECT l_orderkey AS mapping_id, l_orderkey % 3 = 0 AS legacy, CASE WHEN l_linenumber = 7 THEN 'event_time' ELSE 'f' || l_linenumber END AS field,
    CASE WHEN l_discount > 0.09 THEN NULL WHEN l_linenumber = 7 AND l_tax < 0.07 THEN 'col_1' ELSE 'col_' || (l_suppkey % 9) END AS source, l_returnflag, l_linestatus FROM lineitem),
  rev AS (SELECT DISTINCT mapping_id, source, field FROM m WHERE l_returnflag <> 'A' AND source IS NOT NULL),
  unf AS (SELECT DISTINCT mapping_id, field FROM m WHERE l_linestatus = 'O' AND source IS NULL),
  fk AS (SELECT * FROM (VALUES ('f1', 'categorical'), ('f2', 'categorical'), ('f3', 'categorical'), ('f4', 'categorical'), ('f5', 'numeric'), ('event_time', 'time')) v(field, fk)),
  sk AS (SELECT * FROM (VALUES ('col_1', 'time'), ('col_2', 'categorical'), ('col_3', 'categorical'), ('col_4', 'categorical'), ('col_5', 'categorical'), ('col_6', 'numeric'), ('col_7', 'numeric')) v(source, sk))"""


@query("mapping_violations", f"""WITH {_MAP_SQL}, j AS (SELECT * FROM m LEFT JOIN fk USING (field) LEFT JOIN sk USING (source)),
  pf AS (SELECT mapping_id, field, bool_or(legacy) AS legacy, count(source) AS uses, any_value(fk) AS fk, count(*) FILTER (WHERE source IS NOT NULL AND sk IS NULL) AS us,
    count(*) FILTER (WHERE source IS NOT NULL AND sk IS NOT NULL AND fk IS NOT NULL AND sk <> fk) AS km,
    count(*) FILTER (WHERE field = 'event_time' AND coalesce(source, '') <> 'col_1') AS te FROM j GROUP BY 1, 2),
  main AS (SELECT mapping_id, CASE WHEN bool_or(legacy) THEN 0 ELSE 6 - count(fk) END AS missing_fields,
    CAST(sum(CASE WHEN legacy AND uses > 1 THEN uses - 1 ELSE 0 END) AS BIGINT) AS legacy_duplicates, count(*) FILTER (WHERE fk IS NULL) AS unknown_fields,
    CAST(sum(us) AS BIGINT) AS unknown_sources, CAST(sum(km) AS BIGINT) AS kind_mismatches,
    CAST(sum(te) + CASE WHEN count(*) FILTER (WHERE field = 'event_time') = 0 THEN 1 ELSE 0 END AS BIGINT) AS time_pair_errors FROM pf GROUP BY 1),
  fwd AS (SELECT DISTINCT mapping_id, source, field FROM m WHERE source IS NOT NULL),
  rd AS (SELECT mapping_id, count(*) AS n FROM ((SELECT * FROM fwd EXCEPT SELECT * FROM rev) UNION ALL (SELECT * FROM rev EXCEPT SELECT * FROM fwd)) GROUP BY 1),
  emp AS (SELECT mapping_id, field FROM pf WHERE uses = 0),
  ud AS (SELECT mapping_id, count(*) AS n FROM ((SELECT * FROM emp EXCEPT SELECT * FROM unf) UNION ALL (SELECT * FROM unf EXCEPT SELECT * FROM emp)) GROUP BY 1)
  SELECT main.*, coalesce(rd.n, 0) AS reverse_disagreements, coalesce(ud.n, 0) AS unfilled_disagreements FROM main LEFT JOIN rd USING (mapping_id) LEFT JOIN ud USING (mapping_id)""")
def _(spark, sf):
    m = _mappings(spark, sf)
    rev = m.where("l_returnflag <> 'A' AND source IS NOT NULL").select("mapping_id", "source", "field")
    unf = m.where("l_linestatus = 'O' AND source IS NULL").select("mapping_id", "field")
    catalogue = _catalogue(spark)
    return M.mapping_violations(m.select("mapping_id", "legacy", "field", "source"), rev, unf, catalogue, "event_time", "col_1")


def _catalogue(spark):
    kinds = [("field", f, "time" if f == "event_time" else "numeric" if f == "f5" else "categorical") for f in _FIELDS if f != "f6"]
    kinds += [("source", f"col_{i}", "time" if i == 1 else "numeric" if i in (6, 7) else "categorical") for i in range(1, 8)]
    return spark.createDataFrame(kinds, "side string, column string, kind string")


#: What the documents of ``mapping_json`` say: one source per field, or, in the legacy ones, one field per source.
_JSON_SQL = """d AS (SELECT mapping_id, legacy, field, max(source) AS source, bool_and(l_returnflag <> 'A') AS told, bool_and(l_linestatus = 'O') AS listed FROM m WHERE NOT legacy GROUP BY ALL
    UNION ALL SELECT mapping_id, legacy, max(field), source, true, true FROM m WHERE legacy AND source IS NOT NULL GROUP BY mapping_id, legacy, source),
  ids AS (SELECT DISTINCT mapping_id, legacy, CASE WHEN mapping_id % 13 = 7 THEN 'malformed' WHEN NOT legacy AND mapping_id % 11 = 5 THEN 'version' END AS odd FROM m),
  docs AS (SELECT ids.*, CASE WHEN odd IS NOT NULL THEN odd WHEN NOT EXISTS (FROM d WHERE d.mapping_id = ids.mapping_id) THEN 'no mapping' END AS problem FROM ids)"""


@query("mapping_json", f"""WITH {_MAP_SQL.replace('m AS (', 'm AS MATERIALIZED (', 1)}, {_JSON_SQL},
  ok AS (SELECT d.*, fk, sk FROM d JOIN docs USING (mapping_id) LEFT JOIN fk USING (field) LEFT JOIN sk USING (source) WHERE problem IS NULL),
  pf AS (SELECT mapping_id, field, legacy, count(source) AS uses, any_value(fk) AS fk, bool_or(told) AS told, bool_or(listed) AS listed,
    count(*) FILTER (WHERE source IS NOT NULL AND sk IS NULL) AS us, count(*) FILTER (WHERE sk <> fk) AS km,
    count(*) FILTER (WHERE field = 'event_time' AND coalesce(source, '') <> 'col_1') AS te FROM ok GROUP BY ALL),
  named AS (SELECT mapping_id, count(DISTINCT source) FILTER (WHERE source NOT IN (SELECT source FROM sk)) AS extra FROM ok WHERE told AND source IS NOT NULL GROUP BY 1),
  c AS (SELECT mapping_id, string_agg(field || '=' || coalesce((SELECT string_agg(source, '+' ORDER BY source) FROM ok WHERE ok.mapping_id = pf.mapping_id AND ok.field = pf.field), ''), ',' ORDER BY field) AS mapping,
    CAST(CASE WHEN bool_or(legacy) THEN 0 ELSE 6 - count(fk) END AS BIGINT) AS missing_fields, CAST(sum(CASE WHEN legacy AND uses > 1 THEN uses - 1 ELSE 0 END) AS BIGINT) AS legacy_duplicates,
    count(*) FILTER (WHERE fk IS NULL) AS unknown_fields, CAST(sum(us) AS BIGINT) AS unknown_sources, CAST(sum(km) AS BIGINT) AS kind_mismatches,
    CAST(sum(te) + CASE WHEN count(*) FILTER (WHERE field = 'event_time') = 0 THEN 1 ELSE 0 END AS BIGINT) AS time_pair_errors,
    count(*) FILTER (WHERE NOT legacy AND uses > 0 AND NOT told) AS reverse_disagreements,
    count(*) FILTER (WHERE NOT legacy AND uses = 0 AND NOT listed) AS unfilled_disagreements FROM pf GROUP BY 1)
  SELECT docs.mapping_id, docs.legacy AND docs.problem IS DISTINCT FROM 'malformed' OR docs.problem IS NOT DISTINCT FROM 'malformed' AS legacy, problem, c.* EXCLUDE (mapping_id),
    CASE WHEN problem IS NULL THEN CASE WHEN legacy THEN 0 ELSE coalesce(extra, 0) END END AS catalogue_disagreements
  FROM docs LEFT JOIN c USING (mapping_id) LEFT JOIN named USING (mapping_id)""")
def _(spark, sf):
    """Mappings written as JSON documents and read back: what they say, and what is wrong with them."""
    m = _mappings(spark, sf)
    new = m.where("NOT legacy").groupBy("mapping_id", "legacy", "field").agg(
        F.max("source").alias("source"), F.every(F.col("l_returnflag") != "A").alias("told"), F.every(F.col("l_linestatus") == "O").alias("listed"))
    old = m.where("legacy AND source IS NOT NULL").groupBy("mapping_id", "legacy", "source").agg(F.max("field").alias("field"))
    said = materialise(new.unionByName(old.select("mapping_id", "legacy", "field", "source", F.lit(True).alias("told"), F.lit(True).alias("listed"))))
    catalogue = _catalogue(spark)
    docs = J.encode_mappings(said.select("mapping_id", "legacy", "field", "source"), catalogue)
    # the declared reverse lists and unfilled fields miss what was not told
    told = said.where("NOT legacy").groupBy("mapping_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("source").isNotNull() & ~F.col("told"), F.struct(F.col("field"), F.col("source"))))).alias("_hide"),
        F.collect_list(F.when(F.col("source").isNull() & ~F.col("listed"), F.col("field"))).alias("_unlisted"))
    read = F.from_json("document", J.STANDARD.schema())
    cut = F.struct(
        read[J.STANDARD.version_key].alias(J.STANDARD.version_key), read[J.STANDARD.fields].alias(J.STANDARD.fields),
        F.map_filter(
            F.transform_values(read[J.STANDARD.sources], lambda s, l: F.filter(l, lambda f: ~F.coalesce(F.col("_hide")[f] == s, F.lit(False)))),
            lambda s, l: (F.size(l) > 0) | s.isin(*[f"col_{i}" for i in range(1, 8)])).alias(J.STANDARD.sources),
        F.array_except(read[J.STANDARD.unfilled], F.col("_unlisted")).alias(J.STANDARD.unfilled))
    docs = docs.join(told, "mapping_id", "left").withColumn("document", F.when(F.col("_hide").isNotNull(), F.to_json(cut)).otherwise(F.col("document")))
    empty = m.select("mapping_id", "legacy").distinct().join(said.select("mapping_id"), "mapping_id", "left_anti").select("mapping_id", F.lit('{"mapping":{}}').alias("document"))
    docs = docs.select("mapping_id", "document").unionByName(empty)
    text = F.when(F.pmod("mapping_id", F.lit(13)) == 7, F.expr("left(document, length(document) - 1)")).when(
        F.pmod("mapping_id", F.lit(11)) == 5, F.replace("document", F.lit(J.STANDARD.version), F.lit("other"))).otherwise(F.col("document"))
    docs = materialise(docs.select("mapping_id", text.alias("document")))
    decoded = J.decode_mappings(docs)
    checked = J.check_decoded(decoded, catalogue, "event_time", "col_1")
    rows = decoded.mappings.repartition("mapping_id").groupBy("mapping_id", "field").agg(F.array_join(F.array_sort(F.collect_list("source")), "+").alias("s"))
    shown = rows.groupBy("mapping_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "field", "s"))), ",").alias("mapping"))
    return checked.join(shown, "mapping_id", "left").drop("sha256")


def _recoveries(spark, sf):
    """Recovery rows: order lines by status and tax; the flags play truth and answer."""
    li = table(spark, sf, "lineitem")
    flag = F.col("l_returnflag")
    return li.select(
        F.col("l_linestatus").alias("condition"), F.col("l_tax").alias("alpha"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("target"),
        F.pmod("l_orderkey", F.lit(3)).alias("seed"),
        F.when(F.col("l_quantity") < 3, F.lit(None).cast("string")).when(F.col("l_quantity") > 45, M.PLACEHOLDER).otherwise(flag).alias("truth"),
        F.when(F.col("l_discount") > 0.08, F.lit(None).cast("string")).when(F.col("l_discount") > 0.06, "A").otherwise(flag).alias("recovered"),
    )


_REC_SQL = """rec AS (SELECT l_linestatus AS condition, l_tax AS alpha, 'f' || l_linenumber AS target, l_orderkey % 3 AS seed,
    CASE WHEN l_quantity < 3 THEN NULL WHEN l_quantity > 45 THEN '(placeholder)' ELSE l_returnflag END AS truth,
    CASE WHEN l_discount > 0.08 THEN NULL WHEN l_discount > 0.06 THEN 'A' ELSE l_returnflag END AS recovered FROM lineitem),
  met AS (SELECT condition, alpha, seed, count(*) FILTER (WHERE truth = recovered AND truth <> '(placeholder)') AS correct, count(recovered) AS accepted,
    count(*) FILTER (WHERE truth <> '(placeholder)') AS true_pairs, count(recovered) FILTER (WHERE truth <> '(placeholder)') AS covered,
    count(recovered) FILTER (WHERE truth = '(placeholder)') AS false_matches_on_negatives, count(*) FILTER (WHERE truth = '(placeholder)') AS known_negatives
    FROM rec WHERE truth IS NOT NULL GROUP BY ALL)"""


@query("recovery_metrics", f"""WITH {_REC_SQL} SELECT condition, alpha, seed, correct, accepted, true_pairs, round(correct / nullif(accepted, 0)::DOUBLE, 9) AS precision,
  round(correct / nullif(true_pairs, 0)::DOUBLE, 9) AS recall, round(covered / nullif(true_pairs, 0)::DOUBLE, 9) AS coverage, false_matches_on_negatives, known_negatives FROM met""")
def _(spark, sf):
    m = M.recovery_metrics(_recoveries(spark, sf), ["condition", "alpha", "seed"])
    return rounded(m, 9, "precision", "recall", "coverage")


def _sweep_runs(spark, sf):
    m = M.recovery_metrics(_recoveries(spark, sf), ["condition", "alpha", "seed"])
    return m.select("condition", "alpha", "seed", F.col("recall").alias("accuracy"), "coverage", (F.col("precision") > 0.85).alias("converged"))


_RUNS_SQL = f"""{_REC_SQL}, runs AS (SELECT condition, alpha, seed, correct / true_pairs::DOUBLE AS accuracy, covered / true_pairs::DOUBLE AS coverage,
  correct / accepted::DOUBLE > 0.85 AS converged FROM met)"""


@query("sweep_summary", f"""WITH {_RUNS_SQL} SELECT condition, alpha, count(*) AS runs, round(avg(accuracy), 9) AS accuracy_mean, round(stddev_samp(accuracy), 9) AS accuracy_sd,
  round(min(accuracy), 9) AS accuracy_min, round(max(accuracy), 9) AS accuracy_max, round(avg(coverage), 9) AS coverage_mean, round(1 - avg(coverage), 9) AS unfilled_rate_mean,
  count(*) FILTER (WHERE converged) AS converged_runs FROM runs GROUP BY 1, 2""")
def _(spark, sf):
    s = E.sweep_summary(_sweep_runs(spark, sf))
    return rounded(s, 9, *[c for c in s.columns if c.startswith(("accuracy", "coverage", "unfilled"))])


@query("gap_from_best", f"""WITH {_RUNS_SQL}, s AS (SELECT condition, alpha, avg(accuracy) AS m FROM runs GROUP BY 1, 2)
  SELECT condition, round(max(CASE WHEN alpha = 0.05 THEN m END), 9) AS accuracy_at_alpha, round(max(m), 9) AS best_mean_accuracy,
    round(max(m) - max(CASE WHEN alpha = 0.05 THEN m END), 9) AS gap_from_best, arg_max(alpha, (m, -alpha)) AS smallest_best_alpha FROM s GROUP BY 1""")
def _(spark, sf):
    g = E.gap_from_best(E.sweep_summary(_sweep_runs(spark, sf)), 0.05)
    return rounded(g, 9, "accuracy_at_alpha", "best_mean_accuracy", "gap_from_best")


@query("recovery_pivot", """WITH r AS (SELECT 'f' || l_linenumber AS target, l_tax AS alpha, CASE WHEN l_discount < 0.05 THEN 1.0::DOUBLE ELSE 0.0 END AS ok FROM lineitem)
  SELECT target, """ + ", ".join(f"round(avg(ok) FILTER (WHERE alpha = {a}), 9) AS \"a_{str(a).replace('.', '_')}\"" for a in (0.01, 0.02, 0.05, 0.08)) + " FROM r GROUP BY 1")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("target"), F.col("l_tax").alias("alpha"), (F.col("l_discount") < 0.05).alias("correct"))
    p = E.recovery_pivot(li, [0.01, 0.02, 0.05, 0.08])
    return rounded(p, 9, *p.columns[1:])


@query("status_crosstab", """SELECT o_orderpriority AS condition, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
  count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "condition")
    return E.status_crosstab(o, "condition", "o_orderstatus", ["F", "O", "P"])


@query("truth_diagnostics", DIST_SQL + f""", {_NEAREST}, {_SELECT}, tr AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{a}')" for c, a in ANON.items())}) v(target, truth))
  SELECT target, truth, sel.source AS recovered, coalesce(sel.source = truth, false) AS correct, d.allowed AS truth_allowed, round(d.distance, 8) AS truth_distance, status, candidate_count
  FROM tr JOIN sel USING (target) LEFT JOIN dist d ON d.source = truth AND d.target = tr.target""")
def _(spark, sf):
    d = materialise(distances(spark, sf).select(F.lit("folds").alias("case"), "*"))
    truth = d.sparkSession.createDataFrame([("folds", c, a) for c, a in ANON.items()], "case string, target string, truth string")
    t = M.truth_diagnostics(truth, M.match_by_passport(d, ["case"]), d, ["case"])
    return rounded(t.drop("case"), 8, "truth_distance")


# -- noise and sweep -------------------------------------------------------------------

_NOISE_SPECS = [ColumnSpec("event_type", "categorical"), ColumnSpec("o_orderpriority", "categorical"), ColumnSpec("o_totalprice", "numeric")]


def _noise_input(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.month("o_orderdate").cast("bigint")).alias("event_type"), "o_orderpriority",
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(0.0)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
    )


def _replace_sql(c: str, i: int, p: float, seed: int) -> str:
    k = "o_orderkey"
    return f"""{c}_v AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM o WHERE {c} IS NOT NULL)),
  {c}_p AS (SELECT {k}, v, CASE WHEN {sql_uniform(f'{seed}:{i}:mask', k)} < {p} THEN d + CASE WHEN d >= i THEN 1 ELSE 0 END END AS pick
    FROM (SELECT {k}, v, i, CAST(floor({sql_uniform(f'{seed}:{i}:pick', k)} * (n - 1)) AS BIGINT) AS d FROM o JOIN {c}_v ON CAST({c} AS VARCHAR) = v)),
  {c}_n AS (SELECT {k}, coalesce(w.v, p.v) AS {c} FROM {c}_p p LEFT JOIN {c}_v w ON w.i = pick)"""


@query("corrupt_ledger", f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN month(o_orderdate) END AS event_type, o_orderpriority,
    CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders),
  sc AS (SELECT quantile_cont(o_totalprice, 0.95) - quantile_cont(o_totalprice, 0.05) AS s FROM o),
  {_replace_sql('event_type', 0, 0.3, 9)}, {_replace_sql('o_orderpriority', 1, 0.3, 9)}
  SELECT o.o_orderkey, a.event_type, b.o_orderpriority, round(CASE WHEN o_totalprice = 0 THEN 0 ELSE o_totalprice + 0.3::DOUBLE * s *
    (sqrt(-2 * ln(1 - {sql_uniform('9:2:radius', 'o.o_orderkey')})) * cos(2 * pi() * {sql_uniform('9:2:angle', 'o.o_orderkey')})) END, 4) AS o_totalprice
  FROM o LEFT JOIN event_type_n a USING (o_orderkey) LEFT JOIN o_orderpriority_n b USING (o_orderkey), sc""")
def _(spark, sf):
    o = _noise_input(spark, sf)
    p = materialise(P.profile_columns(o, _NOISE_SPECS))
    noisy = N.corrupt(o, _NOISE_SPECS, p, 0.30, 0.30, 9, ["o_orderkey"])
    return noisy.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query("corruption_audit", f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN month(o_orderdate) END AS event_type, o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders)
  SELECT 'event_type' AS "column", count(*) AS n_rows, count(event_type) AS n_eligible, count(event_type) FILTER (WHERE {sql_uniform('9:0:mask', 'o_orderkey')} < 0.15) AS n_changed FROM o
  UNION ALL SELECT 'o_orderpriority', count(*), count(*), count(*) FILTER (WHERE {sql_uniform('9:1:mask', 'o_orderkey')} < 0.15) FROM o
  UNION ALL SELECT 'o_totalprice', count(*), count(*) FILTER (WHERE o_totalprice <> 0), count(*) FILTER (WHERE o_totalprice <> 0) FROM o""")
def _(spark, sf):
    o = _noise_input(spark, sf)
    p = materialise(P.profile_columns(o, _NOISE_SPECS))
    return N.corruption_audit(o, N.corrupt(o, _NOISE_SPECS, p, 0.15, 0.15, 9, ["o_orderkey"]), _NOISE_SPECS, ["o_orderkey"])


@query("corruption_report", f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN month(o_orderdate) END AS event_type, 'one' AS o_orderpriority,
    CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_totalprice END AS o_totalprice, CAST(o_orderkey % 2 AS DOUBLE) AS flag FROM orders),
  s AS (SELECT count(*) AS n, quantile_cont(o_totalprice, 0.95) - quantile_cont(o_totalprice, 0.05) AS w FROM o),
  r AS (SELECT 'event_type' AS "column", 'categorical' AS kind, count(event_type) AS n_valid, count(event_type) AS n_eligible,
      count(event_type) FILTER (WHERE {sql_uniform('4:0:mask', 'o_orderkey')} < 0.15) AS n_changed, NULL::DOUBLE AS scale, '' AS skip_reason FROM o
    UNION ALL SELECT 'o_orderpriority', 'categorical', count(*), 0, 0, NULL, 'fewer_than_two_categories' FROM o
    UNION ALL SELECT 'o_totalprice', 'numeric', count(*), count(*) FILTER (WHERE o_totalprice <> 0), count(*) FILTER (WHERE o_totalprice <> 0), (SELECT w FROM s), '' FROM o
    UNION ALL SELECT 'flag', 'numeric', count(*), count(*) FILTER (WHERE flag <> 0), 0, 1.0::DOUBLE, 'non_continuous_or_zero_scale' FROM o)
  SELECT "column", kind, 0.15::DOUBLE AS numeric_noise, 0.15::DOUBLE AS category_noise, n AS n_rows, n_valid, n_eligible, n_changed,
    round(CASE WHEN n_eligible = 0 THEN 0 ELSE n_changed / n_eligible::DOUBLE END, 9) AS changed_fraction, round(scale, 6) AS scale, skip_reason FROM r, s""")
def _(spark, sf):
    o = _noise_input(spark, sf).withColumn("o_orderpriority", F.lit("one")).withColumn("flag", F.pmod("o_orderkey", F.lit(2)).cast("double"))
    specs = [*_NOISE_SPECS, ColumnSpec("flag", "numeric")]
    p = materialise(P.profile_columns(o, specs))
    report = N.corruption_report(o, N.corrupt(o, specs, p, 0.15, 0.15, 4, ["o_orderkey"]), specs, p, ["o_orderkey"], 0.15, 0.15)
    return rounded(rounded(report, 9, "changed_fraction"), 6, "scale")


_KIND_SQL = f"""{_REC_SQL}, k AS (SELECT condition, alpha, seed, count(*) AS n_fields, count(*) FILTER (WHERE recovered IS NULL) AS unfilled,
    count(*) FILTER (WHERE target IN ('f2', 'f4')) AS truth_filtered, count(*) FILTER (WHERE target <= 'f4') AS categorical_fields,
    avg(CAST(coalesce(truth = recovered AND truth <> '(placeholder)', false) AS DOUBLE)) FILTER (WHERE target <= 'f4') AS categorical_accuracy,
    count(*) FILTER (WHERE target > 'f4') AS numeric_fields,
    avg(CAST(coalesce(truth = recovered AND truth <> '(placeholder)', false) AS DOUBLE)) FILTER (WHERE target > 'f4') AS numeric_accuracy
    FROM rec WHERE truth IS NOT NULL GROUP BY ALL),
  full_ AS (SELECT k.*, correct / nullif(true_pairs, 0)::DOUBLE AS accuracy, covered / nullif(true_pairs, 0)::DOUBLE AS coverage, met.correct, met.accepted,
    correct / nullif(accepted, 0)::DOUBLE > 0.85 AS converged FROM k JOIN met USING (condition, alpha, seed))"""


def _kinds_of_recovery(spark, sf):
    """The recoveries with the first four fields as categories, two of whose true pairs the filters rule out."""
    first = F.col("target") <= "f4"
    rows = _recoveries(spark, sf).withColumn("kind", F.when(first, "categorical").otherwise("numeric")).withColumn("truth_allowed", ~F.col("target").isin("f2", "f4"))
    return M.recovery_by_kind(rows, ["condition", "alpha", "seed"])


@query("recovery_by_kind", f"""WITH {_KIND_SQL} SELECT condition, alpha, seed, n_fields, correct, accepted, unfilled, truth_filtered, categorical_fields, round(categorical_accuracy, 9) AS categorical_accuracy,
  numeric_fields, round(numeric_accuracy, 9) AS numeric_accuracy, round(accuracy, 9) AS accuracy, round(coverage, 9) AS coverage, round(1 - coverage, 9) AS unfilled_rate FROM full_""")
def _(spark, sf):
    m = _kinds_of_recovery(spark, sf).drop("precision", "recall", "true_pairs", "false_matches_on_negatives", "known_negatives")
    return rounded(m, 9, "categorical_accuracy", "numeric_accuracy", "accuracy", "coverage", "unfilled_rate")


@query("sweep_report", f"""WITH {_KIND_SQL} SELECT condition, alpha, count(*) AS runs, round(avg(accuracy), 9) AS accuracy_mean, round(stddev_samp(accuracy), 9) AS accuracy_sd,
  round(avg(categorical_accuracy), 9) AS categorical_accuracy_mean, round(stddev_samp(categorical_accuracy), 9) AS categorical_accuracy_sd, round(avg(coverage), 9) AS coverage_mean,
  round(1 - avg(coverage), 9) AS unfilled_rate_mean, round(avg(truth_filtered), 9) AS truth_filtered_mean, count(*) FILTER (WHERE converged) AS converged_runs FROM full_ GROUP BY 1, 2""")
def _(spark, sf):
    runs = _kinds_of_recovery(spark, sf).withColumn("converged", F.col("precision") > 0.85)
    return rounded(W.sweep_report(runs), 9, "accuracy_mean", "accuracy_sd", "categorical_accuracy_mean", "categorical_accuracy_sd", "coverage_mean", "unfilled_rate_mean", "truth_filtered_mean")


@query("alpha_sweep")
def _(spark, sf):
    """Thirteen noisy anonymous copies of the ledger matched back to it with eleven mixing weights."""
    led = raw_ledger(spark, sf).select(*ANON, F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "event_subtype").alias("_key"))
    out = f"{scratch_dir(spark)}/ledgerflow-sweep-{uuid.uuid4().hex}"
    W.run_sweep(led, SPECS, ANON, ["_key"], out, W.sweep_cases(), settings={"input": sf})
    return W.sweep_runs(spark, out)
