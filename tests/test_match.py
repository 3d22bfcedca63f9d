"""Passports, structure, matching, noise."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import match as M
from ledgerflow.operators import noise as N
from ledgerflow.operators import profile as P
from ledgerflow.schema import ColumnSpec
from ledgerflow.sources.readers import materialise


@pytest.fixture(scope="module")
def ledger(spark):
    rng = np.random.default_rng(3)
    n = 600
    base = rng.integers(0, 6, n)
    f = pd.DataFrame({"key": range(n), "amount": rng.lognormal(2, 1, n)})
    f.loc[::11, "amount"] = 0.0
    for k in range(2, 7):
        p = np.arange(1, k + 1) / sum(range(1, k + 1))
        draw = rng.choice(k, n, p=p)
        f[f"c{k}"] = np.where(rng.random(n) < 0.5, draw, base % k)
    return f, materialise(spark.createDataFrame(f))


SPECS = [ColumnSpec("amount", "numeric")] + [ColumnSpec(f"c{k}", "categorical") for k in range(2, 7)]


def test_passports_on_odd_values(spark):
    df = spark.createDataFrame(
        [(0.0, "a", 1.0), (float("nan"), None, 1.0), (float("inf"), "b", 1.0), (None, "b", 1.0), (4.0, "b", 1.0)], "v double, c string, k double"
    )
    specs = [ColumnSpec("v", "numeric"), ColumnSpec("c", "categorical"), ColumnSpec("k", "numeric")]
    p = {r.column: r for r in P.profile_columns(df, specs).collect()}
    assert (p["v"].n_valid, p["v"].n_unique, p["v"].numeric_subtype, p["v"].zero_share) == (2, 2, "binary", 0.5)
    assert (p["c"].n_valid, p["c"].top1_share) == (4, 0.75)
    assert (p["k"].numeric_subtype, p["k"].quantile_fallback, set(p["k"].quantile_shape)) == ("constant", "constant", {0.0})
    approx = {r.column: r.n_unique for r in P.base_profile_approx(df, specs).collect()}
    assert approx == {"v": 2, "c": 2, "k": 1}


def test_tied_boundary_is_pooled(spark):
    rows = [(c,) for c in "aaaabbbccddee"]
    codes = P.structure_codes(spark.createDataFrame(rows, "c string"), [ColumnSpec("c", "categorical")], max_categories=4)
    got = sorted(r["count"] for r in codes.groupBy("c").count().collect())
    assert got == [3, 4, 6]  # c, d and e tie at the cut and share one code


def test_dependency_matches_brute_force(ledger):
    f, df = ledger
    got = {(r.left, r.right): r for r in P.dependency_matrix(df, SPECS, bins=5).collect()}
    edges = np.unique(np.quantile(f.amount, np.linspace(0, 1, 6)))[1:-1]
    code = f.assign(amount=np.searchsorted(edges, f.amount, side="right"))

    def entropy(c):
        p = c.value_counts(normalize=True).to_numpy()
        return -(p * np.log(p)).sum()

    for (a, b), r in got.items():
        joint = entropy(pd.Series(list(zip(code[a], code[b]))))
        ha, hb = entropy(code[a]), entropy(code[b])
        assert np.isclose(r.nmi, 2 * (ha + hb - joint) / (ha + hb)) and r.n_pairs == len(f)


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=300), 1)
    f = pd.DataFrame({"x": x, "y": np.round(x + rng.normal(size=300), 1)})
    r = P.spearman(spark.createDataFrame(f), [("x", "y")]).first()
    assert np.isclose(r.rho, f.x.rank().corr(f.y.rank()))


def test_passport_distance_worked_example(spark):
    schema = "column string, kind string, n_valid bigint, n_unique bigint, null_share double, entropy_norm double, top1_share double, numeric_subtype string, zero_share double, quantile_shape array<double>"
    a = spark.createDataFrame([("x", "categorical", 100, 10, 0.0, 0.5, 0.40, None, None, None)], schema)
    # du = .2 * .75 decades, dh = .1, dtop1 = .05
    b = spark.createDataFrame([("y", "categorical", 100, round(10 ** 1.15), 0.0, 0.6, 0.45, None, None, None), ("z", "numeric", 100, 5, 0.0, None, None, "continuous", 0.0, [0.0] * 21), ("w", "categorical", 100, 200, 0.0, 0.6, 0.45, None, None, None), ("e", "categorical", 0, 0, 1.0, None, None, None, None, None)], schema)
    d = {r.target: r for r in M.passport_distance(a, b).collect()}
    du = abs(np.log10(10) - np.log10(round(10**1.15))) / 0.75
    assert np.isclose(d["y"].distance, 0.35 * du + 0.03 + 0.01) and d["y"].allowed
    assert (d["z"].reason, d["w"].reason, d["e"].reason) == ("different_kinds", "cardinality_gate", "no_valid_values")


def long(spark, m, names):
    rows = [(a, b, float(m[i][j])) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
    return spark.createDataFrame(rows, "i string, j string, c double")


def test_objective_worked_example(spark):
    d = spark.createDataFrame([("x1", "y1", 0.10), ("x1", "y2", 0.15), ("x2", "y1", 0.80), ("x2", "y2", 0.20)], "source string, target string, distance double")
    cx, cy = long(spark, [[0, 1], [1, 0]], ["x1", "x2"]), long(spark, [[0, 1], [1, 0]], ["y1", "y2"])
    for cells, want in (([("x1", "y1"), ("x1", "y2")], 0.3125), ([("x1", "y1"), ("x2", "y2")], 0.075)):
        plan = spark.createDataFrame([(*c, 0.5) for c in cells], "source string, target string, mass double")
        assert np.isclose(M.fgw_objective(plan, d, cx, cy, 0.5).first().objective, want)
    case = F.lit("t").alias("case")
    pairs = d.withColumn("allowed", F.lit(True)).select(case, "*")
    solved = M.solve_plans(M.match_problems(pairs, cx.select(case, "*"), cy.select(case, "*")), [0.0, 0.5]).collect()
    by = {r.alpha: r for r in solved}
    assert np.isclose(by[0.5].objective, 0.075) and by[0.5].converged and by[0.5].gap <= 1e-9
    assert np.isclose(by[0.0].objective, 0.125)


def test_solver_agrees_with_objective_and_handles_no_candidates(spark, ledger):
    f, df = ledger
    anon = {s.name: f"a{i}" for i, s in enumerate(SPECS)}
    a = df.select(*[F.col(c).alias(n) for c, n in anon.items()])
    (pa, ca), (pb, cb) = P.profile_source(a, [ColumnSpec(anon[s.name], s.kind) for s in SPECS]), P.profile_source(df, SPECS)
    case = F.lit("t").alias("case")
    d = materialise(M.passport_distance(pa, pb).select(case, "*"))
    cx, cy = materialise(M.symmetric(ca)), materialise(M.symmetric(cb))
    problems = M.match_problems(d, cx.select(case, "*"), cy.select(case, "*"))
    solved = materialise(M.solve_plans(problems, [0.0, 0.5, 1.0], n_init=3))
    plan = solved.where("alpha = 0.5").select(F.inline("plan"))
    o = M.fgw_objective(plan, d, cx, cy, 0.5).first()
    r = solved.where("alpha = 0.5").first()
    assert np.isclose(o.objective, r.objective) and np.isclose(o.structure_loss, r.structure_loss) and r.converged
    picked = {x.target: x.source for x in M.match_columns(d, solved).where("alpha = 0.5").collect()}
    assert picked == anon
    none = M.match_problems(d.withColumn("allowed", F.lit(False)), cx.select(case, "*"), cy.select(case, "*"))
    empty = M.solve_plans(none, [0.5], n_init=2).first()
    assert empty.objective is None and not empty.converged and empty.plan == []


@pytest.mark.parametrize("seed", range(6))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(1, 5)), int(rng.integers(1, 5))
    u = np.where(rng.random((n, m)) < 0.3, 0.0, np.round(rng.random((n, m)), 2))
    got = M._best_assignment(u)
    used = [j for j in got if j >= 0]
    assert len(used) == len(set(used))
    best = 0.0
    for cols in itertools.permutations([*range(m), *[-1] * n], n):
        best = max(best, sum(u[i, j] for i, j in enumerate(cols) if j >= 0))
    assert np.isclose(sum(u[i, j] for i, j in enumerate(got) if j >= 0), best)


def test_assignment_prefers_the_total_and_reports_gaps(spark):
    rows = [("p", "col_3", "event_subtype", 0.80), ("p", "col_3", "currency", 0.79), ("p", "col_4", "event_subtype", 0.78), ("p", "col_4", "currency", 0.10)]
    pairs = spark.createDataFrame(rows, "pair string, source string, target string, similarity double")
    got = {(r.source, r.target) for r in M.assign_one_to_one(pairs, ["pair"]).collect()}
    assert got == {("col_3", "currency"), ("col_4", "event_subtype")}
    gaps = {r.source: r for r in M.assignment_gaps(pairs, ["pair"]).collect()}
    assert np.isclose(gaps["col_3"].assignment_gap, 1.57 - 0.80) and gaps["col_3"].status == "SEPARATED"


def test_recovery_counts(spark):
    rows = [("r", "a", "t1", "t1"), ("r", "b", "t2", None)]
    m = M.recovery_metrics(spark.createDataFrame(rows, "run string, target string, truth string, recovered string"), ["run"]).first()
    assert (m.recall, m.precision, m.coverage, m.known_negatives) == (0.5, 1.0, 0.5, 0)


def test_noise_is_nested_scaled_and_leaves_gaps_alone(spark):
    v = [0.0, float("nan"), float("inf"), float("-inf"), *np.linspace(-20, 30, 496)]
    f = pd.DataFrame({"key": range(500), "amount": v, "cat": [("a", "b", "c", None)[i % 4] for i in range(500)], "flat": 1.0})
    df = spark.createDataFrame(f, "key bigint, amount double, cat string, flat double")
    specs = [ColumnSpec("amount", "numeric"), ColumnSpec("cat", "categorical"), ColumnSpec("flat", "numeric")]
    p = materialise(P.profile_columns(df, specs))
    low, high = (N.corrupt(df, specs, p, s, s, 5, ["key"]).toPandas().sort_values("key").reset_index(drop=True) for s in (0.15, 0.30))
    same = N.corrupt(df, specs, p, 0.0, 0.0, 5, ["key"]).toPandas().sort_values("key").reset_index(drop=True)
    assert np.array_equal(same.amount, f.amount, equal_nan=True) and (same.cat.fillna("-") == f.cat.fillna("-")).all()
    odd = ~np.isfinite(f.amount) | (f.amount == 0)
    assert np.array_equal(low.amount[odd], f.amount[odd], equal_nan=True) and (low.flat == 1.0).all()
    shift = (low.amount - f.amount)[~odd]
    assert np.allclose((high.amount - f.amount)[~odd], 2 * shift) and abs(shift.mean()) < 1.5
    a, b = (low.cat.fillna("-") != f.cat.fillna("-")), (high.cat.fillna("-") != f.cat.fillna("-"))
    assert (a <= b).all() and 0.08 < a[f.cat.notna()].mean() < 0.24 and not a[f.cat.isna()].any()
    assert set(high.cat.dropna()) == {"a", "b", "c"}
    assert (low.cat[a] == high.cat[a]).all()
    with pytest.raises(ValueError):
        N.corrupt(df, specs, p, 0.1, 1.5, 5, ["key"])


def test_testbeds_profile_each_table_once(spark, monkeypatch):
    from ledgerflow.operators import profile
    from ledgerflow.plans import match_queries as Q

    seen = []
    monkeypatch.setattr(profile, "matching_source", lambda df, specs: seen.append([s.name for s in specs]) or (df, df))
    made = Q.testbed_sources(spark, "/root/testdata/sf0.001")
    assert len(seen) == len(made) == 4 and all(len(c) == 8 for c in seen)
    rows = {k: v[0].count() for k, v in made.items()}
    assert rows["a", "raw"] >= rows["a", "daily"] > 0 and rows["b", "raw"] >= rows["b", "daily"] > 0


def test_mapping_violations_in_one_exchange(spark, monkeypatch):
    catalogue = spark.createDataFrame([("field", "f", "numeric"), ("field", "t", "time"), ("source", "x", "numeric"), ("source", "c", "time")], "side string, column string, kind string")
    rows = [(k, False, *p) for k in range(40) for p in (("f", "x"), ("t", "c"))] + [(40, False, "f", "zz"), (40, False, "t", None), (41, True, "f", "x"), (41, True, "f", "c")]
    said = spark.createDataFrame(rows, "mapping_id long, legacy boolean, field string, source string")
    reverse = spark.createDataFrame([(k, s, f) for k, _, f, s in rows if s and k != 3] + [(41, None, "f"), (99, "x", "f")], "mapping_id long, source string, field string")
    unfilled = spark.createDataFrame([(40, "t"), (5, "t"), (98, "t")], "mapping_id long, field string")
    monkeypatch.setattr(M, "TASK_ROWS", 4)
    v = M.mapping_violations(said, reverse, unfilled, catalogue, "t", "c")
    assert v.rdd.getNumPartitions() == 21  # follows the rows
    got = {r["mapping_id"]: tuple(r)[1:] for r in v.collect()}
    assert set(got) == set(range(42))
    assert got[3] == (0, 0, 0, 0, 0, 0, 2, 0) and got[5] == (0, 0, 0, 0, 0, 0, 0, 1)
    assert got[40] == (0, 0, 0, 1, 0, 1, 0, 0) and got[41] == (0, 1, 0, 0, 1, 1, 1, 0)
    assert all(got[k] == (0,) * 8 for k in range(40) if k not in (3, 5))
