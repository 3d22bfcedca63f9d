"""The noise sweep as a job that goes on where it stopped, and the corruption it rests on."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import noise as N
from ledgerflow.operators import profile as P
from ledgerflow.operators import sweep as W
from ledgerflow.schema import ColumnSpec
from ledgerflow.sources.readers import materialise

SPECS = [ColumnSpec("kind", "categorical"), ColumnSpec("code", "categorical"), ColumnSpec("one", "categorical"), ColumnSpec("value", "numeric"), ColumnSpec("size", "numeric")]
NAMES = {s.name: f"x{i}" for i, s in enumerate(SPECS)}


@pytest.fixture(scope="module")
def ledger(spark):
    rng = random.Random(1)
    rows = []
    for k in range(240):
        kind = rng.choices("abcd", [4, 3, 2, 1])[0]
        code = rng.choice([None, float("nan"), 1.0, 2.0, 3.0, 4.0, 5.0]) if k % 9 == 0 else float(ord(kind) % 3)
        rows.append((k, kind, code, "same", 0.0 if k % 11 == 0 else rng.lognormvariate(1, 1), float(rng.randint(1, 500))))
    return materialise(spark.createDataFrame(rows, "key long, kind string, code double, one string, value double, size double"))


@pytest.fixture(scope="module")
def passports(ledger):
    return materialise(P.profile_columns(ledger, SPECS))


def rows_of(df):
    return {r["key"]: r.asDict() for r in df.collect()}


def test_arrays_and_joins_draw_the_same(ledger, passports, monkeypatch):
    want = rows_of(N.corrupt(ledger, SPECS, passports, 0.3, 0.3, 4, ["key"]))
    monkeypatch.setattr(N, "ARRAY_VALUES", 2)
    assert rows_of(N.corrupt(ledger, SPECS, passports, 0.3, 0.3, 4, ["key"])) == want


def test_masks_are_nested_and_clean_is_the_identity(ledger, passports):
    cases = [("no", 0.0, 0.0, 4), ("low", 0.15, 0.15, 4), ("high", 0.3, 0.3, 4)]
    wide = N.corrupt_cases(ledger, SPECS, passports, cases, ["key"], ["key"])
    clean, got = rows_of(ledger), rows_of(wide)
    changed = {n: {(k, s.name) for k, r in got.items() for s in SPECS if s.kind == "categorical" and r[f"{n}|{s.name}"] != r[f"no|{s.name}"]} for n, *_ in cases}
    assert changed["low"] and changed["low"] < changed["high"] and all(c != "one" for _, c in changed["high"])
    for k, r in got.items():
        assert r["no|kind"] == clean[k]["kind"] and r["no|value"] == clean[k]["value"]
        code = clean[k]["code"]
        assert r["no|code"] == (None if code is None or math.isnan(code) else str(code))
        assert r["high|value"] - r["no|value"] == pytest.approx(2 * (r["low|value"] - r["no|value"]))
        assert all(r[f"high|{c}"] == r[f"low|{c}"] for c in ("kind", "code") if (k, c) in changed["low"])
    plan = N.corrupt(ledger, SPECS, passports, 0.0, 0.0, 4, ["key"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_overflow_raises_and_report_says_why_columns_stay(ledger, passports):
    with pytest.raises(Exception, match="overflows in value"):
        N.corrupt(ledger, SPECS, passports, 1e308, 0.0, 4, ["key"]).collect()
    noisy = N.corrupt(ledger, SPECS, passports, 0.0, 0.5, 4, ["key"])
    rows = {r["column"]: r for r in N.corruption_report(ledger, noisy, SPECS, passports, ["key"], 0.0, 0.5).collect()}
    assert rows["one"]["skip_reason"] == "fewer_than_two_categories" and rows["one"]["n_eligible"] == 0 and rows["one"]["changed_fraction"] == 0
    assert rows["kind"]["skip_reason"] == "" and rows["kind"]["changed_fraction"] == rows["kind"]["n_changed"] / 240 > 0.3
    assert rows["value"]["n_changed"] == 0 and rows["value"]["scale"] > 0


def test_sweep_goes_on_where_it_stopped(spark, ledger, tmp_path, monkeypatch):
    cases, alphas = W.sweep_cases(["clean", "mixed_030"], [1]), [0.0, 0.5]
    run = lambda **more: W.run_sweep(ledger, SPECS, NAMES, ["key"], f"file://{tmp_path}/sweep", cases, alphas, n_init=2, **more)
    monkeypatch.setattr(W, "CASES_A_PART", 1)
    some = run(most_parts=1)
    assert {tuple(r) for r in some.select("case", "alpha").distinct().collect()} == {("clean/0", 0.0), ("clean/0", 0.5)}
    # a part that was written but not entered in the ledger is not read
    some.limit(1).withColumn("alpha", F.lit(0.9)).withColumn("part", F.lit("lost")).write.mode("append").parquet(f"{tmp_path}/sweep/recovery")
    profiled = []
    whole = W.case_problems
    monkeypatch.setattr(W, "case_problems", lambda *a: profiled.append(a[-1]) or whole(*a))
    done = run()
    assert not profiled  # the problems of all cases were kept
    assert {tuple(r) for r in done.select("case", "alpha").distinct().collect()} == {(c[0], a) for c in cases for a in alphas}
    assert done.count() == len(SPECS) * 4
    monkeypatch.setattr(W, "_run_part", lambda *a: pytest.fail("a finished run starts nothing"))
    run()
    runs = W.sweep_runs(spark, f"{tmp_path}/sweep")
    clean = runs.where("condition = 'clean'").collect()
    assert len(clean) == 2 and all(r["n_fields"] == 5 and r["optimizer_starts"] == 2 for r in clean)
    report = W.sweep_report(runs).collect()
    assert len(report) == 4 and all(0 <= r["accuracy_mean"] <= 1 for r in report)
    with pytest.raises(ValueError, match="other settings"):
        run(settings={"sample": 2})


def test_full_grid():
    cases = W.sweep_cases()
    assert len(cases) == 13 and len(cases) * len(W.ALPHAS) == 143 and len({c[0] for c in cases}) == 13


def test_pairs_are_counted_densely(spark):
    rng = random.Random(3)
    rows = [tuple(rng.choice([None, 0, 1, 2, 63]) for _ in range(3)) for _ in range(500)] + [(0, 200, None)]
    codes = spark.createDataFrame(rows, "a int, b int, c int").repartition(5)
    want = {}
    for r in rows:
        for i, j in ((0, 1), (0, 2), (1, 2)):
            if r[i] is not None and r[j] is not None:
                k = ("abc"[i], "abc"[j], r[i], r[j])
                want[k] = want.get(k, 0) + 1
    got = {tuple(r)[:4]: r["n"] for r in P.pair_counts(codes, ["a", "b", "c"]).collect()}
    assert got == want
    assert {tuple(r)[:4]: r["n"] for r in P.pair_counts(codes, ["a", "b", "c"], [("c", "a")]).collect()} == {("c", "a", v, u): n for (x, y, u, v), n in want.items() if (x, y) == ("a", "c")}
    assert P.pair_counts(codes.limit(0), ["a", "b"]).count() == 0


def test_matching_source_agrees_with_whole_passports(spark, ledger, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_BYTES", 1)  # every batch is counted on its own
    df = materialise(ledger.withColumn("two", F.when(F.col("key") % 3 == 0, 2.5).when(F.col("key") % 3 == 1, -1.0)).withColumn("none", F.lit(None).cast("double")))
    specs = [*SPECS, ColumnSpec("two", "numeric"), ColumnSpec("none", "numeric")]
    whole, got = P.profile_source(df, specs), P.matching_source(df, specs)
    fields = ["kind", "n_rows", "n_valid", "null_share", "entropy_norm", "top1_share", "zero_share", "quantile_scale", "quantile_shape", "numeric_subtype"]
    want = {r["column"]: r for r in whole[0].collect()}
    for r in got[0].collect():
        for f in fields:
            w = want[r["column"]][f]
            assert r[f] == (pytest.approx(w) if isinstance(w, (float, list)) else w), (r["column"], f)
        assert r["n_unique"] == (min(3, want[r["column"]]["n_unique"]) if r["kind"] == "numeric" else want[r["column"]]["n_unique"])
    cells = [{(r["left"], r["right"]): (r["n_pairs"], r["usable"], pytest.approx(r["distance"])) for r in m.collect()} for m in (whole[1], got[1])]
    assert cells[0] == cells[1] and len(cells[0]) == 21
    # no row is multiplied by the number of columns
    assert "Generate" not in P.category_counts(df, SPECS)._jdf.queryExecution().optimizedPlan().toString()


def test_cases_share_equal_columns(ledger, passports):
    cases = W.sweep_cases()
    wide, own = N.corrupt_variants(ledger, SPECS, passports, cases, ["key"], ["key"])
    assert len(own) == 13 * len(SPECS) and len(wide.columns) == 1 + 7 * len(SPECS)
    assert own["mixed_015/1", "kind"] == own["categorical_015/1", "kind"] != own["mixed_030/1", "kind"]
    got = rows_of(wide)
    for name, lam, p, seed in cases[:5]:
        alone = rows_of(N.corrupt(ledger, SPECS, passports, lam, p, seed, ["key"]))
        assert all(got[k][own[name, s.name]] == alone[k][s.name] for k in got for s in SPECS if s.name != "code")
