"""Targets, splits, metrics, panels and probes."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import embed as B
from ledgerflow.operators import metrics as E
from ledgerflow.operators import panel as D
from ledgerflow.operators import targets as T

KEYS = ["id", "date"]


def test_duplicate_and_conflicting_targets(spark):
    d = date(2024, 1, 1)
    rows = [("a", d, 0, 1, 0, 1), ("a", d, 1, 1, 0, 1), ("b", d, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "id string, date date, col_2 int, col_3 int, col_4 int, col_5 int")
    assert T.clean_targets(df, KEYS, ["col_3", "col_4", "col_5"]).count() == 2
    with pytest.raises(ValueError, match="contradict each other"):
        T.clean_targets(df, KEYS, ["col_2"])
    with pytest.raises(ValueError, match="other than 0 and 1"):
        T.clean_targets(df.withColumn("col_3", F.lit(2)), KEYS, ["col_3"])
    with pytest.raises(ValueError, match="lack a key or a label"):
        T.clean_targets(df.withColumn("col_3", F.lit(None).cast("int")), KEYS, ["col_3"])


def test_rows_of_a_key_whose_label_is_always_missing_collapse(spark):
    d = date(2024, 1, 1)
    rows = [("a", d, None, 0), ("a", d, None, 0), ("b", d, None, 0), ("b", d, None, 1), ("c", d, 1, 1)]
    got = T.target_issues(spark.createDataFrame(rows, "id string, date date, y1 int, y2 int"), KEYS, ["y1", "y2"]).first()
    assert got.asDict() == {"n_rows": 5, "null_rows": 4, "non_binary_rows": 0, "collapsed_rows": 1, "conflicting_keys": 1}


def test_fold_roles(spark):
    df = spark.range(5).select(F.col("id").cast("int").alias("fold"))
    roles = {t: {r.fold: r.role for r in T.fold_roles(df, t).collect()} for t in (0, 4)}
    assert roles[4] == {0: "train", 1: "train", 2: "train", 3: "val", 4: "test"}
    assert roles[0] == {0: "test", 1: "train", 2: "train", 3: "train", 4: "val"}
    with pytest.raises(ValueError):
        T.fold_roles(df, 5)
    assert T.rotate_folds(df).where("role = 'test'").count() == 5
    with pytest.raises(ValueError):
        T.calendar_split(df, ["2024-02-01"], ["2024-01-01"])


def test_group_split_keeps_clients_whole(spark):
    df = spark.range(200).select((F.col("id") % 20).alias("c"), "id")
    s = T.group_split(df, "c", 0.25, 3)
    assert s.select("c", "valid").distinct().count() == 20 and s.where("valid").select("c").distinct().count() == 5


def test_undersample_keeps_positives(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    out = T.undersample(df, "y", 2.0, 1, ["id"]).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in out} == {0: 200, 1: 100}
    assert T.undersample(df, "y", 50.0, 1, ["id"]).count() == 1000


def scored(spark, y, s):
    return spark.createDataFrame([(i, int(a), float(b), "m") for i, (a, b) in enumerate(zip(y, s))], "id int, y int, score double, model string")


def test_threshold_and_top_metrics(spark):
    df = scored(spark, [1, 0, 1] + [0] * 7, [0.9, 0.8, 0.7] + [0.1] * 7)
    at = E.precision_recall_at(df, "y", "score", ["model"]).first()
    assert np.isclose(at.precision, 2 / 3) and at.recall == 1.0
    top = E.precision_recall_at_k(df, "y", "score", ["model"], ["id"], [0.10]).first()
    assert (top.k, top.precision, top.recall) == (1, 1.0, 0.5)
    perfect = E.ranking_metrics(scored(spark, [0, 1, 0, 1], [0.1, 0.9, 0.2, 0.8]), "y", "score", []).first()
    assert perfect.roc_auc == perfect.pr_auc == 1.0


def test_metrics_match_brute_force_with_ties(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 1)
    r = E.ranking_metrics(scored(spark, y, s), "y", "score", ["model"]).first()
    p, n = s[y == 1], s[y == 0]
    assert np.isclose(r.roc_auc, ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n)))
    ap, seen = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        recall = (y[s >= t] == 1).sum() / y.sum()
        ap += (recall - seen) * (y[s >= t] == 1).mean()
        seen = recall
    assert np.isclose(r.pr_auc, ap)


def test_one_class_is_reported_or_raised(spark):
    df = scored(spark, [1, 1], [0.1, 0.2])
    r = E.ranking_metrics(df, "y", "score", ["model"]).first()
    assert r.roc_auc is None and r.status == "ONE_CLASS"
    with pytest.raises(Exception, match="only one class"):
        E.ranking_metrics(df, "y", "score", ["model"], strict=True).collect()


def test_fold_summary_and_pairs(spark):
    rows = [("m", f"t{t}", k, 10, 0.5, 0.2 + 0.01 * k, 0.6 + 0.01 * k, "h") for t in range(4) for k in range(5)]
    df = spark.createDataFrame(rows, "model string, target string, test_fold int, n_rows bigint, prevalence double, pr_auc double, roc_auc double, cohort string")
    s = E.require_folds(E.summarise_folds(df))
    assert all(np.isclose(r.roc_auc_mean, 0.62) for r in s.collect()) and np.isclose(E.macro(s).first()[1], 0.62)
    one = df.where("test_fold = 0")
    new = one.withColumn("pr_auc", F.col("pr_auc") + 0.01)
    assert np.isclose(E.compare_runs(one, new, strict=True).first().delta_pr_auc, 0.01)
    with pytest.raises(ValueError, match="cohorts differ"):
        E.compare_runs(one, new.withColumn("cohort", F.lit("other")), strict=True)
    with pytest.raises(ValueError, match="settings"):
        E.require_same_settings(df.withColumn("settings", F.col("test_fold").cast("string")), ["model"])


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id string, date date, emb array<float>")


def test_panel_validity_and_joins(spark):
    d = date(2024, 1, 1)
    ok = vectors(spark, [("a", d, [1.0, 2.0]), ("b", d, [3.0, 4.0])])
    assert D.validate_panel(ok, "id", "date", "emb") is ok
    for rows, what in (
        ([("a", d, [1.0, 2.0]), ("a", d, [1.0, 2.0])], "duplicate"), ([("a", d, [1.0, float("nan")])], "NaN"),
        ([("a", d, [1.0]), ("b", d, [1.0, 2.0])], "length"), ([(None, d, [1.0])], "missing"),
    ):
        with pytest.raises(ValueError, match=what):
            D.validate_panel(vectors(spark, rows), "id", "date", "emb")
    targets = spark.createDataFrame([("a", d, 1), ("c", d, 0)], "id string, date date, y int")
    assert [r.id for r in D.join_panel(targets, ok, KEYS).collect()] == ["a"]
    with pytest.raises(Exception, match="repeat a key"):
        D.join_panel(targets.unionByName(targets), ok, KEYS).collect()
    with pytest.raises(Exception, match="no finite vector"):
        D.features_for(targets, ok, KEYS, "emb").collect()


def test_paired_cohort_counts(spark):
    rows = [(f"c{c}", date(2024, m, 1)) for c in range(10) for m in range(1, 5)]
    keys = spark.createDataFrame(rows, "id string, date date")
    b = keys.where("NOT (id = 'c0' AND date = DATE '2024-02-01')")
    cohort = D.paired_cohort(keys, [keys.orderBy(F.desc("id")), b], KEYS)
    split = T.calendar_split(cohort, ["2024-01-01", "2024-03-01"], ["2024-04-01"], "date")
    assert cohort.count() == 39 and split.where("role = 'train'").count() == 20


def test_standardiser_ignores_held_out_rows(spark):
    d = date(2024, 1, 1)
    s = {r.dim: r for r in D.fit_standardiser(vectors(spark, [("a", d, [1.0, 7.0]), ("b", d, [3.0, 7.0])]), "emb").collect()}
    assert (s[0].center, s[1].center) == (2.0, 7.0) and np.allclose([s[0].scale, s[1].scale], [1.0, 1e-6])


def test_psi_of_the_same_data_is_zero(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 2))
    rows = [(str(i), date(2024, m, 1), [float(x) for x in (v[i] + [0, shift])]) for m, shift in ((1, 0), (2, 0), (3, 5)) for i in range(200)]
    dims = D.psi_by_dimension(vectors(spark, rows), "date", "emb")
    got = {(r.date.month, r.dim): r.psi for r in dims.collect()}
    assert abs(got[2, 0]) < 1e-9 and abs(got[2, 1]) < 1e-9 and abs(got[3, 0]) < 1e-9 and got[3, 1] > 1
    worst = D.psi_worst(dims, "date", k=1).collect()
    assert [(r.date.month, r.dim) for r in worst] == [(3, 1)]


def test_encoder_contract(spark):
    d = date(2024, 1, 1)
    df = spark.createDataFrame([("a", d, [1.0, 2.0]), ("b", d, [3.0])], "id string, date date, series array<float>")
    out = B.embed_series(df, KEYS, lambda f: np.array([[len(v), sum(v)] for v in f["series"]]), 2).collect()
    assert {r.id: list(r.emb) for r in out} == {"a": [2.0, 3.0], "b": [1.0, 3.0]}
    with pytest.raises(Exception, match="NaN or infinite"):
        B.embed_series(df, KEYS, lambda f: np.full((len(f), 2), np.nan), 2).collect()


def test_probes_beat_chance(spark):
    from ledgerflow.operators import probe as X

    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    v = rng.normal(size=(300, 3)) + y[:, None] * [1.5, 0, 0]
    rows = [(str(i), date(2024, 1, 1), [float(x) for x in v[i]], int(y[i]), i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, date date, emb array<float>, y int, fold int")
    panel = T.fold_roles(df, 4)
    metrics, trials, chosen = X.tune_and_test(
        panel, "y", "emb", "id", KEYS, [X.TreeParams(2, 2, 0.1, 1.0, 4), X.TreeParams(3, 2, 0.2, 1.0, 4)], 100
    )
    m = metrics.first()
    assert m.roc_auc > 0.7 and m.status == "OK" and trials.count() == 2 and 1 <= chosen.rounds <= 4
    model, fitted = X.fit_mlp_probe(panel.where("role = 'train'"), "y", "emb", 3, X.MlpParams(hidden=4, rounds=30))
    test = D.standardise(panel.where("role = 'test'"), fitted, "emb", X.CLIP)
    assert X.test_metrics(X.score_with(model, test, "emb"), "y", KEYS).first().roc_auc > 0.7


def test_shift_of_missing_months(spark):
    t = spark.createDataFrame([(date(2023, 10, 1),), (date(2024, 1, 1),)], "month date")
    m = spark.createDataFrame([(date(2023, 10 + i, 1),) for i in range(3)], "month date")
    assert sorted(r.month.month for r in T.missing_months(t, m).collect()) == [11, 12]


def test_stat_features_shape(spark):
    from ledgerflow.schema import EventSchema

    s = EventSchema("id", "t", ("c",), ("v",))
    rows = [("a", date(2024, 1, 1), 1, 2.0, date(2024, 2, 1)), ("a", date(2024, 1, 31), 1, 4.0, date(2024, 2, 1)), ("a", date(2024, 1, 31), None, 6.0, date(2024, 2, 1))]
    r = B.stat_features(spark.createDataFrame(rows, "id string, t date, c bigint, v double, target_date date"), s).first()
    assert (r.n_events, r.recency_days, r.span_days, r.v_sum, r.c_distinct) == (3, 1, 31, 12.0, 1) and np.isclose(r.c_top_share, 2 / 3)


def test_ragged_encoder_and_resumable_panel(spark, tmp_path):
    def _first_and_sum(path):
        """Leaves a mark in its file whenever it is loaded."""
        with open(path, "a") as f:
            f.write("x")

        def encode(columns, rows):
            v, n = columns["v"], columns["n"]
            return np.stack([v.sums(v.values), v.lengths, v.sums(v.places() * 1.0), n], axis=1)

        return encode

    rows = [(i, "2023-01-01" if i % 2 else "2023-02-01", [float(k) for k in range(i % 5)] if i % 7 else None, i) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, date string, v array<double>, n long").withColumn("date", F.col("date").cast("date")).repartition(3)
    weights = str(tmp_path / "w")
    out = {r["id"]: list(r["emb"]) for r in B.embed_ragged(df, ["id", "date"], _first_and_sum, weights, 4, chunk_rows=3).collect()}
    for i, _, v, n in rows:
        v = v or []
        assert out[i] == [sum(v), len(v), sum(range(len(v))), n]
    root = f"{tmp_path}/panel"
    first = df.where("date = '2023-01-01'")
    assert [str(d) for d in B.embed_panel(first, ["id", "date"], _first_and_sum, weights, 4, root, "date")] == ["2023-01-01"]
    loads = len(open(weights).read())
    assert [str(d) for d in B.embed_panel(df, ["id", "date"], _first_and_sum, weights, 4, root, "date")] == ["2023-02-01"]
    assert B.embed_panel(df, ["id", "date"], _first_and_sum, weights, 4, root, "date") == []
    assert loads <= 16 and spark.read.parquet(root).count() == 50  # once per worker, not per chunk
    with pytest.raises(Exception, match="expected"):
        B.embed_ragged(df, ["id", "date"], _first_and_sum, weights, 3).collect()
    with pytest.raises(Exception, match="NaN"):
        B.embed_ragged(df.withColumn("v", F.array(F.lit(float("nan")))), ["id", "date"], _first_and_sum, weights, 4).collect()
    assert B.embed_ragged(df.limit(0), ["id", "date"], _first_and_sum, weights, 4).count() == 0
