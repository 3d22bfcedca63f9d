"""Windows, series, conforming, mappings and sinks on hand-made rows."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import scalars as S
from ledgerflow.operators import conform, sequences, windows
from ledgerflow.operators import targets as T
from ledgerflow.schema import EventSchema
from ledgerflow.sources import readers, writers

SCHEMA = EventSchema("id", "col_1", ("col_2", "col_3"), ("col_11",))
TYPES = "id string, col_1 timestamp_ntz, col_2 bigint, col_3 bigint, col_11 double"


def frame(spark, rows):
    return spark.createDataFrame(rows, TYPES)


def day(y, m, d, h=0):
    return datetime(y, m, d, h)


@pytest.mark.parametrize("order", [0, 1, 2])
def test_tie_order_ignores_row_order(spark, order):
    rows = [("a", day(2022, 12, 31), i, 19 - i, 1.0) for i in range(20)]
    random.Random(order).shuffle(rows)
    w = windows.windows(frame(spark, rows).repartition(order + 1), SCHEMA, ["2023-01-01"], 12, max_events=5)
    assert sorted(r.col_2 for r in w.collect()) == [15, 16, 17, 18, 19]


def test_cutoff_and_start_bounds(spark):
    rows = [("a", day(2022, 12, 31), 3, 0, 1.0), ("a", day(2023, 1, 1), 99, 0, 1.0), ("a", day(2022, 1, 1), 7, 0, 1.0), ("a", day(2022, 1, 1, 5), 8, 0, 1.0)]
    df = frame(spark, rows)
    got = {r.col_2 for r in windows.windows(df, SCHEMA, ["2023-01-01"], 12, max_events=9).collect()}
    assert got == {3, 8}
    got = {r.col_2 for r in windows.windows(df, SCHEMA, ["2023-01-01"], 12, include_cutoff=True).collect()}
    assert got == {3, 8, 99}
    assert windows.windows(df.where("false"), SCHEMA, ["2023-01-01"], 12, max_events=9).count() == 0


@pytest.mark.parametrize("include", [False, True])
def test_overlapping_windows_match_brute_force(spark, include):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        # one client holds most rows
        c = "hot" if rng.random() < 0.7 else rng.choice("ab")
        rows.append((c, day(2023, rng.randint(1, 12), rng.randint(1, 28), rng.choice([0, 9])), rng.randint(0, 3), i, float(i)))
    dates = [date(2023, m, 1) for m in range(2, 13)] + [date(2023, 3, 31), date(2023, 5, 31)]
    got = windows.windows(frame(spark, rows).repartition(6), SCHEMA, dates, 3, max_events=7, include_cutoff=include)
    got = {(r.id, r.target_date, r.col_3) for r in got.collect()}
    want = set()
    for d in dates:
        m = d.month - 3
        y, m = (d.year, m) if m > 0 else (d.year - 1, m + 12)
        last = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m - 1]
        start, end = day(y, m, min(d.day, last)), day(d.year, d.month, d.day)
        for c in ("hot", "a", "b"):
            mine = [r for r in rows if r[0] == c and r[1] > start and (r[1] <= end if include else r[1] < end)]
            mine.sort(key=lambda r: (r[1], r[2], r[3], r[4]), reverse=True)
            want |= {(c, d, r[3]) for r in mine[:7]}
    assert got == want


def test_tasks_follow_the_window_rows(spark, monkeypatch):
    days = [day(2023, m, d) for m in (1, 2) for d in range(1, 29)]
    rows = [(f"c{k}", d, 1, 2, 0.0) for k in range(20) for d in days]
    dates = ["2023-02-01", "2023-03-01"]
    w = windows.windows(frame(spark, rows), SCHEMA, dates, 2, max_events=100)
    want = sorted(tuple(r) for r in w.collect())
    assert w.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(windows, "WINDOW_ROWS", 50)
    w = windows.windows(frame(spark, rows), SCHEMA, dates, 2, max_events=100)
    assert w.rdd.getNumPartitions() == -(-len(want) // 50) and sorted(tuple(r) for r in w.collect()) == want


def test_many_dates_use_the_same_windows(spark):
    rows = [("a", day(2023, 1, 1 + i), i, 0, 1.0) for i in range(28)]
    dates = [date(2023, 1 + m, d) for m in range(3) for d in range(1, 29)]
    w = windows.windows(frame(spark, rows), SCHEMA, dates, 1, max_events=3)
    assert w.where("target_date = '2023-01-10'").count() == 3
    assert {r.col_2 for r in w.where("target_date = '2023-01-10'").collect()} == {6, 7, 8}


def test_window_plan_prunes_before_the_shuffle_and_places_clients_once(spark, tmp_path):
    path = str(tmp_path / "t")
    frame(spark, [("a", day(2022, 1, 1), 1, 1, 1.0)]).write.parquet(path)
    w = windows.windows(spark.read.parquet(path), SCHEMA, ["2023-01-01", "2023-02-01"], 12, max_events=5)
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert plan.count("Exchange hashpartitioning") == 2
    assert "PushedFilters: [IsNotNull(col_1), LessThan(col_1" in plan
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_day_sums_semi_join_and_series(spark):
    rows = [("a", day(2022, 12, 30), 0, 0, 1.0), ("a", day(2022, 12, 30, 8), 0, 0, 2.0), ("a", day(2023, 1, 1), 0, 0, 100.0), ("b", day(2022, 12, 31), 0, 0, 4.0), ("c", day(2022, 12, 31), 0, 0, 99.0)]
    labelled = spark.createDataFrame([("a",), ("b",)], "id string")
    kept = windows.labelled_only(frame(spark, rows), labelled, "id")
    daily = conform.daily_sum(kept, "id", "col_1", "col_11")
    before = {r.id: r.value for r in daily.where("day < '2023-01-01'").collect()}
    assert before == {"a": 3.0, "b": 4.0}
    s = {r.id: r.series for r in windows.window_series(daily, "id", ["2023-01-01"], 1).collect()}
    assert set(s) == {"a", "b"} and len(s["a"]) == 30
    assert list(s["a"][-2:]) == [3.0, 0.0] and list(s["b"][-2:]) == [0.0, 4.0] and sum(s["a"]) == 3.0


def test_scalars(spark):
    df = spark.createDataFrame([(2.5, 7.0, "7.0", "a::b"), (3.5, float("nan"), None, "c"), (-2.7, float("inf"), "x", "d"), (float("nan"), 2.0, "1.5", "e")], "v double, d double, s string, c string")
    codes = [r[0] for r in df.select(S.as_code("v")).collect()]
    assert codes == [2, 4, -3, None]
    assert [r[0] for r in df.select(S.finite("d")).collect()] == [7.0, None, None, 2.0]
    assert [r[0] for r in df.select(S.category_key("d", "double")).collect()] == ["7", S.MISSING_CATEGORY, S.MISSING_CATEGORY, "2"]
    assert [r[0] for r in df.select(S.category_key("s")).collect()] == ["7", S.MISSING_CATEGORY, "x", "1.5"]
    stamped = df.select(S.stamp_window_id("c", F.lit("2024-01-01").cast("date")).alias("w"))
    client, when = S.split_window_id("w")
    first = stamped.select(client.alias("c"), when.alias("d")).first()
    assert (first.c, first.d) == ("a::b", date(2024, 1, 1))


MAPPING_SLOTS = {
    "event_type": "col_2", "event_subtype": "col_3", "currency": "col_4", "src_type11": "col_5", "src_type12": "col_6", "dst_type11": "col_7", "dst_type12": "col_8",
    "src_type21": "col_9", "src_type22": "col_10", "src_type31": "col_13", "src_type32": "col_14", "amount": "col_11",
}
FIELDS = [f for f in MAPPING_SLOTS if f != "amount"]


def test_apply_mapping_with_reuse_and_gaps(spark):
    df = spark.createDataFrame([("a", 7.0, 8.0, 3.0, 4.0, 0.25)], "id string, col_2 double, col_3 double, col_6 double, col_10 double, col_12 double")
    m = dict.fromkeys(MAPPING_SLOTS)
    m |= {"event_type": "col_2", "event_subtype": "col_2", "dst_type11": "col_2", "dst_type12": "col_2", "src_type11": "col_3", "src_type12": "col_3", "src_type22": "col_10", "src_type32": "col_10", "currency": "col_6", "amount": "col_12"}
    r = conform.apply_mapping(df, ["id"], m, FIELDS, ["amount"], MAPPING_SLOTS).first()
    assert [r[s] for s in ("col_2", "col_3", "col_7", "col_8")] == [7] * 4
    assert [r[s] for s in ("col_5", "col_6")] == [8, 8] and [r[s] for s in ("col_10", "col_14")] == [4, 4]
    assert (r.col_9, r.col_13, r.col_4, r.col_11, r.id) == (0, 0, 3, 0.25, "a")


@pytest.mark.parametrize("bad", [3.5, float("inf")])
def test_apply_mapping_rejects_bad_codes(spark, bad):
    df = spark.createDataFrame([("a", bad)], "id string, col_2 double")
    m = dict.fromkeys(MAPPING_SLOTS) | {"event_type": "col_2"}
    with pytest.raises(Exception, match="non-integer category code"):
        conform.apply_mapping(df, ["id"], m, FIELDS, ["amount"], MAPPING_SLOTS).collect()
    counts = conform.mapping_issue_counts(df, m, FIELDS).first()
    assert counts.infinite + counts.fractional == 1


def test_rebuild_needs_sources_and_codes(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "id string, x bigint, y double")
    out = conform.rebuild_ledger(df, ["id"], {"f": "x", "g": None, "amount": "y"}, {"f": "c1", "g": "c2", "amount": "c3"}, {"c2": 9}, ["c4"]).first()
    assert (out.c1, out.c2, out.c3, out.c4) == (1, 9, 2.0, 0)
    with pytest.raises(ValueError, match="missing"):
        conform.rebuild_ledger(df, ["id"], {"f": "z"}, {"f": "c1"}, {})
    with pytest.raises(ValueError, match="only a category"):
        conform.rebuild_ledger(df, ["id"], {"amount": None}, {"amount": "c3"}, {})


def test_rollup_sums_value_and_keeps_null_groups(spark):
    rows = [("a", day(2023, 1, 1, 1), 1, None, 2.0), ("a", day(2023, 1, 1, 9), 1, None, 3.0), ("a", day(2023, 1, 1, 9), 1, 4, 3.0)]
    out = conform.daily_rollup(frame(spark, rows), SCHEMA, "col_11").collect()
    assert sorted((r.col_3 or -1, r.col_11) for r in out) == [(-1, 5.0), (4, 3.0)]


def test_constant_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [r.v for r in conform.minmax_scale(df, "v").collect()] == [0.0, 0.0]


# -- sinks -----------------------------------------------------------------------------


def test_fold_scan_is_pruned(spark, tmp_path):
    root = str(tmp_path / "led")
    spark.range(50).withColumn("fold", (F.col("id") % 5).cast("int")).write.partitionBy("fold").parquet(root)
    df = readers.read_folds(spark, root, [1, 3])
    assert df.count() == 20
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [fold" in plan.replace("isnotnull(fold#", "fold#") or "PartitionFilters: [fold#" in plan


def test_sharded_checked_lineage_and_csv(spark, tmp_path):
    df = spark.range(200).select(F.col("id").cast("string").alias("id"), F.col("id").alias("n"))
    writers.write_sharded(df, str(tmp_path / "s"), "id", 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and back.groupBy("id").agg(F.count_distinct("shard").alias("k")).where("k > 1").count() == 0
    assert writers.write_checked(df, str(tmp_path / "c")) == 200
    assert writers.write_with_lineage(df, str(tmp_path / "l"), {"mapping": {"a": "b"}}) == 200
    assert writers.read_lineage(spark, str(tmp_path / "l")) == {"mapping": {"a": "b"}}
    writers.write_csv(df.limit(3), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_publish_skips_done_dates_and_replaces_only_its_own(spark, tmp_path):
    root = str(tmp_path / "panel")
    first = spark.createDataFrame([("a", date(2024, 1, 1), 1.0), ("a", date(2024, 2, 1), 2.0)], "id string, date date, v double")
    writers.publish_panel(first, root)
    again = spark.createDataFrame([("a", date(2024, 2, 1), 9.0), ("a", date(2024, 3, 1), 3.0)], "id string, date date, v double")
    done = readers.read_panel(spark, root).select("date").distinct()
    writers.publish_panel(again, root, done=done)
    got = {str(r.date): r.v for r in readers.read_panel(spark, root).collect()}
    assert got == {"2024-01-01": 1.0, "2024-02-01": 2.0, "2024-03-01": 3.0}


def test_finalize_needs_every_part(spark):
    expected = spark.createDataFrame([(0,), (1,)], "shard int")
    parts = spark.createDataFrame([(0, "a")], "shard int, id string")
    done = spark.createDataFrame([(0,)], "shard int")
    with pytest.raises(FileNotFoundError, match="missing shard 1"):
        writers.finalize_panel(parts, expected, done, "shard")
    assert writers.finalize_panel(parts, expected, expected, "shard").count() == 1


def test_pending_work_guards_settings(spark):
    expected = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x")], "shard int, settings string")
    ledger = spark.createDataFrame([(0, "x"), (1, "y")], "shard int, settings string")
    work = writers.pending_work(expected, ledger, ["shard"])
    assert {(r.shard, r.conflict) for r in work.collect()} == {(1, True), (2, False)}
    with pytest.raises(ValueError, match="other settings"):
        writers.require_no_conflict(work)


def test_cohort_hash_ignores_order(spark):
    df = spark.range(100).withColumn("y", F.col("id") % 3)
    a = df.agg(*writers.cohort_hash(["id", "y"])).first()
    assert a == df.orderBy(F.desc("id")).agg(*writers.cohort_hash(["id", "y"])).first()
    assert a != df.withColumn("y", F.lit(0)).agg(*writers.cohort_hash(["id", "y"])).first()


# -- vocabularies and sequences --------------------------------------------------------


@pytest.fixture(scope="module")
def clients(spark):
    rows = []
    for c in range(64):
        for e in range(1 if c == 63 else 20 + c % 13):
            k = (c + e) % 4
            rows.append((f"c{c:02d}", day(2023, 1 + e // 28, 1 + e % 28), k, 10 + k, float(e)))
    return frame(spark, rows).repartition(4).cache()


def test_vocabulary_is_train_only(spark, clients):
    cap = windows.latest_events(clients, 24, SCHEMA)
    assert cap.groupBy("id").count().agg(F.max("count")).first()[0] == 24
    split = T.fixed_split(cap, "id", 0, 0.2)
    assert split.where("valid").count() == 12
    odd = cap.join(split, "id").withColumn("col_3", F.when(F.col("valid"), F.lit(999)).otherwise(F.col("col_3")))
    train = odd.where("NOT valid").join(sequences.eligible_clients(odd, "id").select("id"), "id", "left_semi")
    vocab = sequences.fit_vocabulary(train, ["col_2", "col_3"])
    rows = sorted((r for r in vocab.collect() if r.column == "col_2"), key=lambda r: r.code)
    assert [r.code for r in rows] == [1, 2, 3, 4]
    assert [(-r["count"], r.value) for r in rows] == sorted((-r["count"], r.value) for r in rows)
    assert not vocab.where("value = '999'").count()
    audit = sequences.prepare_audit(odd.drop("valid"), SCHEMA, split, vocab).first()
    assert audit.unknown_train == 0 and audit.unknown_valid > 0
    assert audit.clients_total == 64 and audit.short_clients_excluded == 1
    sizes = {r.column: r.size for r in sequences.vocabulary_sizes(vocab).collect()}
    assert sizes["col_2"] == 6


def test_split_is_order_free(spark):
    ids = spark.range(100).select(F.col("id").cast("string").alias("id"))
    a = {r.id for r in T.fixed_split(ids, "id", 0, 0.05).where("valid").collect()}
    b = {r.id for r in T.fixed_split(ids.orderBy(F.rand(1)), "id", 0, 0.05).where("valid").collect()}
    assert a == b and len(a) == 5


def test_sequences_align_and_start_at_zero(spark, clients):
    codes = sequences.factorise(clients, "col_2")
    s = sequences.event_sequences(clients, SCHEMA, "col_2", codes, 24)
    for r in s.limit(5).collect():
        assert r.times[0] == 0.0 and r.deltas[0] == 0.0 and len(r.times) == len(r.types) <= 24
        assert list(r.times) == sorted(r.times) and sum(r.deltas) == r.times[-1]


def test_output_order(spark, clients):
    rows = windows.in_order(windows.latest_events(clients, 5, SCHEMA), SCHEMA).rdd.glom().collect()
    for part in rows:
        keys = [(r.id, r.col_1, r.col_2) for r in part]
        assert keys == sorted(keys)
    where = {}
    for i, part in enumerate(rows):
        for r in part:
            assert where.setdefault(r.id, i) == i


def test_masks_and_views(spark, clients):
    cap = windows.latest_events(clients, 24, SCHEMA)
    m = sequences.masked_events(cap, SCHEMA, 0.01, 1)
    assert m.groupBy("id").agg(F.count_if("masked").alias("k")).where("k = 0").count() == 0
    v = sequences.subsequence_views(cap, SCHEMA, 5, 3, 8, 1)
    g = v.groupBy("id", "view").agg(F.count(F.lit(1)).alias("n"), (F.max("position") - F.min("position") + 1).alias("span"))
    assert g.where("n <> span OR n > 8").count() == 0 and g.count() == 64 * 5
