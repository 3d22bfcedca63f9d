"""Windows: no test of the grid is repeated below the projections, only asked-for windows are built."""

from datetime import datetime

import pytest

from ledgerflow.operators.embed import stat_features
from ledgerflow.operators.windows import _Grid, windows
from ledgerflow.schema import EventSchema
from ledgerflow.sources.readers import materialise
from pyspark.sql import functions as F

SCHEMA = EventSchema("id", "t", ("a", "b"), ("x",))
DATES = ["2020-02-01", "2020-03-01", "2020-07-01"]


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i % 5, datetime(2019, 11 + i % 2, 1 + i % 28) if i % 3 else datetime(2020, 1 + i % 6, 1 + i % 28), i % 4 if i % 7 else None, str(i % 3), float(i)) for i in range(300)]
    return materialise(spark.createDataFrame(rows, "id long, t timestamp_ntz, a long, b string, x double"))


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_grid_tests_occur_once_per_bit(events):
    placed = _Grid(F.col("t"), DATES, 2, False).place(events).agg(F.sum(F.col("_started") - F.col("_passed")))
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") <= 4  # two counts of two bits


@pytest.mark.parametrize("cap", [None, 3, 500])
def test_wanted_windows_are_those_of_all(spark, events, cap):
    wanted = spark.createDataFrame([(0, "2020-02-01"), (1, "2020-07-01"), (1, "2020-03-01"), (1, "2020-03-01"), (9, "2020-02-01")], "id long, target_date string")
    wanted = wanted.withColumn("target_date", F.col("target_date").cast("date"))
    whole = windows(events, SCHEMA, DATES, 2, cap)
    some = windows(events, SCHEMA, DATES, 2, cap, wanted=wanted)
    want = rows(whole.join(wanted.distinct(), ["id", "target_date"], "left_semi"))
    assert want and rows(some) == want


def test_stat_features_of_a_client_without_id_and_of_missing_categories(spark):
    got = [(None, datetime(2020, 1, 5), 1, "u", 2.0), (None, datetime(2020, 1, 6), 1, "v", 4.0), (1, datetime(2020, 1, 5), None, None, 1.0)]
    w = windows(spark.createDataFrame(got, "id long, t timestamp_ntz, a long, b string, x double"), SCHEMA, DATES[:1], 2, 500)
    out = {r["id"]: r for r in stat_features(w, SCHEMA).collect()}
    assert (out[None]["n_events"], out[None]["a_distinct"], out[None]["a_top_share"], out[None]["b_distinct"], out[None]["x_sum"]) == (2, 1, 1.0, 2, 6.0)
    assert (out[1]["n_events"], out[1]["a_distinct"], out[1]["a_top_share"], out[1]["b_top_share"]) == (1, 0, 0.0, 0.0)
