"""Exact quantiles order only a small part of the rows, whatever their number."""

import numpy as np
from pyspark.sql import functions as F

from ledgerflow.functions import ranks


def test_few_rows_are_ordered_for_quantiles(spark):
    levels = [i / 20 for i in range(21)]
    rows = spark.range(60_000).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("v"), F.lit(1).cast("bigint").alias("n"))
    # 256 buckets leave a sixth of the rows to be exchanged and ordered
    near = ranks._near_ranks(rows, ["g"], "v", "n", levels)
    assert near.count() < 60_000 / 25
    # no row is exchanged before the others are left out
    assert "BroadcastHashJoin" in near._jdf.queryExecution().executedPlan().toString()
    got = {r["g"]: r["quantiles"] for r in ranks.exact_quantiles(rows, ["g"], "v", "n", levels).collect()}
    for g in (0, 1):
        own = np.array([r["v"] for r in rows.where(F.col("g") == g).collect()])
        assert np.allclose(got[g], np.quantile(own, levels), rtol=1e-12)


def test_a_common_value_is_one_row(spark):
    rows = spark.range(20_000).select(F.lit("a").alias("g"), F.when(F.col("id") % 3 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"), F.lit(1).cast("bigint").alias("n"))
    near = ranks._near_ranks(rows, ["g"], "v", "n", [0.1, 0.5, 0.9])
    assert [(r["_n"], r["_start"]) for r in near.where("_v = 0").collect()] == [(rows.where("v = 0").count(), 0)] and near.count() < 200
    assert ranks.exact_quantiles(rows, ["g"], "v", "n", [0.1, 0.5]).collect()[0]["quantiles"] == [0.0, 0.0]
