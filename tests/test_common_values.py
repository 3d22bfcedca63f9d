"""Rank correlation with a value that most rows share."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import profile as P


@pytest.fixture(scope="module")
def pairs(spark):
    draw = random.Random(3)
    rows = [(0.0 if i % 2 else draw.random(), draw.random() + (i % 7)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "x double, y double")


def test_spearman_with_a_common_value(pairs):
    rows, df = pairs
    got = P.spearman(df, [("x", "y")]).first()
    assert got["n"] == 3000 and np.isclose(got["rho"], pd.DataFrame(rows).rank().corr().iloc[0, 1], atol=1e-12)


def test_common_values_are_looked_up_not_joined(spark, pairs):
    _, df = pairs
    cells = df.groupBy("x", "y").agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ranked = P._with_ranks(P.materialise(cells), ["k"], "x")
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
        assert ranked.count() == cells.count() and {r[0] for r in ranked.where("x = 0").select("_rx").distinct().collect()} == {750.5}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
