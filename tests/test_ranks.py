"""Order statistics against brute force, on data that piles up in few values and groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import ranks as R
from ledgerflow.functions.scalars import hash60


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    g = np.where(rng.random(3000) < 0.8, "hot", rng.choice(["b", "c"], 3000))
    v = np.where(rng.random(3000) < 0.35, 0.0, np.round(rng.lognormal(3, 2, 3000), 2)) * rng.choice([-1, 1], 3000)
    f = pd.DataFrame({"g": g, "v": v, "i": range(3000)})
    return f, spark.createDataFrame(f).repartition(5)


def test_exact_quantiles(skewed):
    f, df = skewed
    levels = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {r.g: r.quantiles for r in R.exact_quantiles(counts, ["g"], "v", "n", levels).collect()}
    for g, part in f.groupby("g"):
        assert np.allclose(got[g], np.quantile(part.v, levels))
    whole = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    assert np.allclose(R.exact_quantiles(whole, [], "v", "n", levels).first()[0], np.quantile(f.v, levels))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double").withColumn("n", F.lit(1))
    assert R.exact_quantiles(df, ["g"], "v", "n", [0.5]).count() == 0


def test_running_totals_both_ways(skewed):
    f, df = skewed
    one = df.withColumn("one", F.lit(1))
    up = R.running_totals(R.value_bucketed(one, "v"), ["g"], [F.asc("v"), F.asc("i")], {"r": "one"}).toPandas()
    want = f.sort_values(["v", "i"]).groupby("g").cumcount() + 1
    assert (up.set_index("i").r.sort_index() == want.sort_index()).all()
    down = R.running_totals(R.value_bucketed(one, "v"), ["g"], [F.desc("v"), F.asc("i")], {"r": "one"}, descending=True).toPandas()
    want = f.sort_values(["v", "i"], ascending=[False, True]).groupby("g").cumcount() + 1
    assert (down.set_index("i").r.sort_index() == want.sort_index()).all()


def test_hash_rank_and_number_rows(skewed):
    f, df = skewed
    ranked = R.hash_rank(df.withColumn("h", hash60("s", "i")), ["g"], "h", ["i"]).toPandas()
    for _, part in ranked.groupby("g"):
        assert (part.sort_values(["h", "i"])["rank"].to_numpy() == np.arange(1, len(part) + 1)).all()
    numbered = R.number_rows(df, ["g"], [F.desc("v"), F.asc("i")], "n").toPandas()
    want = f.sort_values(["v", "i"], ascending=[False, True]).groupby("g").cumcount() + 1
    assert (numbered.set_index("i").n.sort_index() == want.sort_index()).all()
