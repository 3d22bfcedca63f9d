"""Sketched passports: parts merged in any way, odd values, stated errors."""

import math
import random

from pyspark.sql import functions as F

from ledgerflow.operators import profile as P
from ledgerflow.operators import sketches as K
from ledgerflow.schema import ColumnSpec
from ledgerflow.sources.readers import materialise

SPECS = [ColumnSpec("c", "categorical"), ColumnSpec("x", "numeric"), ColumnSpec("flag", "numeric"), ColumnSpec("none", "numeric"), ColumnSpec("flat", "numeric")]


def table_of(spark, n=6000):
    rng = random.Random(2)
    odd = [None, float("nan"), float("inf"), 0.0, -0.0]
    rows = [(0 if rng.random() < 0.4 else rng.randint(1, 4), rng.choice(["a", "b", "c", None]) if i % 2 else f"v{i}", odd[i % 5] if i % 50 < 5 else rng.lognormvariate(3, 2) + 1e7, float(i % 2), None, 5.0) for i in range(n)]
    return materialise(spark.createDataFrame(rows, "part int, c string, x double, flag double, none double, flat double"))


def test_merged_parts_stay_within_the_stated_errors(spark, tmp_path):
    df = table_of(spark)
    parts = K.sketch_columns(df, SPECS, ["part"])
    parts.where("part < 2").write.parquet(f"{tmp_path}/a")
    parts.where("part >= 2").write.parquet(f"{tmp_path}/b")
    kept = spark.read.parquet(f"{tmp_path}/a", f"{tmp_path}/b")
    counts = materialise(P.value_counts_long(df, SPECS))
    exact = {r["column"]: r for r in P.profile_columns(df, SPECS, counts).collect()}
    whole = K.sketched_passports(K.sketch_columns(df, SPECS))
    for passports in (materialise(K.sketched_passports(K.merge_sketches(kept))), materialise(whole)):
        got = {r["column"]: r for r in passports.collect()}
        assert set(got) == set(exact)
        for c, e in exact.items():
            g = got[c]
            assert (g["n_rows"], g["n_valid"], g["min"], g["max"], g["numeric_subtype"]) == (e["n_rows"], e["n_valid"], e["min"], e["max"], e["numeric_subtype"])
            assert abs(g["n_unique"] - e["n_unique"]) <= K.distinct_error() * e["n_unique"]
            for f in ("null_share", "mean", "std", "zero_share", "integer_share"):
                assert (g[f] is None) == (e[f] is None) and (g[f] is None or math.isclose(g[f], e[f], rel_tol=1e-9, abs_tol=1e-12)), (c, f)
        assert got["none"]["quantiles"] is None and got["flat"]["quantile_fallback"] == "constant" and got["flag"]["n_unique"] == 2
        errors = {r["column"]: r["rank_error"] for r in K.quantile_rank_errors(passports, counts).collect()}
        assert set(errors) == {"x", "flag", "flat"} and max(errors.values()) <= K.rank_error()


def test_parts_are_kept_apart_and_merge_in_steps(spark):
    df = table_of(spark, 600)
    parts = materialise(K.sketch_columns(df, SPECS, ["part"]))
    assert parts.count() == 5 * df.select("part").distinct().count()
    two = parts.withColumn("half", F.col("part") % 2)
    once, twice = K.merge_sketches(parts), K.merge_sketches(K.merge_sketches(two, ["half"]))
    a, b = ({r["column"]: r for r in K.sketched_passports(m).collect()} for m in (once, twice))
    for c in a:
        assert a[c]["n_unique"] == b[c]["n_unique"] and a[c]["n_rows"] == 600
        assert a[c]["std"] == b[c]["std"] or math.isclose(a[c]["std"], b[c]["std"], rel_tol=1e-9)
    assert K.merge_sketches(parts.limit(0)).count() == 0
