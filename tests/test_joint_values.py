"""Distinct joint values, counted inside the tasks."""

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import profile as P


@pytest.mark.parametrize("chunk", [1, 1 << 25])
def test_joint_values_are_the_distinct_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(P, "CHUNK_BYTES", chunk)
    rows = [(i % 3, str(i % 5) if i % 7 else None, i % 2 if i % 13 else None, None) for i in range(120)]
    df = spark.createDataFrame(rows, "a long, b string, c long, d long").repartition(3)
    pairs = [("a", "b"), ("c", "b"), ("a", "c"), ("a", "d")]
    got = P.joint_values(df, pairs).collect()
    at = {n: i for i, n in enumerate("abcd")}
    want = {(x, y, str(r[at[x]]), str(r[at[y]])) for r in rows for x, y in pairs if r[at[x]] is not None and r[at[y]] is not None}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert P.joint_values(df.where(F.lit(False)), pairs).count() == 0
