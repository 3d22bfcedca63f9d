"""Registered queries against their SQL. By default a sample of them on the smallest data;
LEDGERFLOW_ALL=1 runs all. ``python tests/compare.py`` does the same at larger scale."""

import os

import pytest
from compare import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SAMPLE = ["windows_latest_n", "daily_rollup", "vocabulary", "profile_numeric", "passport_distance", "average_precision", "psi_by_date", "undersample"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("LEDGERFLOW_ALL") else SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    problem = compare(df, df.collect(), con, ORACLES[name])
    assert problem in ("", "both empty")


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
