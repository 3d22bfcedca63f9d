"""What the sequence queries share: ids read once, integers coded without patterns, views drawn per client."""

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions.scalars import category_key, uniform
from ledgerflow.operators import sequences as Q
from ledgerflow.operators import targets as T
from ledgerflow.schema import EventSchema
from ledgerflow.sources.readers import materialise

SCHEMA = EventSchema("id", "t", ("a",), ())


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i % 9, i, i % 4 if i % 11 else None) for i in range(150)] + [(77, 1, 5), (None, 1, 2), (None, 2, 3)]
    return materialise(spark.createDataFrame(rows, "id long, t long, a long"))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_split_reads_the_events_once(events):
    split = T.fixed_split(events, "id", 0, 0.3)
    assert not set(split.inputFiles()) & set(events.inputFiles())
    assert split.where("valid").count() == 3 and split.count() == 11


def test_integer_keys_need_no_pattern(events):
    assert "regexp_replace" not in plan_of(events.select(category_key("a", "bigint")))
    assert "regexp_replace" in plan_of(events.select(category_key(F.col("a").cast("string"), "string")))
    both = events.select(category_key("a", "bigint").alias("x"), category_key(F.col("a").cast("string"), "string").alias("y"))
    assert both.where("x <> y").count() == 0 and both.where("x = '<MISSING>'").count() == events.where("a IS NULL").count()


def test_views_are_drawn_per_client(events):
    k, shortest, longest, seed = 3, 2, 6, 4
    views = Q.subsequence_views(events, SCHEMA, k, shortest, longest, seed)
    assert "explode([0,1,2])" not in plan_of(views)  # no event is copied into views that it is not in
    own = {}
    for r in events.collect():
        own.setdefault(r["id"], []).append((r["t"], r["a"]))
    draws = events.select("id").distinct().withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(
        "id", "view", uniform(f"{seed}:len", "id", "view").alias("l"), uniform(f"{seed}:start", "id", "view").alias("s")).collect()
    want = set()
    for d in draws:
        rows = sorted(own[d["id"]])
        n = min(shortest + int(d["l"] * (longest - shortest + 1)), len(rows))
        start = int(d["s"] * (len(rows) - n + 1))
        want |= {(d["id"], d["view"], p, *rows[p]) for p in range(start, start + n)}
    got = views.select("id", "view", "position", "t", "a").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
