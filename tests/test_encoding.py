"""Encoding by lists and by joins, and the audit of what a vocabulary lacks."""

import pytest

from ledgerflow.operators import sequences as Q
from ledgerflow.schema import EventSchema
from ledgerflow.sources.readers import materialise

SCHEMA = EventSchema("id", "t", ("a", "b"), ())


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i % 7, i, i % 4 if i % 9 else None, float(i % 5) if i % 8 else float("nan")) for i in range(200)] + [(8, 1, 77, 99.0), (8, 2, 77, 1.0)]
    return materialise(spark.createDataFrame(rows, "id long, t long, a long, b double"))


def test_lists_and_joins_give_the_same_codes(events, monkeypatch):
    vocabulary = materialise(Q.fit_vocabulary(events.where("id < 7"), ["a", "b"]))
    want = sorted(map(str, Q.encode(events, vocabulary, ["a", "b"]).collect()))
    plan = Q.encode(events, vocabulary, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the one row of lists
    monkeypatch.setattr(Q, "DICTIONARY_VALUES", 2)
    joined = Q.encode(events, vocabulary, ["a", "b"])
    assert sorted(map(str, joined.collect())) == want
    codes = {(r["column"], r["value"]): r["code"] for r in vocabulary.collect()}
    for r in joined.collect():
        a = "<MISSING>" if r["a"] is None else str(r["a"])
        assert r["a_code"] == codes.get(("a", a), max(v for (c, _), v in codes.items() if c == "a") + 1)


def test_unknowns_by_column_and_split(spark, events):
    clients = spark.createDataFrame([(i, i == 8) for i in [*range(7), 8]], "id long, valid boolean")
    vocabulary = Q.fit_vocabulary(events.where("id < 7"), ["a", "b"])
    got = {(r["valid"], r["column"]): (r["n_rows"], r["n_unknown"]) for r in Q.split_unknowns(events, SCHEMA, clients, vocabulary, strict=True).collect()}
    assert got == {(False, "a"): (200, 0), (False, "b"): (200, 0), (True, "a"): (2, 2), (True, "b"): (2, 1)}
    part = Q.fit_vocabulary(events.where("id < 7 AND a < 2"), ["a", "b"])
    with pytest.raises(ValueError, match="incomplete train vocabulary: a"):
        Q.split_unknowns(events, SCHEMA, clients, part, strict=True)


def test_empty_vocabulary_knows_nothing(events):
    empty = Q.fit_vocabulary(events.limit(0), ["a", "b"])
    assert {(r["a_code"], r["b_code"]) for r in Q.encode(events, empty, ["a", "b"]).collect()} == {(1, 1)}
