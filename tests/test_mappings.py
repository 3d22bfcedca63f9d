"""Frozen mappings as JSON: both formats, files, and everything that is refused."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import conform
from ledgerflow.sources import mappings as J

FIELDS = {"kind": "categorical", "code": "categorical", "value": "numeric", "at": "time"}
SOURCES = {"t": "time", "c1": "categorical", "c2": "categorical", "n1": "numeric"}
GOOD = {"format_version": J.STANDARD.version, "fields": {"kind": "c1", "code": "c1", "value": None, "at": "t"},
        "sources": {"c1": ["code", "kind"], "c2": [], "n1": [], "t": ["at"]}, "unfilled_fields": ["value"], "meta": {"note": [1, {"x": 2}]}}
OLD = {"mapping": {"t": "at", "c2": "kind", "n1": "value"}, "meta": None}


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [("field", f, k) for f, k in FIELDS.items()] + [("source", s, k) for s, k in SOURCES.items()]
    return spark.createDataFrame(rows, "side string, column string, kind string")


def docs_of(spark, docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)], "mapping_id long, document string")


def test_both_formats_round_trip_through_files(spark, catalogue, tmp_path):
    rows = [(0, False, f, s) for f, s in GOOD["fields"].items()] + [(1, True, f, s) for s, f in OLD["mapping"].items()]
    mappings = spark.createDataFrame(rows, "mapping_id long, legacy boolean, field string, source string")
    docs = J.encode_mappings(mappings, catalogue)
    J.write_documents(docs, f"{tmp_path}/frozen")
    back = J.read_documents(spark, f"{tmp_path}/frozen")
    plain = {r["mapping_id"]: json.loads(r["document"]) for r in back.collect()}
    assert plain[0]["fields"] == GOOD["fields"] and plain[0]["sources"] == GOOD["sources"] and plain[0]["unfilled_fields"] == ["value"] and plain[0]["dropped_sources"] == ["c2", "n1"]
    assert plain[1]["mapping"] == OLD["mapping"] and "fields" not in plain[1]
    assert J.load_mapping(back, 0, catalogue, "at", "t") == GOOD["fields"]
    assert J.load_mapping(back, 1, catalogue, "at", "t") == {"at": "t", "kind": "c2", "value": "n1"}
    got = {(r["mapping_id"], r["legacy"], r["field"], r["source"]) for r in J.decode_mappings(back).mappings.collect()}
    assert got == set(rows)


def changed(**parts):
    return {**json.loads(json.dumps(GOOD)), **parts}


@pytest.mark.parametrize(
    "doc,says",
    [
        ("{not json", "malformed"),
        (None, "no mapping"),
        ("{}", "no mapping"),
        ({"mapping": {}}, "no mapping"),
        (changed(format_version="v0"), "version"),
        (changed(fields=[1, 2]), "malformed|no mapping"),
        (changed(sources={**GOOD["sources"], "c1": ["kind"]}), "reverse_disagreements = 1"),
        (changed(sources={k: v for k, v in GOOD["sources"].items() if k != "c2"}), "catalogue_disagreements = 1"),
        (changed(unfilled_fields=[]), "unfilled_disagreements = 1"),
        ({"mapping": {"t": "at", "c1": "kind", "c2": "kind"}}, "legacy_duplicates = 1"),
        ({"mapping": {"t": "at", "c1": "value"}}, "kind_mismatches = 1"),
        ({"mapping": {"t": "at", "zz": "kind"}}, "unknown_sources = 1"),
        ({"mapping": {"t": "at", "c1": "other"}}, "unknown_fields = 1"),
        ({"mapping": {"c1": "kind"}}, "time_pair_errors = 1"),
        (changed(fields={"kind": "c1", "at": "t"}, sources=None, unfilled_fields=None), "missing_fields = 2"),
    ],
)
def test_bad_documents_are_refused(spark, catalogue, doc, says):
    with pytest.raises(ValueError, match=says):
        J.load_mapping(docs_of(spark, [doc]), 0, catalogue, "at", "t")


def test_undeclared_parts_do_not_disagree(spark, catalogue):
    docs = docs_of(spark, [GOOD, OLD, changed(sources=None, unfilled_fields=None)])
    rows = J.check_documents(docs, catalogue, "at", "t").collect()
    assert len(rows) == 3
    assert all(r["problem"] is None and not any(v for k, v in r.asDict().items() if k not in ("mapping_id", "sha256", "legacy", "problem")) for r in rows)
    assert J.check_documents(docs.limit(0), catalogue, "at", "t").count() == 0


def test_names_of_members_are_a_parameter(spark, catalogue):
    fmt = J.MappingFormat(version="own", fields="target_to_source", sources="source_to_target", unfilled="open")
    doc = {"format_version": "own", "target_to_source": GOOD["fields"], "source_to_target": GOOD["sources"], "open": ["value"]}
    assert J.load_mapping(docs_of(spark, [doc]), 0, catalogue, "at", "t", fmt) == GOOD["fields"]


def test_columns_of_a_consumer(spark):
    mapping = {"kind": "c1", "code": "c1", "value": None, "at": "t"}
    assert conform.source_columns(["id", "t"], mapping) == ["id", "t", "c1"]
    assert conform.source_columns(["id"], mapping, ["kind"]) == ["id", "c1"]
    with pytest.raises(ValueError, match="value"):
        conform.source_columns(["id"], mapping, ["value"])
    df = spark.createDataFrame([("a", 7.0, 1, "x")], "id string, c1 double, unused int, t string")
    slots = {"kind": "s1", "code": "s2", "value": "s3"}
    out = conform.apply_for_consumer(df, ["id"], mapping, ["kind", "code"], ["value"], slots, ["kind"])
    assert out.columns == ["id", "s1"] and out.first()["s1"] == 7
    assert conform.apply_for_consumer(df, ["id"], mapping, ["kind", "code"], ["value"], slots).first().asDict() == {"id": "a", "s1": 7, "s2": 7, "s3": 0.0}
    with pytest.raises(ValueError, match="missing"):
        conform.apply_for_consumer(df.drop("c1"), ["id"], mapping, ["kind", "code"], ["value"], slots, ["kind"])
    with pytest.raises(Exception, match="non-integer"):
        conform.apply_for_consumer(df.withColumn("c1", F.lit(3.5)), ["id"], mapping, ["kind", "code"], ["value"], slots, ["kind"]).collect()


def test_documents_are_parsed_once_and_a_mapping_comes_together_once(spark, catalogue):
    mappings = spark.createDataFrame([(0, False, f, s) for f, s in GOOD["fields"].items()] + [(1, True, f, s) for s, f in OLD["mapping"].items()], "mapping_id long, legacy boolean, field string, source string")
    docs = J.encode_mappings(mappings, catalogue)
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Join" not in plan
    checked = J.check_documents(docs, catalogue, "at", "t")
    assert "from_json" not in checked._jdf.queryExecution().optimizedPlan().toString()
    assert {r["catalogue_disagreements"] for r in checked.collect()} == {0}
