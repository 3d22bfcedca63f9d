"""Each stage of the pipeline does what its operator says, on all that it is given."""

import numpy as np
from helpers import SMALL, covered_bytes

import __spark_entry__ as entry
import corpus_pipeline as pipeline

from ledgerflow.sources.readers import materialise


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, SMALL))
        rows = docs.collect()
        assert rows
        if name != pipeline.STAGES[-1][0]:
            assert tuple(docs.columns) == pipeline.COLUMNS
            now = {r["doc_id"]: r for r in rows}
            assert len(now) == len(rows) and set(now) <= set(before)
        if name in ("quality classifier", "MinHash near-dedup"):
            assert all(now[i] == before[i] for i in now)
        if name == "suffix-array dedup":
            ids = sorted(before)
            texts = [before[i]["text"] for i in ids]
            for i, t, gone in zip(ids, texts, covered_bytes(texts, 100)):
                left = np.frombuffer((t or "").encode(), np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
                assert now[i]["text"] == left and now[i]["n_chars"] == len(left)
        if name == "PII":
            assert set(now) == set(before)
            assert any(now[i]["text"] != before[i]["text"] for i in now)
        if name == pipeline.STAGES[-1][0]:
            assert {r["doc_id"] for r in rows} == set(before)
        else:
            before = now


def test_repeated_rows_and_odd_texts(spark):
    texts = [None, "", "same text of a few words here", "same text of a few words here"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] * 2 + [(None, "no id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.one_of_each_group(spark, docs, SMALL).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["0", "1", "2", "None"]
    masked = pipeline.without_personal_data(spark, docs, SMALL)
    assert masked.count() == 9 and pipeline.without_repeats(spark, docs, SMALL).count() == 9
    assert pipeline.packed(spark, docs.limit(0), SMALL).count() == 0


def test_replacement_characters_of_the_text_stay(spark):
    passage = "é" + "".join(chr(97 + i * i * i % 997 % 26) for i in range(140))
    texts = [passage, "own \ufffd one ĩ" + passage[1:] + " two \ufffd"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.without_repeats(spark, docs, SMALL).collect()}
    assert got == {0: (passage, None), 1: ("own \ufffd one  two \ufffd", 16)}


def test_cut_texts_come_from_the_tasks_that_cut(spark):
    docs = spark.createDataFrame([(1, None, "x", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.without_repeats(spark, docs, SMALL)
    # a second Python step behind the operator means twice the workers, a carried text twice the exchange
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "EvalPython" not in plan
    assert "named_struct(text" not in plan and "struct(text" not in plan
    assert [tuple(r) for r in out.collect()] == [(1, None, "x", None, None)]


def test_everything_is_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def exchanged(plan):
    """Bytes that the exchanges of an executed plan moved, the texts among their columns."""
    name = plan.getClass().getSimpleName()
    if name == "ShuffleExchangeExec" and "text#" in plan.output().toString():
        return plan.metrics().apply("dataSize").value()
    if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
        return exchanged(plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan())
    return sum(exchanged(plan.children().apply(i)) for i in range(plan.children().size()))


def test_texts_that_stay_are_not_exchanged(spark):
    random = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in random.integers(0, 10**6, 200)) for _ in range(400)]
    texts += texts[:20]
    docs = materialise(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pipeline.one_of_each_group(spark, docs, SMALL)
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r["doc_id"] for r in rows) == list(range(400))
    # the 20 that go, and the few that share a bit of the map with one of them
    assert 0 < exchanged(out._jdf.queryExecution().executedPlan()) < 0.3 * sum(map(len, texts))


def test_one_row_stays_of_an_id_with_two_texts(spark):
    copied, own = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(i, t, "en", "s", 1) for i, t in ((1, copied), (5, copied), (5, own), (None, own), (None, own))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.one_of_each_group(spark, docs, SMALL).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "5", "None", "None"]


def test_marked_rows_hold_every_member(spark, monkeypatch):
    from ledgerflow.llm import members

    rows = spark.range(-20_000, 20_000).selectExpr("if(id = 7, null, cast(id as int)) as doc_id", "id")
    ids = materialise(spark.range(-20_000, 20_000, 100).selectExpr("id as doc_id"))
    for most, share in ((1 << 26, 0.1), (1 << 15, 0.1), (64, 1.0)):
        monkeypatch.setattr(members, "MOST_BITS", most)
        got = members.marked(rows, ids).collect()
        assert len(got) == 40_000 and all(r["maybe"] for r in got if r["id"] % 100 == 0)
        assert sum(r["maybe"] for r in got) <= share * 40_000 and not any(r["maybe"] for r in got if r["id"] == 7)
    assert not any(r["maybe"] for r in members.marked(rows, ids.limit(0)).collect())
