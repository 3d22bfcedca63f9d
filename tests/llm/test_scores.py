"""Quality, neighbours, fingerprints, personal data, dialogues and the pipeline."""

import re
import zlib

import numpy as np
import pytest
import regex
import xxhash
from compare import compare, duck
from helpers import SMALL, odd_texts, texts_frame
from pyspark.sql import functions as F

from ledgerflow.llm import queries  # noqa: F401
from ledgerflow.llm import chat, neighbours, personal, quality, spotsigs
from ledgerflow.llm.registry import ORACLES, QUERIES


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op10_compression_quality"](spark, sf).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(rows[i]["score"], q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())


def test_quality_without_labels_or_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, label int")
    model = quality.fit(texts_frame(spark, odd_texts()), empty)
    scores = [r["s"] for r in texts_frame(spark, odd_texts()).select(quality.score(F.col("text"), model).alias("s")).collect()]
    assert np.allclose(scores, 0.5)
    one = quality.fit(texts_frame(spark, odd_texts()), spark.createDataFrame([(4, 1), (1, 1), (5, None), (None, 0)], "doc_id long, label int"))
    assert one.probability("anything") > 0.9


def test_neighbours_reach_the_recall(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 16)) * r.uniform(0.2, 3, size=(3000, 1))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = neighbours.nearest(rows.filter("id % 20 = 0"), rows, 20).collect()
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        mine = sorted((g["rank"], g["vec_id"], g["score"]) for g in got if g["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert np.allclose([m[2] for m in mine], s[[m[1] for m in mine]])
        hits += len({m[1] for m in mine} & set(np.argsort(-s)[:20].tolist()))
    assert hits / (150 * 20) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    same = [(i, [1.0, 0.0]) for i in range(60)]
    odd = [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [float("inf"), 1.0]), (105, []), (106, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows = spark.createDataFrame(same + odd + [(200, [-1.0, 0.5])], "id long, v array<double>")
    got = neighbours.nearest(rows.filter("id in (0, 20, 100, 101, 106, 200)"), rows, 20).collect()
    first = [g["vec_id"] for g in sorted(got, key=lambda g: g["rank"]) if g["query_id"] == 20]
    assert first == list(range(20)) and {g["query_id"] for g in got} == {0, 20, 200}
    few = neighbours.nearest(rows.filter("id = 0"), rows.filter("id in (0, 1, 200)"), 20).collect()
    assert [(g["vec_id"], g["score"]) for g in sorted(few, key=lambda g: g["rank"])] == [(1, 1.0), (200, -1.0)]
    assert neighbours.nearest(rows.limit(0), rows.limit(0)).count() == 0


def test_fingerprints(spark):
    texts = [*odd_texts(), "the cat sat on the mat", "The cat, sat on the mat!"]
    rows = {r["doc_id"]: r for r in spotsigs.compared(texts_frame(spark, texts)).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain, 1):
        quarter, after = len(t) // 4, plain[i % len(plain)]
        assert rows[i]["edited"] == t[: len(t) - quarter] + after[:quarter]
        for a, b, name in ((t, rows[i]["edited"], "near_edited"), (t, after, "near_next")):
            if a == b:
                assert rows[i][name] == 1.0
        one, two = set(rows[i]["signatures"]), set(rows[i]["edited_signatures"])
        assert rows[i]["near_edited"] == (len(one & two) / len(one | two) if one | two else 1.0)
        after = set(rows[i % len(plain) + 1]["signatures"])
        assert rows[i]["near_next"] == pytest.approx(len(one & after) / len(one | after) if one | after else 1.0)
    assert rows[len(texts)]["signatures"] == rows[len(texts) - 1]["signatures"]
    assert spotsigs.compared(texts_frame(spark, texts).limit(0)).count() == 0


def plain_signatures(text):
    """Chains of up to three content words behind runs of anchors, straight from the words."""
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    anchors = set(spotsigs.ANCHORS)
    units = []  # runs of anchors count as one mark
    for w in words:
        if w not in anchors:
            units.append(w)
        elif not units or units[-1] is not None:
            units.append(None)

    def chain(rest):
        return " ".join([u for u in rest if u is not None][: spotsigs.CHAIN])

    chains = [chain(units[i + 1 :]) for i, u in enumerate(units) if u is None]
    chains = [c for c in chains if c] or [" ".join(words[i : i + spotsigs.CHAIN]) for i in range(len(words))] or ([text] if text else [])
    return sorted({xxhash.xxh64_intdigest(c.encode(), seed=42) & 0xFFFFFFFF for c in chains})


def test_chains_equal_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    extra = [t for t in odd_texts() if t is not None] + ["the of and", "the a the b c d e", "x the", "the  the cat", "no anchors here at all", "...", "The_cat sat"]
    docs = docs.union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    rows = docs.select("text", spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("s")).collect()
    assert all(r["s"] == plain_signatures(r["text"] or "") for r in rows)


def test_fingerprint_search_finds_all_pairs(spark):
    r = np.random.default_rng(2)
    sets = [sorted(r.choice(400, r.integers(1, 60), replace=False).tolist()) for _ in range(60)]
    sets += [sorted(set(s[: max(1, len(s) - 3)]) | {500 + i}) for i, s in enumerate(sets)] + [sets[0], []]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "id long, signatures array<long>")
    got = {(p["a"], p["b"]): p["likeness"] for p in spotsigs.near_pairs(frame, 0.75).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    ids = sorted(i for s, i in first.items() if s)
    want = {}
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = set(sets[i]), set(sets[j])
            if len(a & b) / len(a | b) >= 0.75:
                want[i, j] = len(a & b) / len(a | b)
    assert got == pytest.approx(want) and want


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(d) * (i % 2 + 1), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                    "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_entities_equal_the_expressions(spark):
    r = np.random.default_rng(3)
    parts = list("0123456789") * 2 + list(" .-+@()a_é😀") + ["1.2.3.4", "4111111111111111", "a@b.c", "+1 (555) 123-4567"]
    texts = ["".join(r.choice(parts, r.integers(0, 60))) for _ in range(800)] + odd_texts()
    texts += ["1" * 20_000, "a" * 20_000, "x@y.z_w@q.r@t.u", "0001.00000255.1.1 000256.1.1.1"]
    rows = personal.find_personal(texts_frame(spark, texts)).select("doc_id", personal.listed(F.col("base")).alias("b")).collect()
    assert {x["doc_id"]: x["b"] for x in rows} == {i: base_spans(t) for i, t in enumerate(texts, 1)}


def test_patterns_find_unseen_identifiers(spark):
    texts = [f"Please call phone: +1 (555) 100-{1000 + i} now" for i in range(30)] + ["call phone: 555-867-5309.", "xx 555-867-5309 yy"]
    frame = texts_frame(spark, texts)
    rows = frame.join(personal.find_personal(frame), "doc_id").select(
        "doc_id", personal.listed(F.col("spans")).alias("s"), personal.masked(F.col("text"), F.col("spans")).alias("m")
    )
    got = {r["doc_id"]: (r["s"], r["m"]) for r in rows.collect()}
    assert got[1] == ("phone:19:36", "Please call phone: <phone> now")
    assert got[31] == ("phone:12:24", "call phone: <phone>.") and got[32] == ("", texts[31])
    assert personal.find_personal(frame.limit(0)).count() == 0


def test_rotation_matches_sql(spark):
    df = QUERIES["op2_perspective_rotation"](spark, SMALL)
    assert compare(df, df.collect(), duck(SMALL), ORACLES["op2_perspective_rotation"]) == ""


def test_rotation_of_odd_turns(spark):
    turns = [(1, 0, "ann", "hi <|end|>", 1), (1, 9, "bob", None, 1), (1, 20, "system", "s", 1), (1, 9, "bob", None, 1), (1, None, None, "x", 1), (None, 1, "ann", "n", 1), (2, 0, "system", "alone", 1)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, viewer int")
    segments = chat.rotate(frame, block_turns=5)
    rows = {(r["conv_id"], r["viewer"]): r for r in chat.dialogues(segments).collect()}
    assert set(rows) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    ann = rows[1, "ann"]
    assert ann["text"] == "<|user|>\nunknown: x<|end|>\n<|assistant|>\nhi < |end|><|end|>\n" + "<|user|>\nbob: <|end|>\n" * 2 + "<|system|>\ns<|end|>\n"
    assert [ann["text"][m["start"] : m["stop"]] for m in ann["masks"]] == ["hi < |end|>"]
    for s in segments.collect():
        assert rows[s["conv_id"], s["viewer"]]["text"][s["start"] : s["stop"]] == s["segment"]
    assert chat.rotate(frame.limit(0)).count() == 0


def test_neighbours_of_every_dimension_and_repeated_ids(spark):
    r = np.random.default_rng(7)
    vectors = {i: r.normal(size=2 if i < 40 else 5).tolist() for i in range(90)}
    vectors[3] = vectors[4] = vectors[5] = vectors[2]
    rows = list(vectors.items()) + [(2, vectors[2])] * 30
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "id long, v array<double>, nth int, block long").repartition(4)
    got = {}
    for g in neighbours.nearest(frame.filter("id % 10 = 0"), frame, 5, share=1.0).collect():
        got.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"]))
    assert set(got) == set(range(0, 90, 10))
    for q, found in got.items():
        own = [i for i, v in vectors.items() if len(v) == len(vectors[q]) and i != q]
        want = sorted(own, key=lambda i: (-float(np.dot(vectors[i], vectors[q])), i))[:5]
        assert [i for _, i in sorted(found)] == want


def test_clashing_columns_of_quality_and_packing(spark):
    from ledgerflow.llm import packing

    docs = spark.createDataFrame([(i, "good text here " * 9 if i % 2 else "%% ## bad", i, "x", 0.5) for i in range(60)], "doc_id long, text string, id long, label string, h double")
    labels = spark.createDataFrame([(i, i % 2, "t") for i in range(60)], "doc_id long, label int, text string")
    model = quality.fit(docs, labels)
    assert docs.select(quality.score(F.col("text"), model).alias("s")).count() == 60
    pieces = spark.createDataFrame([(i, 0, 100 + i, 7, 8, 9, 10) for i in range(50)], "doc_id long, piece int, length long, offset long, sequence_id long, bin long, shard long")
    out = packing.pack(pieces, 4096)
    assert out.columns == ["doc_id", "piece", "length", "bin", "shard", "sequence_id", "offset"]
    rows = out.collect()
    assert len(rows) == 50 and all(r["bin"] == 9 and r["shard"] == 10 for r in rows) and {r["offset"] for r in rows if r["doc_id"] == 0} != {7}
