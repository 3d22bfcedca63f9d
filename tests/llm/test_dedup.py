"""Repeated strings, repeated windows and near-duplicates against brute force."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from compare import compare, duck
from helpers import SMALL, WORD, covered_bytes, covered_words, odd_texts, sha, texts_frame

from ledgerflow.llm import queries  # noqa: F401
from ledgerflow.llm import chunks, components, hyperminhash, near_dedup, suffix_dedup, window_dedup
from ledgerflow.llm.registry import ORACLES, QUERIES


def mixed_texts(seed, count=120):
    r = random.Random(seed)
    base = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) + str(r.randint(0, 30)) for _ in range(r.randint(1, 150))) for _ in range(15)]
    out = odd_texts()
    while len(out) < count:
        a, b = r.choice(base), r.choice(base)
        words = a.split()
        if r.random() < 0.4 and words:
            words[r.randrange(len(words))] = "edit"
        out.append(r.choice([a, a[: r.randint(0, len(a))] + b[r.randint(0, len(b)) :], " ".join(words), a + " " + b]))
    return out


def test_suffix_dedup_matches_brute_force(spark):
    texts = mixed_texts(1)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(texts_frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, (t, gone) in enumerate(zip(texts, covered_bytes(texts, 100)), 1):
        b = (t or "").encode()
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"], bytes(got[i]["kept"])) == (len(b), int(gone.sum()), left)
        marks = np.zeros(len(b), bool)
        for s in got[i]["spans"]:
            marks[s["start"] : s["end"]] = True
        assert (marks == gone).all() and len(got[i]["spans"]) == got[i]["n_spans"]


def test_suffix_dedup_of_nothing_and_of_repeated_ids(spark):
    frame = texts_frame(spark, ["q" * 150] * 3)
    assert suffix_dedup.remove_repeats(frame.limit(0)).count() == 0
    same = frame.selectExpr("cast(null as long) as doc_id", "text", "'k' as lang")
    rows = suffix_dedup.remove_repeats(same, carry=("lang",)).collect()
    assert sorted(r["n_removed"] for r in rows) == [149 + 1, 150, 150] or sorted(r["n_removed"] for r in rows)[1:] == [150, 150]
    assert {r["carry"]["lang"] for r in rows} == {"k"}


def test_hot_anchors_are_split(spark):
    r = random.Random(7)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line, passage = "=== this very line is everywhere, always the same ===", noise(260)
    texts = [noise(150) + r.choice([line, passage]) + noise(150) for _ in range(600)]
    texts += texts[:40] + [noise(150) + t[60:] for t in texts[40:60]] + ["z" * 3000] + mixed_texts(8, 40)
    rows = [(i, t or "") for i, t in enumerate(texts, 1)]
    largest = {}
    for most in (suffix_dedup.MOST, 3000):
        got = {x["doc_id"]: x for x in suffix_dedup.remove_repeats(texts_frame(spark, texts), most=most).collect()}
        for (i, t), gone in zip(rows, covered_bytes(texts, 100)):
            assert bytes(got[i]["kept"]) == np.frombuffer(t.encode(), np.uint8)[~gone].tobytes()
        # the same by hand, to see how much text each shard gets
        tables = [pa.table({"chunk": [k] * len(p), "doc_id": [i for i, _ in p], "no_id": [False] * len(p), "data": [t.encode() for _, t in p]}) for k, p in enumerate((rows[0::3], rows[1::3], rows[2::3]))]
        own = [chunks.Chunk(t) for t in tables]
        find = lambda parts, kinds: suffix_dedup._found(pa.concat_tables(parts), kinds, most, 100)
        first = find([suffix_dedup._anchor_rows(o, k, 1, 100, 32) for k, o in enumerate(own)], ("cold", "hot"))
        of = lambda table, k: table.filter(pa.compute.equal(table["chunk"], k))
        hot = [suffix_dedup._by_kind(of(first, k))["hot"] for k in range(3)]
        assert any(map(len, hot)) == (most == 3000)
        second = [suffix_dedup._longer_rows(o, k, hot[k], 1, 100, 32) for k, o in enumerate(own)]
        parts = [first]
        for bucket, kinds in enumerate((("whole", "whole"), ("", "longer"))):
            rows_of = [t.filter(pa.compute.equal(t["bucket"], bucket)) for t in second]
            parts += [find(rows_of, kinds)] if any(map(len, rows_of)) else []
        found = pa.concat_tables(parts)
        held = {}
        for k, o in enumerate(own):
            place, size, key = suffix_dedup._runs(o, suffix_dedup._by_kind(of(found, k)), 100, 32)
            for p, n, a in zip(place.tolist(), size.tolist(), key.tolist()):
                held.setdefault(a, set()).add((k, o.bytes[p : p + n + 99].tobytes()))
        largest[most] = max(sum(len(t) for _, t in v) for v in held.values())
    assert largest[3000] <= 3000 < 30_000 < largest[suffix_dedup.MOST]


def test_suffix_array_and_boundaries():
    r = np.random.default_rng(3)
    for _ in range(30):
        parts = [r.integers(1, r.integers(2, 5), r.integers(1, 60)) for _ in range(5)]
        text = np.concatenate([np.concatenate([p, [0]]) for p in parts]).astype(np.uint16)
        order = suffix_dedup.suffix_array(text, 9)
        cut = suffix_dedup.boundaries(text, order, 9)
        tails = [tuple(text[i : i + 9]) for i in order]
        tails = [t[: t.index(0)] + ("end", i) if 0 in t else t for t, i in zip(tails, order.tolist())]
        assert [a != b for a, b in zip(tails, tails[1:])] == cut[1:].tolist()


def test_window_dedup_matches_brute_force(spark):
    texts = mixed_texts(2)
    got = {r["doc_id"]: r for r in window_dedup.remove_repeated_windows(texts_frame(spark, texts)).collect()}
    for i, (words, gone) in enumerate(covered_words(texts, 35), 1):
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], bytes(got[i]["kept"]).decode()) == (len(words), int(gone.sum()), kept)
    assert window_dedup.remove_repeated_windows(texts_frame(spark, texts).limit(0)).count() == 0


def test_levels_double():
    assert window_dedup.levels(35) == [9, 18, 35]


def shingles(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = WORD.findall((text or "").translate(table))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(4)
    base = " ".join(f"t{r.randint(0, 500)}" for _ in range(120))
    cloud = []
    for _ in range(40):
        w = base.split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 9)}"
        cloud.append(" ".join(w))
    texts = mixed_texts(5, 80) + cloud
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {x["doc_id"]: x for x in near_dedup.near_duplicates(texts_frame(spark, texts)).collect()}
    for i, s in enumerate(sets):
        assert (got[i + 1]["n_shingles"], got[i + 1]["component_id"], got[i + 1]["kept"]) == (len(s), find(i) + 1, find(i) == i)


def test_near_duplicates_without_ids_and_without_rows(spark):
    frame = texts_frame(spark, ["one two three four five six"] * 2)
    assert near_dedup.near_duplicates(frame.limit(0)).count() == 0
    rows = near_dedup.near_duplicates(frame.selectExpr("if(doc_id = 1, null, doc_id) as doc_id", "text")).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in rows} == {(None, None, True), (2, 2, True)}


@pytest.mark.parametrize("size", [1, 4, 40, 800])
def test_registers_agree_as_often_as_sets_do(size):
    r = np.random.default_rng(size)
    shares = []
    for _ in range(20):
        items = r.integers(0, 2**63, size, dtype=np.uint64)
        part = items[: max(1, size * 3 // 4)]
        a, b = hyperminhash.registers(items), hyperminhash.registers(part)
        shares.append(hyperminhash.estimate(a[None], b[None])[0] - len(part) / size)
    assert abs(np.mean(shares)) < 0.03


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 100 for i in range(100, 120)}}


def test_near_duplicates_match_sql(spark):
    name = "op4_hyperminhash_near_dedup"
    df = QUERIES[name](spark, SMALL)
    assert compare(df, df.collect(), duck(SMALL), ORACLES[name]) == ""


def test_a_hot_key_sends_one_entry_per_chunk():
    keys, counts = chunks.distinct_keys(np.full(100_000, 12345678, np.uint64))
    table = chunks.key_rows(3, keys, counts, 64)
    assert table.num_rows == 1 and len(table.column("keys")[0].as_py()) == 8
    assert isinstance(table, pa.Table)


def test_queries_read_whole_tables(spark):
    for name, column in (("op1_suffix_array_dedup", "kept_sha256"), ("op8_window_doubling", "kept_sha256")):
        rows = QUERIES[name](spark, SMALL).collect()
        docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
        assert len(rows) == len(docs)
        ids = sorted(docs)
        texts = [docs[i] for i in ids]
        if name.startswith("op1"):
            want = [sha(np.frombuffer(t.encode(), np.uint8)[~g].tobytes()) for t, g in zip(texts, covered_bytes(texts, 100))]
        else:
            want = [sha(" ".join(w for w, x in zip(ws, g) if not x)) for ws, g in covered_words(texts, 35)]
        assert [r[column] for r in sorted(rows, key=lambda r: r["doc_id"])] == want


def test_shared_items_of_sets_range_by_range(monkeypatch):
    r = np.random.default_rng(0)
    sets = [np.sort(r.choice(5000, r.integers(1, 400), replace=False)).astype(np.uint64) * np.uint64(3_000_000_000_000_000) for _ in range(40)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    for items in (10**6, 500):
        monkeypatch.setattr(near_dedup, "ITEMS", items)
        apart = ~np.eye(len(sets), dtype=bool)
        assert (near_dedup._shared(sets, sets) == want)[apart].all()
        assert (near_dedup._shared(sets[:15], sets[15:]) == want[:15, 15:]).all()
