"""The audit of sources against a plain version, with tiny blocks and tiles, and its merge."""

import re
from collections import Counter

import numpy as np
import pytest
from helpers import SMALL

import __spark_entry__ as entry
from ledgerflow.llm import divergence
from ledgerflow.llm.queries import documents

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    docs = [(l or "", s or "", [w.translate(LOWER) for w in TERM.findall(t or "")]) for t, l, s in rows]
    out = []
    for lang in {l for l, _, _ in docs}:
        seen = Counter(w for l, _, words in docs if l == lang for w in set(words))
        kept = sorted(w for w, n in seen.items() if n >= 3)
        groups = {s: Counter(w for l, g, words in docs if (l, g) == (lang, s) for w in words if w in set(kept)) for s in {s for l, s, _ in docs if l == lang}}

        def p(c):
            n = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept}

        whole = p(sum(groups.values(), Counter()))
        shares = {s: p(c) for s, c in groups.items()}
        for s, c in groups.items():
            f = lambda x, q: (x - q) * (x - q) // q
            pairs = [(o, sum(f(shares[s][w], shares[o][w]) for w in kept)) for o in groups if o != s]
            terms = [(w, f(shares[s][w], whole[w])) for w in kept if c[w] and shares[s][w] > whole[w]]
            for part, items in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[1], x[0].encode()))[:200])):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, r) for r, (item, v) in enumerate(items, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def odd_rows():
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)] + ["É", "é", "漢字", "😀x", "ABC", "abc", "a1b"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 40))), l, f"s{rng.integers(0, 7)}") for l in ("en", "fr", None) for _ in range(60)]
    rows += [(None, "en", "empty"), ("", "en", None), ("12 34 ...", "xx", "a"), ("only once", "xx", "b"), (None, None, None)]
    rows += [("same words here", "yy", "one")] * 4 + [("long " * 400_000 + "tail", "yy", "two")]
    return rows


@pytest.mark.parametrize("block,tile", [(1 << 16, 16), (8, 2)])
def test_equals_plain_version(spark, block, tile):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "text string, lang string, source string, term int, count double, ids string").repartition(5)
    assert got(divergence.audit(frame, block_terms=block, tile=tile)) == plain(rows)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "text string, lang string, source string")
    out = divergence.audit(frame)
    assert out.count() == 0 and [t for _, t in out.dtypes] == ["string", "string", "string", "string", "bigint", "int"]


def test_query_on_whole_table(spark):
    rows = [tuple(r) for r in documents(spark, SMALL).select("text", "lang", "source").collect()]
    assert got(entry.queries()["op13_source_divergence_audit"](spark, SMALL)) == plain(rows)


def test_tasks_pass_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 10)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 40), pa.array(["s", "t"] * 20), pa.array([f"a{chr(97 + i % 26)} b c".encode() for i in range(40)])], ["l", "s", "d"])
    total = Counter()
    parts = list(divergence._counted([batch]))
    for part in parts:
        for _, s, t, c, _ in zip(*(part.column(i).to_pylist() for i in range(5))):
            total[s, t] += c
    assert len(parts) > 2 and total["s", b"b"] == 20 and total["t", b"c"] == 20 and total["s", b""] == 0


def test_gallop():
    rng = np.random.default_rng(1)
    for n, m in [(0, 0), (0, 9), (1, 5000), (300, 20_000), (2000, 2500), (700, 700)]:
        a, b = (np.sort(rng.choice(40_000, k, replace=False)) for k in (n, m))
        i, j = divergence.gallop(a, b)
        assert (a[i] == b[j]).all() and len(i) == len(np.intersect1d(a, b))


def test_shares_are_exact():
    for total in (1, 7, 10**9 + 7, 8 * 10**13):
        counts = np.array([0, 1, 5, total // 3, total - 1])
        assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]
