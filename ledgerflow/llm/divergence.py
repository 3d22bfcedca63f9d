"""How the sources of a language differ in their words: chi-square-like distances between every
two sources, and the terms that a source uses more than its language does. All arithmetic is exact."""

from __future__ import annotations

from collections import Counter
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.sources.readers import materialise

LEAST_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
BLOCK_TERMS = 1 << 13  # kept terms of a language in one array
TILE_SOURCES = 16  # sources on one side of a task of pairs
HELD = 400_000  # distinct (group, term) that a task holds before it passes them on
SLICE = 1 << 20
RUN = 256

LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs) of (text, lang, source); nulls are ''. Every group also
    has one row with the term '' and the count 0. Tasks count before anything is shuffled, so
    that a source with a third of all rows sends each of its terms once per task."""
    rows = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"),
    )
    parts = rows.mapInArrow(_counted, "lang string, source string, term binary, count long, docs long")
    return parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("count").alias("count"), F.sum("docs").alias("docs")
    )


def _words(data: bytes):
    """Lists of the words of a text; a long text comes in slices that end between words."""
    data = data.translate(LETTERS)
    start = 0
    while len(data) - start > SLICE:
        cut = data.find(b" ", start + SLICE)
        if cut < 0:
            break
        yield data[start:cut].split()
        start = cut
    yield (data[start:] if start else data).split()


def _counted(batches):
    held, size = {}, 0
    for batch in batches:
        for lang, source, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            count, docs = held.setdefault((lang, source), (Counter({b"": 0}), Counter()))
            size -= len(count)
            own = set()
            for words in _words(data):
                count.update(words)
                own.update(words)
            docs.update(own)
            size += len(count)
            if size > HELD:
                yield from _entries(held)
                held, size = {}, 0
    yield from _entries(held)


def _entries(held):
    for (lang, source), (count, docs) in held.items():
        n = len(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(count), pa.binary()),
                pa.array(list(count.values()), pa.int64()), pa.array([docs[t] for t in count], pa.int64()),
            ],
            ["lang", "source", "term", "count", "docs"],
        )


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact in decimals of 38 digits."""
    wide = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", wide, (total + terms).cast("decimal(20,0)"))


def audit(
    docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS, tile: int = TILE_SOURCES
) -> DataFrame:
    """(lang, source, part, item, value long, rank int) of documents (text, lang, source).

    Terms are runs of letters A-Z (lower-cased) and of characters beyond ASCII. A language keeps
    the terms in at least ``least_documents`` of its documents. Part ``pair`` has a row for every
    other source of the language, part ``term`` the ``top`` terms that the source uses more than
    its language. Ranks start at 1 for the largest value, ties go by the item's bytes.

    Null text, language and source are ''; documents without terms count as members of their
    group; a language that keeps no term has pairs of value 0; repeated rows are documents of
    their own; an empty table has no rows. Other columns are not read.

    Kept terms are dealt to blocks and numbered there, so that an array of (term id, count) has
    at most about ``block_terms`` entries whatever a source holds. A task takes the arrays of two
    bundles of sources for one block; each of its pairs is merged sparsely: the shorter array
    gallops through the longer one, and terms on both sides, on one side and on neither are
    priced both ways. Blocks add up.
    """
    counts = materialise(term_counts(docs))
    own = counts.filter(F.col("term") != "")
    kept = own.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all")).filter(F.col("docs") >= least_documents)
    kept = materialise(kept.select("lang", "term", "all"))
    most = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    block = F.pmod(F.xxhash64("term"), F.lit(max(1, -(-most // block_terms)))).cast("int")
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term"))
    kept = kept.withColumn("block", block).withColumn("id", place)
    uses = materialise(own.select("lang", "source", "term", "count").join(kept, ["lang", "term"]))

    sizes = kept.groupBy("lang", "block").agg(F.count("*").alias("width"), F.sum("all").alias("all"))
    totals = uses.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = counts.filter(F.col("term") == "").select("lang", "source")
    langs = sizes.groupBy("lang").agg(F.sum("width").alias("terms"), F.sum("all").alias("lang_total"))
    many = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    langs = many.join(langs, "lang", "left").fillna(0, ["terms", "lang_total"])
    groups = materialise(groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang"))
    sizes = groups.select("lang").distinct().join(sizes.select("lang", "block", "width"), "lang", "left").fillna(0, ["block", "width"])

    values = _pairs(groups, sizes, uses, tile).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = values.withColumn("rank", F.row_number().over(order))
    p = _share(F.col("count"), F.col("total"), F.col("terms"))
    q = _share(F.col("all"), F.col("lang_total"), F.col("terms"))
    terms = uses.join(groups, ["lang", "source"]).withColumn("p", p).withColumn("q", q).filter("p > q")
    terms = terms.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value")
    ).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.union(terms)


def _pairs(groups: DataFrame, sizes: DataFrame, uses: DataFrame, tile: int) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language."""
    arrays = uses.groupBy("lang", "source", "block").agg(F.array_sort(F.collect_list(F.struct("id", "count"))).alias("entries")).select(
        "lang", "source", "block", F.col("entries.id").alias("ids"), F.col("entries.count").alias("counts")
    )
    tiles = F.ceil(F.col("sources") / tile).cast("int")
    rows = groups.join(sizes, "lang").join(arrays, ["lang", "source", "block"], "left").withColumn("tiles", tiles)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    columns = ["lang", "block", "a", "b", "source", "total", "terms", "width", "ids", "counts"]
    left = rows.select("*", F.col("own").alias("a"), F.explode(F.sequence("own", F.col("tiles") - 1)).alias("b")).select(*columns)
    right = rows.filter("own > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("a"), F.col("own").alias("b")).select(*columns)
    left, right = left.toDF(*columns), right.toDF(*columns)
    keys = ["lang", "block", "a", "b"]
    priced = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_priced, "lang string, source string, item string, value long")
    return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / total) by long division in two steps, so that nothing
    exceeds 64 bits while totals stay below 9e13 (about 100 TB of words in one group)."""
    whole, rest = np.divmod(counts + 1, total)
    high, rest = np.divmod(rest * 100_000, total)
    return 1 + whole * SCALE + high * 10_000 + rest * 10_000 // total


def gallop(few: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the common members of two rising arrays. Runs of the shorter one look for their
    stretch of the longer one in doubling steps from where the last run ended."""
    here, there, at = [], [], 0
    for start in range(0, len(few), RUN):
        run = few[start : start + RUN]
        step = RUN
        while at + step < len(many) and many[at + step] < run[0]:
            at, step = at + step, 2 * step
        end, step = min(at + RUN, len(many)), RUN
        while end < len(many) and many[end - 1] < run[-1]:
            end, step = min(end + step, len(many)), 2 * step
        part = many[at:end]
        found = np.searchsorted(part, run)
        hit = np.flatnonzero(part[np.minimum(found, len(part) - 1)] == run) if len(part) else np.zeros(0, int)
        here.append(start + hit)
        there.append(at + found[hit])
        at = min(at + int(found[-1]), len(many))
    empty = [np.zeros(0, int)]
    return np.concatenate(here or empty), np.concatenate(there or empty)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Side:
    def __init__(self, source, total, terms, ids, counts):
        self.source = source
        self.ids = np.asarray([] if ids is None else ids, np.int64)
        self.p = shares(np.asarray([] if counts is None else counts, np.int64), total + terms) if terms else np.zeros(0, np.int64)
        self.absent = shares(np.zeros(1, np.int64), total + terms) if terms else np.ones(1, np.int64)


def _sides(table: pa.Table) -> list[_Side]:
    columns = [table.column(c).to_pylist() for c in ("source", "total", "terms")]
    return [
        _Side(s, n, v, ids.values.to_numpy() if ids.is_valid else None, counts.values.to_numpy() if counts.is_valid else None)
        for s, n, v, ids, counts in zip(*columns, table.column("ids"), table.column("counts"))
    ]


def merged(x: _Side, y: _Side, width: int) -> tuple[int, int]:
    """Distance of x from y and of y from x over the ``width`` kept terms of a block."""
    few, many = (x, y) if len(x.ids) <= len(y.ids) else (y, x)
    i, j = gallop(few.ids, many.ids)
    one = np.ones(len(few.ids), bool)
    one[i] = False
    other = np.ones(len(many.ids), bool)
    other[j] = False
    p, q = few.p, many.p
    neither = width - len(p) - len(q) + len(i)
    out = []
    for flip in (False, True):
        f = (lambda a, b: _distance(b, a)) if flip else _distance
        total = f(p[i], q[j]).sum() + f(p[one], many.absent).sum() + f(few.absent, q[other]).sum()
        out.append(int(total) + neither * int(f(few.absent, many.absent)[0]))
    return (out[0], out[1]) if few is x else (out[1], out[0])


def _priced(left: pa.Table, right: pa.Table) -> pa.Table:
    rows = []
    if left.num_rows:
        lang, width, a, b = (left.column(c)[0].as_py() for c in ("lang", "width", "a", "b"))
        ours = _sides(left)
        for x, y in combinations(ours, 2) if a == b else product(ours, _sides(right)):
            there, back = merged(x, y, width)
            rows += [(lang, x.source, y.source, there), (lang, y.source, x.source, back)]
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "source", "item", "value"])


SQL = f"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
    FROM documents
), words AS (
    SELECT d, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= {LEAST_DOCUMENTS}),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
groups AS (
    SELECT s.lang, s.source, coalesce(any_value(z.v), 0) AS v, coalesce(sum(c.c), 0)::HUGEINT AS n
    FROM sources s LEFT JOIN sizes z USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source GROUP BY s.lang, s.source
), dense AS (
    SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + ({SCALE} * (coalesce(c.c, 0) + 1)) // (g.n + g.v) AS p
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), whole AS (
    SELECT k.lang, k.term, 1 + ({SCALE} * (sum(c.c) + 1)::HUGEINT) // (any_value(n.n) + any_value(z.v)) AS q
    FROM kept k JOIN counts c USING (lang, term) JOIN sizes z ON z.lang = k.lang
    JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM groups GROUP BY lang) n ON n.lang = k.lang GROUP BY k.lang, k.term
), ranked AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT d.lang, d.source, 'term', d.term, (d.p - w.q) * (d.p - w.q) // w.q FROM dense d JOIN whole w USING (lang, term) WHERE d.c > 0 AND d.p > w.q
), numbered AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM ranked
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM numbered WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
