"""Groups of near-duplicate documents: HyperMinHash candidates, confirmed on full shingle sets.

Equal sets are one class from the start. The smallest document of each class is banded; members
of a bucket are compared by their registers where the bucket is, and a forest of the likeliest
candidate links, no more than one per member, joins them to clusters. Any two documents that a
bucket holds and the registers think may be alike are in one cluster. The full sets of a cluster
then meet, large clusters in pairs of blocks, and every pair in it is decided exactly; only
links that join what was apart are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.llm import chunks as c
from ledgerflow.llm import hyperminhash as h
from ledgerflow.llm import members as m
from ledgerflow.llm import memory
from ledgerflow.llm.components import components
from ledgerflow.llm.window_dedup import Words
from ledgerflow.sources.readers import materialise

SHARE = (75, 100)  # linked with SHARE[1] * intersection >= SHARE[0] * union
MARGIN = 0.16  # five standard deviations of the estimate at 0.75 with 192 registers
BLOCK = 1024  # members of a bucket in one block
SETS = 512  # documents of a cluster in one block
SLAB = 2048  # items compared at once
ITEMS = 1_000_000  # of the sets of two blocks, looked at together
GROUP_ROWS = 20_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sets(table: pa.Table) -> tuple[c.Chunk, list[np.ndarray]]:
    """Documents of a chunk and their sorted shingle hashes."""
    own = c.Chunk(table)
    words = Words(own)
    words.data = _LOWER[own.bytes]
    hashes = words.hashes(0)
    return own, [h.shingle_hashes(hashes[a:b]) for a, b in zip(words.begin.tolist(), words.end.tolist())]


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    mixed = c.mix(shingles ^ np.uint64(0x1234567))
    return int(shingles.sum(dtype=np.uint64).astype(np.int64)), int(mixed.sum(dtype=np.uint64).astype(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles long, k1 long, k2 long, registers binary) of rows of documents; k1 and
    k2 tell sets apart; registers are null for documents without words."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(c.NO_ID)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"),
    )

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.enter("near_dedup")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own, sets = _sets(pa.Table.from_batches([batch.slice(at, 512)]))
                digests = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([None if n else int(i) for i, n in zip(own.ids, own.no_id)], pa.int64()),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "k1": pa.array([d[0] for d in digests], pa.int64()), "k2": pa.array([d[1] for d in digests], pa.int64()),
                    "registers": pa.array([h.registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                })

    return rows.mapInArrow(signed, "doc_id long, n_shingles long, k1 long, k2 long, registers binary")


def _banded(reps: DataFrame) -> DataFrame:
    """(key long, rep long) for every band of every class; the key holds the band's registers."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.enter("near_dedup")
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                own = np.frombuffer(b"".join(part.column("registers").to_pylist()), "<u2").reshape(part.num_rows, -1)
                words = own.reshape(part.num_rows, -1, h.BAND).astype(np.uint64)
                key = np.broadcast_to(np.arange(words.shape[1], dtype=np.uint64), words.shape[:2])
                for i in range(h.BAND):
                    key = c.mix(key * np.uint64(c.FACTOR) + words[:, :, i])
                ids = np.repeat(np.asarray(part.column("rep")), words.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)), pa.array(ids)], ["key", "rep"])

    return reps.select("rep", "registers").mapInArrow(bands, "key long, rep long")


def _candidates(members: DataFrame, least: float) -> DataFrame:
    """Of members (key, rep, many, registers, n) of buckets: per block of a bucket a forest (a, b),
    a < b, of the likeliest pairs among those whose estimate reaches ``least``."""
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    count = own.count()
    own = own.withColumn("g", F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(12, -(-count // GROUP_ROWS)))).cast("int"))

    def pairs(table: pa.Table) -> pa.Table:
        memory.enter("near_dedup")
        memory.give_back()
        key, i, j, block = (np.asarray(table.column(n)) for n in ("key", "i", "j", "block"))
        rep, n = (np.asarray(table.column(x)) for x in ("rep", "n"))
        registers = np.frombuffer(b"".join(table.column("registers").to_pylist()), "<u2").reshape(len(rep), -1)
        order = np.lexsort((rep, j, i, key))
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0), [True]]))
        sizes, out_a, out_b = np.diff(edge), [], []

        def alike(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            near = (n[x] * SHARE[1] >= n[y] * SHARE[0]) & (n[y] * SHARE[1] >= n[x] * SHARE[0])
            x, y = x[near], y[near]
            score = np.empty(len(x))
            for at in range(0, len(x), 50_000):
                score[at : at + 50_000] = h.estimate(registers[x[at : at + 50_000]], registers[y[at : at + 50_000]])
            some = score >= least
            return x[some], y[some], score[some]

        two = edge[:-1][sizes == 2]
        x, y, _ = alike(order[two], order[two + 1])
        cross = (i[x] == j[x]) | (block[x] != block[y])
        out_a.append(rep[x[cross]])
        out_b.append(rep[y[cross]])
        for a, size in zip(edge[:-1][sizes > 2], sizes[sizes > 2]):
            own = order[a : a + size]
            x, y, score = [], [], []
            for r in range(0, size - 1, 128):
                u, v = np.meshgrid(np.arange(r, min(r + 128, size - 1)), np.arange(r + 1, size), indexing="ij")
                upper = v > u
                u, v = own[u[upper]], own[v[upper]]
                if i[own[0]] != j[own[0]]:
                    u, v = u[block[u] != block[v]], v[block[u] != block[v]]
                u, v, s = alike(u, v)
                x.append(u)
                y.append(v)
                score.append(s)
            x, y, score = np.concatenate(x), np.concatenate(y), np.concatenate(score)
            x, y = _forest(x, y, score, rep)
            out_a.append(rep[x])
            out_b.append(rep[y])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})

    return own.groupBy("g").applyInArrow(pairs, "a long, b long").distinct()


def _forest(x: np.ndarray, y: np.ndarray, score: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest pairs that join all that can be joined, none more."""
    order = np.lexsort((rep[y], rep[x], -score))
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    keep = []
    for k in order.tolist():
        u, v = find(int(x[k])), find(int(y[k]))
        if u != v:
            root[u] = v
            keep.append(k)
    return x[keep], y[keep]


def _shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many items every set of ``one`` shares with every set of ``two``; sets are sorted. Items
    are counted range by range of their values, so that long sets take no more memory."""
    parts = -(-sum(len(x) for sets in ({id(one): one, id(two): two}).values() for x in sets) // ITEMS)
    if parts <= 1:
        return _shared_part(one, two)
    steps = [np.uint64((k << 64) // parts) for k in range(1, parts)]
    cut = lambda sets: [np.concatenate([[0], np.searchsorted(x, steps), [len(x)]]) for x in sets]
    ends, other = cut(one), None if one is two else cut(two)
    out = np.zeros((len(one), len(two)), dtype=np.float32)
    for k in range(parts):
        left = [x[e[k] : e[k + 1]] for x, e in zip(one, ends)]
        out += _shared_part(left, left if other is None else [x[e[k] : e[k + 1]] for x, e in zip(two, other)])
    return out


def _shared_part(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(one), len(two)), dtype=np.float32)
    values = np.intersect1d(np.concatenate(one), np.concatenate(two)) if one is not two else None
    if values is None:
        values, count = np.unique(np.concatenate(one), return_counts=True)
        values = values[count > 1]
    sides = []
    for sets in (one,) if one is two else (one, two):
        item, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        column = np.minimum(np.searchsorted(values, item), max(0, len(values) - 1))
        known = values[column] == item if len(values) else np.zeros(len(item), dtype=bool)
        column, row = column[known], row[known]
        order = np.argsort(column, kind="stable")
        sides.append((column[order], row[order], len(sets)))
    for at in range(0, len(values), SLAB):
        slabs = []
        for column, row, size in sides:
            a, b = np.searchsorted(column, [at, at + SLAB])
            slab = np.zeros((size, min(SLAB, len(values) - at)), dtype=np.float32)
            slab[row[a:b], column[a:b] - at] = 1
            slabs.append(slab)
        out += slabs[0] @ slabs[-1].T
    return out


def _linked(table: pa.Table) -> pa.Table:
    """Links (a, b) among the documents of each (cluster, i, j): a spanning forest of all pairs
    of block i and block j that are alike on their full sets."""
    memory.enter("near_dedup")
    memory.give_back()
    cluster, i, j, block, rep = (np.asarray(table.column(n)) for n in ("cluster", "i", "j", "block", "rep"))
    items = table.column("items").combine_chunks()
    _, ends, data = items.buffers()
    ends = np.frombuffer(ends, np.int32)[items.offset : items.offset + len(items) + 1] // 8
    data = np.frombuffer(data or b"", np.uint64)
    order = np.lexsort((rep, block, j, i, cluster))
    new = (np.diff(cluster[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
    out: list[tuple[int, int]] = []
    for own in np.split(order, np.flatnonzero(new) + 1):
        own = own[np.concatenate([[True], np.diff(rep[own]) != 0])]
        sets = [data[ends[k] : ends[k + 1]] for k in own]
        size = np.array([len(x) for x in sets], dtype=np.float64)
        left = np.flatnonzero(block[own] == i[own])
        right = np.flatnonzero(block[own] == j[own])
        alike = np.zeros((len(own), len(own)), dtype=bool)
        if i[own[0]] == j[own[0]]:
            shared, both = _shared(sets, sets), np.arange(len(own))
            left = right = both
        elif len(left) and len(right):
            shared = _shared([sets[k] for k in left], [sets[k] for k in right])
        else:
            continue
        union = size[left][:, None] + size[right][None, :] - shared
        hit = SHARE[1] * shared >= SHARE[0] * union
        alike[np.ix_(left, right)] = hit
        alike |= alike.T
        np.fill_diagonal(alike, False)
        apart = np.ones(len(own), dtype=bool)
        for root in range(len(own)):
            queue = [root] if apart[root] else []
            apart[root] = False
            while queue:
                x = queue.pop()
                found = np.flatnonzero(alike[x] & apart)
                apart[found] = False
                queue += found.tolist()
                out += [(int(rep[own[x]]), int(rep[own[y]])) for y in found]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _confirmed(clusters: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that are exact, enough to join all that is alike within each cluster
    (node, component) of document ids. A cluster's sets meet in blocks of SETS."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / SETS).cast("int")
    placed = clusters.join(sizes, "component").select(F.col("node").alias("rep"), F.col("component").alias("cluster"), blocks.alias("blocks"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = materialise(placed)
    rows = placed.agg(F.sum("blocks")).first()[0] or 0
    ids = placed.select(F.col("rep").alias("doc_id"))
    # the few sets of other documents go in the join, so no text is exchanged
    some = m.marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids).filter("maybe")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.enter("near_dedup")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own, found = _sets(pa.Table.from_batches([batch.slice(at, 512)]))
                yield pa.RecordBatch.from_arrays([pa.array(own.ids), pa.array([x.tobytes() for x in found], pa.binary())], ["rep", "items"])

    data = some.select("doc_id", F.lit(False).alias("no_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    whole = data.mapInArrow(sets, "rep long, items binary").join(placed, "rep")
    whole = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    whole = whole.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    group = F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(max(48, -(-rows // SETS)))).cast("int")
    return whole.withColumn("g", group).groupBy("g").applyInArrow(_linked, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Groups of documents (doc_id, text) whose sets of five-word shingles share three quarters.

    Words are runs without ASCII white space, A-Z lower-cased. Returns a row per input row:
    doc_id, n_shingles (long, size of the set; fewer than five words are one shingle, no word
    none), component_id (the smallest doc_id that links reach), kept (doc_id = component_id).
    Documents without words are linked with nothing. Rows without an id are linked with nothing
    and kept, their component is null. Rows that share an id are taken as one if their texts
    agree; otherwise which of them stands for the id is not defined. Sets are compared as sets
    of 64-bit hashes. A link at 0.75 goes unseen by all 48 bands with a chance of 1e-8.
    """
    signed = materialise(signatures(docs))
    known = signed.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    # registers are exchanged once: an id that stands for several classes is settled before
    single = classes.groupBy("rep").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2", "rep")
    first = known.withColumnRenamed("doc_id", "rep").join(single, ["k1", "k2", "rep"]).dropDuplicates(["k1", "k2", "rep"])
    reps = materialise(first.select("rep", F.col("n_shingles").alias("n"), "registers"))
    together = Window.partitionBy("key")
    shared = _banded(reps).withColumn("many", F.count("*").over(together)).filter(F.col("many") > 1)
    shared = materialise(shared)
    members = shared.join(reps, "rep")
    least = SHARE[0] / SHARE[1] - MARGIN
    candidates = materialise(_candidates(members, least))
    clusters = materialise(components(candidates))
    groups = components(materialise(_confirmed(clusters, docs)))
    out = signed.join(classes, ["k1", "k2"], "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    some = F.col("n_shingles") > 0
    component = F.when(some & F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


#: The same groups by comparing all pairs that share a shingle; for small tables.
SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, p.n, q.n
    HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r LEFT JOIN sizes z ON z.doc_id = r.doc_id GROUP BY r.doc_id
"""
