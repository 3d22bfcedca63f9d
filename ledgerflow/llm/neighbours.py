"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are scaled into the unit ball and given one more coordinate that puts them on the unit
sphere, so that the largest inner product is the smallest distance. Each table hashes them by
floor((a.x + b) / width) for a few Gaussian a. A query visits its own bucket and perturbed ones in
the order of their estimated success (the sum of squared distances to the buckets' boundaries),
until the visited buckets hold a given share of the rows. Rows lie in blocks of neighbouring
buckets; a block ranks exactly what a query visits in it and passes on its best only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerflow.sources.readers import materialise

RESULT = "query_id long, rank int, vec_id long, score double"
TABLES, FUNCTIONS, WIDTH = 3, 3, 1.0
SHARE = 0.45  # of the rows that a query's buckets in one table hold
LEAST_ROWS = 400  # visited at least, if there are as many
BLOCK_ROWS = 4096
QUERY_ROWS = 16_384
LEAST_GROUPS = 24
_SLACK = 1e-9


@dataclass(frozen=True)
class Hashing:
    """The drawn functions: the same for a dimension and seed, wherever they are made."""

    dimension: int
    scale: float
    tables: int = TABLES
    functions: int = FUNCTIONS
    width: float = WIDTH
    seed: int = 20_240_601

    def draw(self) -> tuple[np.ndarray, np.ndarray]:
        random = np.random.default_rng([self.seed, self.dimension])
        a = random.normal(size=(self.tables * self.functions, self.dimension + 1))
        return a, random.uniform(0, self.width, size=self.tables * self.functions)

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(a.x + b) / width of vectors: rows x tables x functions. Queries have length 1."""
        a, b = self.draw()
        if query:
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            last = np.zeros(len(x))
        else:
            x = x / self.scale
            last = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
        return ((np.column_stack([x, last]) @ a.T + b) / self.width).reshape(len(x), self.tables, self.functions)


def _usable(vectors: DataFrame) -> DataFrame:
    """(id long, v array<double>) of rows whose id is known and whose vector is finite, without
    null components and not zero."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))


def nearest(queries: DataFrame, rows: DataFrame, k: int = 20, share: float = SHARE) -> DataFrame:
    """The k rows with the largest inner product found for each query.

    Both inputs are (id long, v array of numbers); a query's own id is no candidate. Returns
    query_id long, rank int from 1, vec_id long, score double (exact, in double precision), ties
    to the smaller id. Vectors that are null, zero, or hold null or non-finite components take no
    part; queries meet rows of their own dimension only, and every dimension is searched on its
    own. Of rows with equal vectors the k + 1 smallest different ids are candidates, which is all
    a result can hold. An id that repeats counts once per different vector.

    Read by the driver: counts, the largest length, and the bucket directory, which the unit
    ball bounds whatever the number of rows.
    """
    rows = _usable(rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")))
    queries = _usable(queries.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")))
    spark = rows.sparkSession
    sizes = [r["d"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").collect()]
    if not sizes:
        return spark.createDataFrame([], RESULT)
    equal = Window.partitionBy(F.xxhash64("v"), F.xxhash64(F.reverse("v"))).orderBy("id")
    nth, repeated = F.dense_rank().over(equal), F.coalesce(F.lag("id").over(equal) == F.col("id"), F.lit(False))
    rows = materialise(rows.withColumn("nth", nth).withColumn("repeated", repeated).filter((F.col("nth") <= k + 1) & ~F.col("repeated")).drop("nth", "repeated"))
    found = [_nearest(rows.filter(F.size("v") == d), queries.filter(F.size("v") == d), d, k, share) for d in sizes]
    return reduce(DataFrame.union, found)


def _nearest(rows: DataFrame, queries: DataFrame, dimension: int, k: int, share: float) -> DataFrame:
    """The search among vectors of one dimension."""
    count, scale = rows.agg(
        F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    ).first()
    how = Hashing(dimension, float(scale))
    number = queries.count()
    groups = max(1, -(-number // QUERY_ROWS))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                keys = np.floor(how.places(np.stack(b["v"].to_numpy()), False)).astype(np.int64)
                for t in range(how.tables):
                    yield pd.DataFrame({"t": t, "key": [list(x) for x in keys[:, t]], "id": b["id"], "v": b["v"]})

    points = rows.mapInPandas(hashed, "t int, key array<long>, id long, v array<double>")
    directory = [
        (r["t"], tuple(r["key"]), r["n"])
        for r in points.groupBy("t", "key").agg(F.count("*").alias("n")).collect()
    ]
    plan = _blocks(directory)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spot = {(t, key): (first, parts, i) for t, key, first, parts, i in plan["buckets"]}
        for b in batches:
            if not len(b):
                continue
            places = how.places(np.stack(b["v"].to_numpy()), False)
            for t in range(how.tables):
                found = [spot[t, tuple(x)] for x in np.floor(places[:, t]).astype(np.int64).tolist()]
                first, parts, bucket = (np.array(x) for x in zip(*found))
                block = first + (b["id"].to_numpy() % 1_000_003) % parts
                yield pd.DataFrame({"block": block, "bucket": bucket, "id": b["id"], "v": b["v"]})

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            places = how.places(np.stack(b["v"].to_numpy()), True)
            for t in range(how.tables):
                for block, row, buckets in _visits(places[:, t], plan, t, share * count, min(count, LEAST_ROWS)):
                    yield pd.DataFrame({"block": block, "buckets": buckets, "id": b["id"].to_numpy()[row], "v": b["v"].to_numpy()[row]})

    def ranked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _best(left, right, k)

    point_rows = rows.mapInPandas(placed, "block long, bucket long, id long, v array<double>")
    point_rows = point_rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    query_rows = queries.mapInPandas(asked, "block long, buckets binary, id long, v array<double>").withColumn(
        "g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    )
    found = query_rows.groupBy("block", "g").cogroup(point_rows.groupBy("block", "g")).applyInPandas(
        ranked, "query_id long, vec_id array<long>, score array<double>"
    )
    own = found.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(max(LEAST_GROUPS, number // 500))))
    return own.groupBy("g").applyInPandas(lambda t: _merged(t, k), RESULT)


def _merged(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of some queries: the best k of what their blocks and tables passed on, each row once."""
    sizes = found["vec_id"].map(len)
    query = np.repeat(found["query_id"].to_numpy(), sizes)
    row, score = np.concatenate(found["vec_id"].to_list()), np.concatenate(found["score"].to_list())
    order = np.lexsort((row, -score, query))
    query, row, score = query[order], row[order], score[order]
    new = np.concatenate([[True], (query[1:] != query[:-1]) | (row[1:] != row[:-1]) | (score[1:] != score[:-1])])
    query, row, score = query[new], row[new], score[new]
    first = np.concatenate([[True], query[1:] != query[:-1]])
    rank = np.arange(len(query)) - np.flatnonzero(first)[np.cumsum(first) - 1] + 1
    best = rank <= k
    return pd.DataFrame({"query_id": query[best], "rank": rank[best], "vec_id": row[best], "score": score[best]})


def _blocks(directory: list[tuple[int, tuple[int, ...], int]]) -> dict:
    """Buckets of each table in key order, laid into blocks of about BLOCK_ROWS rows; a larger
    bucket gets blocks of its own. buckets: (table, key, first block, its blocks, number)."""
    buckets, block, filled, table = [], -1, 0, None
    for i, (t, key, n) in enumerate(sorted(directory)):
        parts = max(1, -(-n // BLOCK_ROWS))
        if t != table or parts > 1 or filled + n > BLOCK_ROWS:
            block, filled, table = block + 1, 0, t
        buckets.append((t, key, block, parts, i))
        filled += n
        if parts > 1:
            block, filled = block + parts - 1, BLOCK_ROWS
    sizes = [n for _, _, n in sorted(directory)]
    return {"buckets": buckets, "sizes": sizes}


def _visits(places: np.ndarray, plan: dict, table: int, rows: float, least: int):
    """(block, query indexes, their visited buckets as packed bits over all numbers) for the
    buckets each query visits: best estimated success first, until they hold enough rows."""
    own = [b for b in plan["buckets"] if b[0] == table]
    keys = np.array([b[1] for b in own])
    first, parts, numbers = (np.array([b[i] for b in own]) for i in (2, 3, 4))
    sizes = np.array(plan["sizes"])[numbers]
    total = len(plan["buckets"])
    below = keys[None, :, :] - places[:, None, :]
    away = np.maximum(np.maximum(below, -below - 1), 0.0)
    order = np.argsort((away**2).sum(axis=2), axis=1, kind="stable")
    before = np.cumsum(sizes[order], axis=1) - sizes[order]
    taken = np.zeros(order.shape, dtype=bool)
    np.put_along_axis(taken, order, before < max(rows, least), axis=1)
    bits = np.zeros((len(places), total), dtype=np.uint8)
    bits[:, numbers] = taken
    packed = [r.tobytes() for r in np.packbits(bits, axis=1)]
    for block in range(int(first[0]), int((first + parts).max())):
        inside = (first <= block) & (block < first + parts)
        row = np.flatnonzero(taken[:, inside].any(axis=1))
        if len(row):
            yield block, row, [packed[i] for i in row]


def _best(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of one block: each query's best k among the rows in buckets that it visits."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(left) and len(right):
        x, ids, bucket = np.stack(right["v"].to_numpy()), right["id"].to_numpy(), right["bucket"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        x, ids, bucket = x[by_id], ids[by_id], bucket[by_id]
        columns = x.T.copy()
        for a in range(0, len(left), 256):
            part = left.iloc[a : a + 256]
            q = np.stack(part["v"].to_numpy())
            bits = np.unpackbits(np.frombuffer(b"".join(part["buckets"]), np.uint8).reshape(len(part), -1), axis=1)
            rough = q @ columns
            rough[bits[:, bucket] == 0] = -np.inf
            rough[part["id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
            if len(ids) > k:
                border = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
            else:
                border = np.full(len(part), -np.inf)
            for i, number in enumerate(part["id"]):
                slack = _SLACK * max(1.0, abs(border[i])) if np.isfinite(border[i]) else 0.0
                some = np.flatnonzero((rough[i] >= border[i] - slack) & (rough[i] > -np.inf))
                if not len(some):
                    continue
                exact = np.zeros(len(some))
                for d in range(len(columns)):  # one order of additions, so that equal vectors tie
                    exact += q[i, d] * columns[d, some]
                best = np.lexsort((ids[some], -exact))[:k]
                out["query_id"].append(number)
                out["vec_id"].append(ids[some][best])
                out["score"].append(exact[best])
    return pd.DataFrame(out, dtype=object)
