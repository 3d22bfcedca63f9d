"""Documents in chunks of a bounded size, and the exchange that tells which keys occur twice.

A chunk holds the documents whose id has one hash value, so it can be put together again at
any time. What the chunks tell each other is packed: one row carries all keys of a chunk that
belong to one bucket of keys, each key once however often it occurs in the chunk. A key with
a third of all occurrences therefore sends one entry per chunk.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 2_000_000
LEAST_CHUNKS = 64
BUCKET_CHUNKS = 2  # chunks per bucket of keys
NO_ID = -(1 << 63)  # stands for a null id and sorts before all others


@dataclass(frozen=True)
class Corpus:
    """Rows (chunk int, doc_id long, no_id boolean, data binary) and the number of chunks."""

    rows: DataFrame
    chunks: int

    @property
    def buckets(self) -> int:
        return max(LEAST_CHUNKS, self.chunks // BUCKET_CHUNKS)


def corpus(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, carry: tuple[str, ...] = ()) -> Corpus:
    """Chunks of documents (doc_id, text); null text is empty. The number of chunks follows the
    total size, which is one aggregate over the text column. Columns named in ``carry`` come
    along as a struct of that name."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(LEAST_CHUNKS, -(-total // chunk_bytes))
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("chunk"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"),
        *([F.struct(*carry).alias("carry")] if carry else []),
    )
    return Corpus(rows, count)


class Chunk:
    """One chunk's documents in the order of (doc_id, text), laid end to end.

    ``bytes`` holds all of them; document i is bytes[begin[i]:end[i]]. Rows that share an id
    count as one document in positions ("virtual start"), one text after the other, so that a
    byte's place is (doc_id, place - first[i])."""

    def __init__(self, table: pa.Table):
        data = table.column("data").to_pylist()
        ids = np.asarray(table.column("doc_id").to_numpy(), dtype=np.int64)
        order = self.order = sorted(range(len(data)), key=lambda i: (ids[i], data[i]))
        self.ids = ids[order]
        self.no_id = np.asarray(table.column("no_id").to_pylist(), dtype=bool)[order]
        self.data = [data[i] for i in order]
        sizes = np.array([len(d) for d in self.data], dtype=np.int64)
        self.end = np.cumsum(sizes)
        self.begin = self.end - sizes
        self.bytes = np.frombuffer(b"".join(self.data), dtype=np.uint8)
        if len(self.ids):
            new = np.concatenate([[True], self.ids[1:] != self.ids[:-1]])
            self.first = self.begin[np.flatnonzero(new)[np.cumsum(new) - 1]]
        else:
            self.first = self.begin

    def document_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, places, side="right")

    def places(self, doc_ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Places in the chunk of (doc_id, virtual start) pairs."""
        return self.begin[np.searchsorted(self.ids, doc_ids, side="left")] + starts


def packed(array: np.ndarray, dtype: str) -> bytes:
    return np.ascontiguousarray(array, dtype=dtype).tobytes()


def unpacked(value: bytes | None, dtype: str) -> np.ndarray:
    return np.frombuffer(value or b"", dtype=dtype)


KEY_SCHEMA = "bucket int, chunk int, keys binary"


def key_rows(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """Rows of KEY_SCHEMA for one chunk's distinct keys; the lowest bit of a key is given up to
    say whether it occurs more than once in this chunk."""
    keys = (keys & ~np.uint64(1)) | (counts > 1).astype(np.uint64)
    bucket = ((keys >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    keys, bucket = keys[order], bucket[order]
    numbers, starts = np.unique(bucket, return_index=True)
    return pa.table({
        "bucket": pa.array(numbers.astype(np.int32), pa.int32()),
        "chunk": pa.array(np.full(len(numbers), chunk, np.int32), pa.int32()),
        "keys": pa.array([k.tobytes() for k in np.split(keys, starts[1:])] if len(numbers) else [], pa.binary()),
    })


def distinct_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys without their lowest bit, and how often each occurs."""
    return np.unique(keys & ~np.uint64(1), return_counts=True)


def repeated(keys: DataFrame) -> DataFrame:
    """Of rows of KEY_SCHEMA, per chunk and bucket the keys that occur twice or more in the
    corpus: (chunk int, keys binary), sorted uint64 with the lowest bit off."""

    def of_bucket(table: pa.Table) -> pa.Table:
        rows = [unpacked(k, "u8") for k in table.column("keys").to_pylist()]
        every = np.concatenate(rows)
        values = every & ~np.uint64(1)
        order = np.argsort(values, kind="stable")
        values, multi = values[order], (every & np.uint64(1))[order] > 0
        start = np.concatenate([[True], values[1:] != values[:-1]])
        at = np.flatnonzero(start)
        twice = np.diff(np.concatenate([at, [len(values)]])) > 1
        twice |= np.add.reduceat(multi.astype(np.int64), at) > 0
        found = values[at[twice]]
        chunk, out = [], []
        for c, r in zip(table.column("chunk").to_pylist(), rows):
            r = np.sort(r & ~np.uint64(1))
            r = r[np.isin(r, found, assume_unique=True)]
            if len(r):
                chunk.append(c)
                out.append(r.tobytes())
        return pa.table({"chunk": pa.array(chunk, pa.int32()), "keys": pa.array(out, pa.binary())})

    return keys.groupBy("bucket").applyInArrow(of_bucket, "chunk int, keys binary")


def gathered(table: pa.Table) -> np.ndarray:
    """All keys of one chunk's rows from ``repeated``, sorted."""
    rows = [unpacked(k, "u8") for k in table.column("keys").to_pylist()]
    return np.sort(np.concatenate(rows)) if rows else np.empty(0, np.uint64)


def member(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``keys``; the lowest bit is not compared."""
    if not len(keys):
        return np.zeros(len(values), dtype=bool)
    values = values & ~np.uint64(1)
    at = np.searchsorted(keys, values)
    return keys[np.minimum(at, len(keys) - 1)] == values


BLOCK = 1 << 14  # elements that are worked on at a time, so that what lies between two steps stays in the cache


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values; one to one."""
    if x.ndim == 1 and len(x) > BLOCK:
        out = np.empty(len(x), np.uint64)
        for i in range(0, len(x), BLOCK):
            out[i : i + BLOCK] = mix(x[i : i + BLOCK])
        return out
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """pick over every ``width`` neighbours: result[i] covers values[i : i + width]."""
    least = max(BLOCK, width)
    if len(values) > 2 * least:
        out = np.empty(len(values) - width + 1, values.dtype)
        for i in range(0, len(out), least):
            out[i : i + least] = sliding(values[i : i + least + width - 1], width, pick)
        return out
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:]) if len(values) > size else values[:0]
        size *= 2
    rest = width - size
    return pick(values[: len(values) - rest], values[rest:]) if rest and len(values) > rest else values[: max(0, len(values) - rest)]


@lru_cache(maxsize=16)
def _powers(factor: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor, and of its inverse, modulo 2^64."""
    inverse = pow(factor, -1, 1 << 64)
    both = []
    for base in (factor, inverse):
        out = np.full(size, base, np.uint64)
        out[0] = 1
        both.append(np.multiply.accumulate(out))
    return both[0], both[1]


def rolling(values: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Polynomial hash of every ``width`` neighbours of uint64 values, by an odd factor: with the
    powers of its inverse, a difference of two running sums."""
    size = max(0, len(values) - width + 1)
    out = np.empty(size, np.uint64)
    up, down = _powers(factor, BLOCK + -(-width // BLOCK) * BLOCK)
    sums = np.zeros(min(BLOCK, size) + width, np.uint64)
    for i in range(0, size, BLOCK):
        n = min(BLOCK, size - i)
        part = values[i : i + n + width - 1]
        np.cumsum(part * down[: len(part)], out=sums[1 : len(part) + 1])
        np.subtract(sums[width : width + n], sums[:n], out=out[i : i + n])
        out[i : i + n] *= up[width - 1 : width - 1 + n]
    return out


FACTOR = 0x9E3779B97F4A7C15


def anchors(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, gram: int):
    """Windows of ``length`` symbols inside documents, and the smallest hash of the grams in each.

    For every place: the anchor of the window that starts there and whether one starts there at
    all; and the hash of the gram at every place. Equal windows have equal anchors."""
    grams = mix(rolling(symbols, gram, FACTOR))
    least = sliding(grams, length - gram + 1)
    return least, windows(len(symbols), begin, end, length)[: len(least)], grams


def windows(size: int, begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Whether a window of ``length`` symbols starts at each of ``size`` places."""
    edge = np.zeros(size + 1, dtype=np.int8)  # documents do not overlap, so the running sum is 0 or 1
    fits = end - begin >= length
    np.add.at(edge, begin[fits], 1)
    np.add.at(edge, end[fits] - length + 1, -1)
    return np.cumsum(edge[:size], dtype=np.int8) > 0


def anchor_keys(symbols, begin, end, length: int, gram: int, among: np.ndarray | None = None):
    """Distinct anchors of the windows (of those marked in ``among``), and the number of places
    at which each occurs as the smallest gram of such a window."""
    least, valid, grams = anchors(symbols, begin, end, length, gram)
    if among is not None:
        valid = valid & among[: len(valid)]
    return counted_anchors(least, valid, grams, length - gram + 1)


def counted_anchors(least: np.ndarray, valid: np.ndarray, grams: np.ndarray, width: int):
    """``anchor_keys`` of what ``anchors`` gives, for windows of ``width`` grams."""
    if not valid.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    pad = np.zeros(width - 1, np.uint64)
    highest = sliding(np.concatenate([pad, np.where(valid, least, np.uint64(0)), pad]), width, np.maximum)
    size = min(len(highest), len(grams))
    return distinct_keys(grams[:size][highest[:size] == grams[:size]])
