"""Removal of word windows that occur more than once, by level-wise doubling.

A window of 35 words can only repeat if the shorter windows inside it do. Level by level, at
9, 18 and 35 words, the corpus is asked which windows of that length repeat, and only windows
whose part repeated at one level are extended to twice that length at the next; a level without
survivors ends the search. On the way up one part speaks for each window, the one with the
smallest hash, so that equal windows ask about equal parts.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerflow.llm import chunks as c

WINDOW = 35
_SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_BYTES = [c.mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(1000 * k)) for k in (1, 2)]
_FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def levels(window: int, least: int = 8) -> list[int]:
    """Lengths that double up to ``window``: 9, 18, 35 for 35."""
    out = [window]
    while out[0] > 2 * least:
        out.insert(0, -(-out[0] // 2))
    return out


class Words:
    """The words of a chunk in order, as hashes. Document i has words begin[i]:end[i]."""

    def __init__(self, own: c.Chunk):
        self.own = own
        self.data, self.inside = own.bytes, ~_SPACE[own.bytes]
        first = self.inside.copy()
        first[1:] &= ~self.inside[:-1]
        opens = own.begin[own.begin < own.end]
        first[opens] = self.inside[opens]
        self.first = np.flatnonzero(first)
        self.begin = np.searchsorted(self.first, own.begin)
        self.end = np.searchsorted(self.first, own.end)

    def hashes(self, which: int) -> np.ndarray:
        """One of two independent 64-bit hashes of every word."""
        if not len(self.first):
            return np.empty(0, np.uint64)
        values = np.where(self.inside, _BYTES[which][self.data], np.uint64(0))[self.first[0] :]
        sizes = np.diff(np.concatenate([self.first, [len(self.data)]]))
        nth = np.arange(len(values)) - np.repeat(self.first - self.first[0], sizes)
        power = np.full(int(sizes.max()), _FACTORS[which], np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        return c.mix(np.add.reduceat(values * power[nth], self.first - self.first[0]))


def _survivors(words: Words, symbols: np.ndarray, window: int, gram: int, keys: np.ndarray) -> np.ndarray:
    """Windows whose part at the level ``gram`` is among the repeated keys."""
    least, valid, _ = c.anchors(symbols, words.begin, words.end, window, gram)
    out = np.zeros(len(symbols), dtype=bool)
    at = np.flatnonzero(valid)
    out[at] = c.member(keys, least[at])
    return out


def _whole(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the window at every word; short by the last few."""
    return tuple(c.mix(c.rolling(words.hashes(k), window, _FACTORS[k])) for k in (0, 1))


PAIR_SCHEMA = "bucket int, chunk int, keys binary, checks binary"


def _pair_rows(chunk: int, one: np.ndarray, two: np.ndarray, buckets: int) -> pa.Table:
    """A chunk's distinct windows as two hashes each; the lowest bit of the first is given up to
    say whether the window occurs more than once in the chunk."""
    one = one & ~np.uint64(1)
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.empty(0, bool)
    at = np.flatnonzero(new)
    multi = (np.diff(np.concatenate([at, [len(one)]])) > 1).astype(np.uint64)
    one, two = one[at] | multi, two[at]
    bucket = ((one >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    numbers, starts = np.unique(bucket[order], return_index=True)
    cut = lambda a: [x.tobytes() for x in np.split(a[order], starts[1:])] if len(numbers) else []
    return pa.table({
        "bucket": pa.array(numbers.astype(np.int32), pa.int32()), "chunk": pa.array(np.full(len(numbers), chunk, np.int32), pa.int32()),
        "keys": pa.array(cut(one), pa.binary()), "checks": pa.array(cut(two), pa.binary()),
    })


def _repeated_pairs(table: pa.Table) -> pa.Table:
    """One bucket: per chunk the first hashes of windows that occur twice or more in the corpus."""
    rows = [c.unpacked(k, "u8") for k in table.column("keys").to_pylist()]
    one, two = np.concatenate(rows), np.concatenate([c.unpacked(k, "u8") for k in table.column("checks").to_pylist()])
    value, multi = one & ~np.uint64(1), (one & np.uint64(1)).astype(np.int64)
    order = np.lexsort((two, value))
    v, w = value[order], two[order]
    at = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
    size = np.diff(np.concatenate([at, [len(v)]]))
    twice = (size > 1) | (np.add.reduceat(multi[order], at) > 0)
    hit = np.zeros(len(v), dtype=bool)
    hit[order] = np.repeat(twice, size)
    chunk, out, begin = [], [], 0
    for number, r in zip(table.column("chunk").to_pylist(), rows):
        some = value[begin : begin + len(r)][hit[begin : begin + len(r)]]
        begin += len(r)
        if len(some):
            chunk.append(number)
            out.append(np.unique(some).tobytes())
    return pa.table({"chunk": pa.array(chunk, pa.int32()), "keys": pa.array(out, pa.binary())})


RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, kept binary"


def _results(words: Words, repeated: np.ndarray, window: int) -> pa.Table:
    """``repeated``: whether the window that starts at each word repeats."""
    size = len(words.first)
    diff = np.zeros(size + 1, dtype=np.int32)
    at = np.flatnonzero(repeated)
    np.add.at(diff, at, 1)
    np.add.at(diff, at + window, -1)
    gone = np.cumsum(diff[:size]) > 0
    own, kept, removed = words.own, [], []
    for data, a, b in zip(own.data, words.begin.tolist(), words.end.tolist()):
        lost = gone[a:b]
        n = int(lost.sum())
        kept.append(b" ".join(compress(data.split(), (~lost).tolist()) if n else data.split()))
        removed.append(n)
    return pa.table({
        "doc_id": pa.array([None if n else int(i) for i, n in zip(own.ids, own.no_id)], pa.int64()),
        "n_words": pa.array(words.end - words.begin, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "kept": pa.array(kept, pa.binary()),
    })


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents (doc_id, text) without the words covered by a window of ``window`` consecutive
    words whose sequence also starts anywhere else in the corpus, the same document included.
    Words are separated by ASCII white space; windows stay within a document and are judged on
    the input; null text has no words.

    Returns a row per input row: doc_id, n_words, n_removed (long), kept (binary: the words
    left, joined by one space, UTF-8). Rows that share an id are separate documents. Other
    columns are not read. Windows are compared by two 64-bit hashes of their words.
    """
    own = c.corpus(docs)
    buckets, steps = own.buckets, levels(window)
    by_chunk = own.rows.groupBy("chunk")

    def first_level(table: pa.Table) -> pa.Table:
        words = Words(c.Chunk(table))
        found = c.anchor_keys(words.hashes(0), words.begin, words.end, window, steps[0])
        return c.key_rows(table.column("chunk")[0].as_py(), *found, buckets)

    def next_level(below: int, here: int):
        def keys(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return c.key_rows(0, np.empty(0, np.uint64), np.empty(0, np.int64), buckets)
            words = Words(c.Chunk(left))
            symbols = words.hashes(0)
            among = _survivors(words, symbols, window, below, c.gathered(right))
            found = c.anchor_keys(symbols, words.begin, words.end, window, here, among)
            return c.key_rows(left.column("chunk")[0].as_py(), *found, buckets)

        return keys

    def last_level(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _pair_rows(0, np.empty(0, np.uint64), np.empty(0, np.uint64), buckets)
        words = Words(c.Chunk(left))
        among = _survivors(words, words.hashes(0), window, steps[-2], c.gathered(right))
        one, two = _whole(words, window)
        at = np.flatnonzero(among[: len(one)])
        return _pair_rows(left.column("chunk")[0].as_py(), one[at], two[at], buckets)

    def results(left: pa.Table, right: pa.Table) -> pa.Table:
        words = Words(c.Chunk(left))
        keys = c.gathered(right)
        repeated = np.zeros(len(words.first), dtype=bool)
        if len(keys):
            one = c.mix(c.rolling(words.hashes(0), window, _FACTORS[0]))
            inside = np.flatnonzero(c.windows(len(words.first), words.begin, words.end, window)[: len(one)])
            repeated[inside] = c.member(keys, one[inside])
        return _results(words, repeated, window)

    found = c.repeated(by_chunk.applyInArrow(first_level, c.KEY_SCHEMA))
    for below, here in zip(steps, steps[1:-1]):
        found = c.repeated(by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(next_level(below, here), c.KEY_SCHEMA))
    pairs = by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(last_level, PAIR_SCHEMA)
    found = pairs.groupBy("bucket").applyInArrow(_repeated_pairs, "chunk int, keys binary")
    return by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(results, RESULT_SCHEMA)
