"""Packing of token sequences: cutting documents into pieces and filling fixed-size sequences.

Pieces are dealt by a hash to shards of a bounded number of tokens, and each shard is packed
by bin completion: the largest piece left opens a sequence, its undominated fillings are
enumerated best fit first, and a depth-first search over them is cut by the waste that a
better packing than the incumbent may still have. Sequences that stay visibly unfilled are
taken up again together with those of other shards.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import memory
from ledgerflow.sources.readers import materialise

SHARD_TOKENS = 16_000_000
OPEN_WASTE = 32  # a sequence with more room than this is packed again
REGROUP = 64  # shards whose open sequences meet in one task
SEARCH_NODES = 20_000  # nodes of the search beyond one per sequence

# --- token ids ---------------------------------------------------------------------------

#: Texts of these characters alone are cut into words here; others go to the tokenizer whole.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ɏ]")
_LETTERS = "a-zA-Zªµºß-öø-ɏÀ-ÖØ-Þ"
_NUMBERS = "0-9²³¹¼½¾"
_WORDS = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_NUMBERS}]|[^ \t\n\r{_LETTERS}{_NUMBERS}]+")
CACHE_WORDS = 300_000
TEXTS = 256  # texts cut into words at once


class WordTokenizer:
    """Ids by a word-level BPE of the tokenizers library. Words are cut here, and each distinct
    one is encoded once; new words of several texts go to the library together."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model for words that are cut and lower-cased already, joined by spaces.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.normalizer = normalizers.Sequence([])
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.cache: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def encode(self, text: str, words: bool = False) -> np.ndarray:
        own = self.of_words if words else self.tokenizer
        return np.array(own.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Of each text the little-endian unsigned 32-bit ids, one after the other."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        words = [None if not t or "<|" in t or _OTHER.search(t) else _WORDS.findall(t.lower()) for t in texts]
        self.learn(set().union(*[own for own in words if own]) - self.cache.keys())
        known = self.cache.__getitem__
        return [
            b"" if not t else self.encode(t).tobytes() if own is None else b"".join(map(known, own))
            for t, own in zip(texts, words)
        ]

    def learn(self, new: set[str]) -> None:
        words = list(new)
        ids = self.encode(" ".join(words), True) if words else np.empty(0, "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) == len(words):
            data, edge = ids.tobytes(), [0, *(4 * last).tolist()]
            self.cache.update(zip(words, [data[a:b] for a, b in zip(edge, edge[1:])]))
        else:  # words that don't end in an id of their own
            self.cache.update((w, self.encode(w).tobytes()) for w in words)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


memory.keeps("packing", _tokenizer.cache_clear)


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int | None = 1,
               keep_ids: bool = True) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids_crc32 long[, ids array<int>]) of documents
    (doc_id, text): ids of the whole text and ``end_id``, cut every ``capacity`` ids. Null text
    is empty; a document without any id has no piece. The tokenizer file is at the same path on
    every executor."""
    ids = ",ids:array<int>" if keep_ids else ""

    @F.pandas_udf(f"array<struct<piece:int,start:long,length:long,ids_crc32:long{ids}>>")
    def pieces(texts: pd.Series) -> pd.Series:
        memory.enter("packing")
        own, out, step = _tokenizer(tokenizer_path), [], 4 * capacity
        tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for ids in (x for at in range(0, len(texts), TEXTS) for x in own.ids(texts[at : at + TEXTS].tolist())):
            data, row = ids + tail, []
            for k, at in enumerate(range(0, len(data), step)):
                part = data[at : at + step]
                row.append({"piece": k, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)})
                if keep_ids:
                    row[-1]["ids"] = np.frombuffer(part, "<u4").astype("i4")
            out.append(row)
        return pd.Series(out)

    # the outer form, as the plain one would have the function evaluated once more for a filter
    rows = docs.select("doc_id", pieces("text").alias("p")).select("doc_id", F.explode_outer("p").alias("p"))
    return rows.filter(F.col("p").isNotNull()).select("doc_id", "p.*")


# --- bin completion ----------------------------------------------------------------------


class _Stock:
    """Counts of the lengths still to be placed; ``below[v]`` is the largest one up to v."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
        self.places = np.arange(capacity + 1)
        self.refresh()

    def refresh(self) -> None:
        self.below = np.maximum.accumulate(np.where(self.count > 0, self.places, 0))

    def take(self, filling: tuple[int, ...], sign: int = -1) -> None:
        stale = False
        for x in filling:
            self.count[x] += sign
            stale |= self.count[x] == 0 or (sign == 1 and self.count[x] == 1)
        if stale:
            self.refresh()

    def has(self, filling: tuple[int, ...]) -> bool:
        return all(self.count[x] >= filling.count(x) for x in filling)


def _pairs(stock: _Stock, room: int, most: int) -> list[tuple[int, int]]:
    """Two lengths that fill ``room``, least waste first, the larger ones first among equals."""
    x = np.arange(most, room // 2, -1) if most > room // 2 else np.empty(0, int)
    x = np.concatenate([x, [room // 2]]) if room >= 2 else x
    x = x[stock.count[x] > 0]
    if not len(x):
        x = np.array([stock.below[room // 2]])
    y = stock.below[np.minimum(room - x, x)]
    total = np.where(y > 0, x + y, 0)
    order = np.lexsort((-x, -total))[:4]
    return [(int(x[i]), int(y[i])) for i in order if total[i]]


def _fillings(stock: _Stock, room: int, width: int = 3, keep: int = 6) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first: up to ``width`` large lengths, then
    best fit for what is left. One length that fills the room exactly dominates all others."""
    best = int(stock.below[room]) if room > 0 else 0
    if not best:
        return [()]
    if best == room:
        return [(best,)]
    found: dict[tuple[int, ...], None] = {(best,): None}

    def grown(filling: tuple[int, ...], left: int) -> tuple[int, ...]:
        while left > 0 and (x := int(stock.below[left])):
            if stock.count[x] <= filling.count(x):
                x = int(stock.below[x - 1]) if x > 1 else 0
                if not x or stock.count[x] <= filling.count(x):
                    break
            filling, left = (*filling, x), left - x
        return filling

    for pair in _pairs(stock, room, best):
        found[pair] = None
    if width > 2 and all(sum(f) < room for f in found):
        tried, x = 0, best
        while x and tried < 24 and x > room // 4:
            stock.count[x] -= 1
            for pair in _pairs(stock, room - x, min(x, int(stock.below[room - x])))[:2] if room - x > 1 else []:
                found[(x, *pair)] = None
            stock.count[x] += 1
            if any(sum(f) == room for f in list(found)[-2:]):
                break
            x, tried = int(stock.below[x - 1]), tried + 1
    done = {tuple(sorted(grown(f, room - sum(f)), reverse=True)) for f in found}
    done = [f for f in done if stock.has(f)]
    done.sort(key=lambda f: (room - sum(f), len(f), [-x for x in f]))
    kept: list[tuple[int, ...]] = []
    for f in done:
        if not any(_dominates(g, f) for g in kept):
            kept.append(f)
    return kept[:keep]


def _dominates(big: tuple[int, ...], small: tuple[int, ...]) -> bool:
    """Whether the lengths of ``small`` fit, each group of them in one length of ``big``."""
    rooms = sorted(big, reverse=True)
    for x in sorted(small, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= x]
        if not fit:
            return False
        i = min(fit, key=lambda k: rooms[k])
        rooms[i] -= x
    return True


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing; the incumbent of the search."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 1, dtype=bool)
    for x in np.sort(lengths)[::-1]:
        x = int(x)
        room = x + int(np.argmax(rooms[x:])) if rooms[x:].any() else -1
        if room < 0:
            bins.append([])
            k, room = len(bins) - 1, capacity
        else:
            k = by_room[room].pop()
            rooms[room] = bool(by_room[room])
        bins[k].append(x)
        by_room[room - x].append(k)
        rooms[room - x] = True
    return bins


def bin_completion(lengths: np.ndarray, capacity: int, nodes: int = SEARCH_NODES) -> list[list[int]]:
    """As few bins as the search finds, each a list of lengths.

    The incumbent is best fit decreasing; it is returned at once if it meets the lower bound
    (total over capacity). Otherwise bins are completed largest length first, and a branch is
    cut as soon as its waste exceeds what one bin fewer than the incumbent allows. The search
    visits at most one node per bin and ``nodes`` more; then the incumbent stands.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    if not len(lengths):
        return []
    incumbent = best_fit(lengths, capacity)
    total, bound = int(lengths.sum()), -(-int(lengths.sum()) // capacity)
    left = nodes + len(incumbent)
    while len(incumbent) > bound and left > 0:
        allowed = (len(incumbent) - 1) * capacity - total
        stock, stack, waste = _Stock(lengths, capacity), [], 0
        descend, solved = True, False
        while True:
            if descend:
                left -= 1
                largest = int(stock.below[capacity])
                if not largest:
                    solved = True
                    break
                if left <= 0:
                    break
                stock.take((largest,))
                stack.append([largest, _fillings(stock, capacity - largest), 0, None])
            frame = stack[-1]
            if frame[3] is not None:
                stock.take(frame[3], 1)
                waste -= capacity - frame[0] - sum(frame[3])
                frame[3] = None
            descend = False
            while frame[2] < len(frame[1]):
                filling = frame[1][frame[2]]
                frame[2] += 1
                spare = capacity - frame[0] - sum(filling)
                # the last bin may be part empty: its waste counts like any other
                if waste + spare <= allowed:
                    stock.take(filling)
                    waste += spare
                    frame[3] = filling
                    descend = True
                    break
            if not descend:
                stock.take((frame[0],), 1)
                stack.pop()
                if not stack:
                    break
        if not solved:
            break
        incumbent = [[f[0], *f[3]] for f in stack]
    return incumbent


def _pack_group(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bin number within the group, offset and room left, for every row (doc_id, piece, length)."""
    group = group.sort_values(["length", "doc_id", "piece"], kind="stable").reset_index(drop=True)
    lengths = group["length"].to_numpy(dtype=np.int64)
    bins = bin_completion(lengths, capacity)
    at = dict(zip(*[a.tolist() for a in np.unique(lengths, return_index=True)]))
    number, offset, room = np.empty(len(group), np.int64), np.empty(len(group), np.int64), np.empty(len(group), np.int64)
    for k, b in enumerate(bins):
        place, spare = 0, capacity - sum(b)
        for x in b:
            i = at[x]
            at[x] = i + 1
            number[i], offset[i], room[i] = k, place, spare
            place += x
    group["bin"], group["offset"], group["room"] = number, offset, room
    return group


def pack(pieces: DataFrame, capacity: int = 4096, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Adds sequence_id and offset (long), instead of columns of these names, to rows with doc_id,
    piece and length <= capacity.

    Rows are dealt to shards by a hash of (doc_id, piece); the number of shards follows the
    total length. Rows that repeat are packed one by one. Pieces of length 0 or null are not
    placed and drop out. One row of totals is read by the driver.
    """
    pieces = materialise(pieces.filter(F.col("length") > 0))
    total = pieces.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    extra = [c for c in pieces.columns if c not in ("doc_id", "piece", "length", "sequence_id", "offset")]
    rows = pieces.select("doc_id", "piece", "length", F.struct(*extra).alias("extra") if extra else F.lit(0).alias("extra"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("long"))
    plain = "doc_id long, piece int, length long, extra " + rows.schema["extra"].dataType.simpleString()
    schema = f"{plain}, shard long, bin long, offset long, room long"

    def packed(df: DataFrame) -> DataFrame:
        return df.groupBy("shard").applyInPandas(
            lambda g: _pack_group(g, capacity)[["doc_id", "piece", "length", "extra", "shard", "bin", "offset", "room"]], schema
        )

    first = packed(rows)
    if shards > 1:
        first = materialise(first)
        again = first.filter(F.col("room") > OPEN_WASTE).select(
            "doc_id", "piece", "length", "extra", (-1 - F.floor(F.col("shard") / REGROUP)).cast("long").alias("shard")
        )
        first = first.filter(F.col("room") <= OPEN_WASTE).unionByName(packed(again))
    out = first.withColumn("sequence_id", F.col("shard") * F.lit(1 << 32) + F.col("bin"))
    return out.select("doc_id", "piece", "length", *[F.col(f"extra.{c}").alias(c) for c in extra], "sequence_id", "offset")
