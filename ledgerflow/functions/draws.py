"""Seeded draws for many seeds at once: ``scalars.uniform``, a column of keys at a time.

A draw is the first 60 bits of the MD5 of "seed:key". Draws of all rows and seeds of a batch go
through the rounds of MD5 together, as arrays, some thousand at a time so that they stay in
the cache. The values are those of ``scalars.uniform`` bit for bit."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.functions.scalars import HASH_BITS

LANES = 1 << 15  # draws that are hashed together
_SINE = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def key_text(*cols: Column | str) -> Column:
    """What follows the seed in the text that a draw hashes; NULLs are left out, as in ``concat_ws``."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.concat(*[F.coalesce(F.concat(F.lit(":"), t), F.lit("")) for t in texts])


def _rounds(state: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """The state of MD5 after one block of 16 words per lane."""
    a, b, c, d = (s.copy() for s in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        f += words[_WORD[kind](i)]
        f += np.uint32(_SINE[i])
        turn = _TURN[kind][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=t)
        np.left_shift(f, np.uint32(turn), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [s + x for s, x in zip(state, (a, b, c, d))]


def _messages(data: np.ndarray, begin: np.ndarray, size: np.ndarray, room: int, blocks: int) -> np.ndarray:
    """Padded messages of ``blocks`` blocks whose first ``room`` bytes are left open, by word and row."""
    out = np.zeros((len(begin), 64 * blocks), np.uint8)
    at = np.arange(int(size.max(initial=0)))
    inside = at < size[:, None]
    if len(at):
        out[:, room : room + len(at)] = np.where(inside, data[np.where(inside, begin[:, None] + at, 0)], 0)
    out[np.arange(len(begin)), room + size] = 0x80
    out[:, -8:] = ((room + size) * 8).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(out.view("<u4").T)


def hashed(seeds: Sequence[str], keys: pa.Array, which: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Draws in [0, 1): the n-th by the seed with the number ``which[n]`` for the key in the row
    ``rows[n]``. The keys come from ``key_text``."""
    keys = pa.concat_arrays([keys.cast(pa.string())])
    ends = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    data = np.frombuffer(keys.buffers()[2] or b"\0", np.uint8)
    begin, size = ends[:-1], np.diff(ends)
    out = np.empty(len(rows))
    rooms = np.array([len(s.encode()) for s in seeds], np.int64)
    for room in np.unique(rooms).tolist():
        # the words in which the seeds lie
        own = -(-room // 4)
        starts = np.zeros((len(seeds), 4 * own), np.uint8)
        for k in np.flatnonzero(rooms == room).tolist():
            starts[k, :room] = np.frombuffer(seeds[k].encode(), np.uint8)
        starts = np.ascontiguousarray(starts.view("<u4").T)
        number = (room + size + 8) // 64 + 1
        for blocks in np.unique(number).tolist():
            here = np.flatnonzero(number == blocks)
            messages = _messages(data, begin[here], size[here], room, blocks)
            place = np.zeros(len(keys), np.int64)
            place[here] = np.arange(len(here))
            lanes = np.flatnonzero((rooms[which] == room) & (number[rows] == blocks))
            for part in (lanes[i : i + LANES] for i in range(0, len(lanes), LANES)):
                words = np.take(messages, place[rows[part]], axis=1)
                words[:own] |= np.take(starts, which[part], axis=1)
                state = [np.full(len(part), s, np.uint32) for s in _START]
                for i in range(blocks):
                    state = _rounds(state, words[16 * i : 16 * i + 16])
                top, low = (s.byteswap().astype(np.uint64) for s in state[:2])
                value = ((top << np.uint64(32)) | low) >> np.uint64(64 - HASH_BITS)
                out[part] = value.astype(np.float64) / 2.0**HASH_BITS
    return out


def all_hashed(seeds: Sequence[str], keys: pa.Array) -> np.ndarray:
    """Draws of every seed for every key, by seed and row."""
    n = len(keys)
    return hashed(seeds, keys, np.repeat(np.arange(len(seeds)), n), np.tile(np.arange(n), len(seeds))).reshape(len(seeds), n)
