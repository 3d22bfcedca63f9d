"""Reading a SentencePiece BPE model and encoding with it, keeping source positions.

A text is normalised first: at each byte the longest entry of the model's compiled character
map that matches is replaced, and every byte of the result keeps the source byte it came from.
Byte pairs are then merged by score inside units that no piece can cross. Every piece is
projected back to the source bytes it covers.
"""

from __future__ import annotations

import heapq
import re
import struct
from functools import lru_cache

import numpy as np

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
SPACE_BYTES = SPACE.encode()
CACHE_UNITS = 200_000
CACHED_LENGTH = 48
SHORT = 64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes):
    """(field number, value) pairs of one protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        else:
            raise ValueError(f"wire type {kind} in the model file")
        yield key >> 3, value


class CharacterMap:
    """The compiled map: a double-array trie over source bytes, whose leaves give offsets of
    NUL-ended replacement strings."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that starts at ``at``."""
        if not self.units:
            return None
        units, node, best = self.units, 0, None
        step = lambda u: (u >> 10) << ((u & 512) >> 6)
        node ^= step(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.strings[best[1] : self.strings.index(b"\0", best[1])]

    def hits(self, data: bytes) -> dict[int, tuple[int, bytes]]:
        """Length and replacement of the entries met from the left, by where they start."""
        at, out = 0, {}
        while at < len(data):
            found = self.longest(data, at)
            if found is not None:
                out[at] = found
            at += _size(data[at]) if found is None else found[0]
        return out


class NoMap(CharacterMap):
    """The map of a model that has none."""

    def __init__(self):
        super().__init__(b"")

    def hits(self, data: bytes) -> dict[int, tuple[int, bytes]]:
        return {}


def _size(first: int) -> int:
    """Bytes of the character with this first byte."""
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Model:
    """A BPE model with its normaliser. Unigram models and user-defined or unused pieces are
    refused, as their rules differ."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        self.unknown_text = " ⁇ "
        self.byte_fallback = False
        self.kinds: list[int] = []
        charsmap, self.prefix, self.squeeze, self.escape, kind = b"", True, True, True, 1
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                text, type_ = own[1].decode(), own.get(3, NORMAL)
                number = len(self.pieces)
                self.pieces.append(text)
                self.kinds.append(type_)
                self.scores.append(struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0])
                if type_ == NORMAL:
                    self.ids[text] = number
                elif type_ == BYTE:
                    self.byte_ids[int(text[3:5], 16)] = number
                elif type_ == UNKNOWN:
                    self.unknown = number
                elif type_ in (USER, UNUSED):
                    raise ValueError("user-defined and unused pieces are not supported")
            elif field == 2:
                for f, v in _fields(value):
                    if f == 3:
                        kind = v
                    elif f == 35:
                        self.byte_fallback = bool(v)
                    elif f == 44:
                        self.unknown_text = v.decode()
                    elif f == 24 and v:
                        raise ValueError("space as a suffix is not supported")
            elif field == 3:
                for f, v in _fields(value):
                    if f == 2:
                        charsmap = v
                    elif f == 3:
                        self.prefix = bool(v)
                    elif f == 4:
                        self.squeeze = bool(v)
                    elif f == 5:
                        self.escape = bool(v)
        if kind != 2:
            raise ValueError("not a BPE model")
        self.map = CharacterMap(charsmap) if charsmap else NoMap()
        #: Place of a piece in the order of scores; equal scores share one.
        order = {v: i for i, v in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[self.scores[i]] for p, i in self.ids.items()}
        self.id_text = [str(i) for i in range(len(self.pieces))]
        inner = [p for p in self.ids if SPACE in p.lstrip(SPACE)]
        self.units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if not inner else re.compile("(?s).+")
        #: Text of a normal piece; None for the others.
        self.shown = [p.replace(SPACE, " ") if k == NORMAL else None for p, k in zip(self.pieces, self.kinds)]
        self.width = [len(p.encode("utf-8", "surrogatepass")) for p in self.pieces]
        self.widths = np.array(self.width, np.int64)
        #: The byte that an id stands for; -1 for ids of text, -2 for unknown characters.
        self.byte_of = np.array([int(p[3:5], 16) if k == BYTE else -2 if k == UNKNOWN else -1 for p, k in zip(self.pieces, self.kinds)])
        #: Ids of units: those met lately, and those met before them. When the first is full it
        #: takes the place of the second, so that units in use stay.
        self._young: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised bytes, and for each of them and the end the source byte it starts at."""
        data = text.encode("utf-8", "surrogatepass")
        hits = self.map.hits(data)
        if data and not hits and not self.squeeze:
            return self._marked(data)
        out, source = bytearray(), []

        def add(piece: bytes, at: int) -> None:
            out.extend(piece)
            source.extend([at] * len(piece))

        at, parts = 0, []
        while at < len(data):
            found = hits.get(at)
            if found is None:
                size = _size(data[at])
                found = (size, data[at : at + size])
            parts.append((at, found[1]))
            at += found[0]
        if self.squeeze:
            while parts and not parts[0][1].strip(b" "):
                parts.pop(0)
        if not parts:
            return b"", [len(data)]
        space = SPACE_BYTES if self.escape else b" "
        if self.prefix:
            add(space, parts[0][0])
        before = self.squeeze
        for at, piece in parts:
            if self.squeeze and before:
                piece = piece.lstrip(b" ")
            if not piece:
                continue
            add(piece.replace(b" ", space), at)
            before = piece.endswith(b" ")
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                del source[-len(space) :]
        source.append(len(data))
        return bytes(out), source

    def _marked(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """``normalise`` of bytes in which nothing is replaced but spaces, all at once."""
        raw = np.frombuffer(data, np.uint8)
        # a byte inside a character starts where the character does
        source = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, np.arange(len(raw)), 0))
        space = SPACE_BYTES if self.escape else b" "
        source = np.repeat(source, np.where(raw == 0x20, len(space), 1))
        head = space if self.prefix else b""
        source = np.concatenate([np.zeros(len(head), np.int64), source, [len(raw)]])
        return head + data.replace(b" ", space), source

    def merge(self, unit: str) -> list[str]:
        """Pieces of a unit: neighbours whose join is a piece are joined, highest score first,
        then leftmost."""
        symbols = list(unit)
        count = len(symbols)
        if count == 1:
            return symbols
        if count <= SHORT:
            return self._merge_short(symbols)
        left, right = list(range(-1, count - 1)), list(range(1, count)) + [-1]
        ids, scores = self.ids, self.scores
        heap = []
        for i in range(count - 1):
            number = ids.get(symbols[i] + symbols[i + 1])
            if number is not None:
                heap.append((-scores[number], i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(heap)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not symbols[a] or not symbols[b] or len(symbols[a]) + len(symbols[b]) != size:
                continue
            symbols[a] += symbols[b]
            symbols[b] = ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            for x, y in ((left[a], a), (a, right[a])):
                if x >= 0 and y >= 0:
                    number = ids.get(symbols[x] + symbols[y])
                    if number is not None:
                        heapq.heappush(heap, (-scores[number], x, y, len(symbols[x]) + len(symbols[y])))
        return [s for s in symbols if s]

    def _merge_short(self, symbols: list[str]) -> list[str]:
        rank, none = self.rank.get, len(self.pieces)
        ranks = [rank(a + b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            symbols[i] += symbols.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(symbols[i - 1] + symbols[i], none)
            if i < len(ranks):
                ranks[i] = rank(symbols[i] + symbols[i + 1], none)
        return symbols

    def numbers(self, piece: str) -> list[int]:
        number = self.ids.get(piece)
        if number is not None:
            return [number]
        if self.byte_fallback:
            return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def encode(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """Ids with the source byte range [start, end) of each. Of the ids that stand
        for single bytes of a character the last gets its range and the others an empty one
        before it, as the library has it; a mark added before the text covers no byte."""
        ids, starts, ends = self.encode_places(text)
        return ids, starts.tolist(), ends.tolist()

    def encode_places(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
        """``encode`` with the ranges as arrays. Ids cover the normalised bytes without gaps, so their
        places there are running sums of their widths, and the alignment takes them to the source."""
        if not text:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        data, source = self.normalise(text)
        units = self.units.findall(data.decode("utf-8", "surrogatepass"))
        ids: list[int] = []
        young = self._young
        for unit in units:
            known = young.get(unit)
            ids += known if known is not None else self._met(unit)
        numbers = np.array(ids, np.int64)
        widths = self.widths[numbers]
        byte = self.byte_of[numbers]
        if (byte != -1).any():
            widths = self._open_widths(widths, byte, data)
        stops = np.cumsum(widths)
        source = np.asarray(source)
        return ids, source[stops - widths], source[stops]

    def _met(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit that was not met lately."""
        known = self._old.get(unit)
        if known is None:
            pieces = self.merge(unit)
            known = tuple(map(self.ids.get, pieces))
            if None in known:
                known = tuple([number for piece in pieces for number in self.numbers(piece)])
        if len(unit) <= CACHED_LENGTH:
            if len(self._young) >= CACHE_UNITS:
                self._old = dict(self._young)
                self._young.clear()
            self._young[unit] = known
        return known

    def _open_widths(self, widths: np.ndarray, byte: np.ndarray, data: bytes) -> np.ndarray:
        """Widths with those of ids that don't tell them: of the bytes of a character the last has
        them all; an unknown character is looked up where it stands."""
        single = byte >= 0
        widths = np.where(byte == -1, widths, 0)
        first = np.flatnonzero(single & (byte & 0xC0 != 0x80))
        size = 1 + (byte[first] >= 0xC0) + (byte[first] >= 0xE0) + (byte[first] >= 0xF0)
        widths[first + size - 1] = size
        unknown = np.flatnonzero(byte == -2)
        at = (np.cumsum(widths)[unknown]).tolist()
        more = 0
        for k, place in zip(unknown.tolist(), at):
            widths[k] = _size(data[place + more])
            more += widths[k]
        return widths

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for: marks become spaces, the one added in front goes."""
        texts = [self.shown[i] for i in ids]
        head = next((i for i in ids if self.kinds[i] != CONTROL), None)
        cut = head is not None and self.kinds[head] == NORMAL and self.prefix and self.pieces[head].startswith(SPACE)
        out, run, done = [], bytearray(), 0
        for at in [k for k, t in enumerate(texts) if t is None]:
            number = ids[at]
            if run and (at > done or self.kinds[number] != BYTE):
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out += texts[done:at]
            done = at + 1
            if self.kinds[number] == BYTE:
                run.append(int(self.pieces[number][3:5], 16))
            elif self.kinds[number] == UNKNOWN:
                out.append(self.unknown_text.replace(SPACE, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        out += texts[done:]
        return "".join(out)[1:] if cut else "".join(out)

    def encode_text(self, text: str | None) -> tuple[int, str, str, bytes]:
        """Number of ids, the ids joined by commas, the decoded text, and the ranges (start, end) as
        little-endian 32-bit numbers one after the other, of what ``encode`` gives."""
        ids, starts, ends = self.encode_places(text)
        spans = np.stack([starts, ends], axis=1).astype("<u4").tobytes()
        return len(ids), ",".join([self.id_text[i] for i in ids]), self.decode(ids), spans


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    """The model in a local file, which every executor has at this path."""
    with open(path, "rb") as f:
        return Model(f.read())
