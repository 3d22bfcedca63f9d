"""Removal of byte strings that occur earlier in the corpus, by suffix arrays.

Every string of ``length`` bytes contains k-grams; the one with the smallest hash is its
anchor, so equal strings have equal anchors. Anchors that occur once in the corpus settle all
their strings. Around the others, runs of strings with one anchor are cut out and meet in the
shard of that anchor, equal runs of a chunk only once. An anchor whose runs would have more than
MOST bytes is hot: of its strings only those travel whose hash occurs twice in the corpus, to
the shard of a longer anchor, or if that is hot too of the whole string, which a chunk sends
once. No key then brings more to a shard than MOST bytes or one string per chunk. A shard is a text of a few megabytes:
its suffixes are sorted, and boundaries between suffixes are found by increasing length of
their common prefix, by breadth-first backward extension on the Burrows-Wheeler transform:
a boundary of length l+1 lies between the extensions by one character of neighbours that a
boundary of length l separates. The search stops at ``length``; the suffixes between two
boundaries then share that many bytes, and all but the earliest are repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ledgerflow.llm import chunks as c
from ledgerflow.llm import memory

LENGTH = 100
GRAM = 32
RUN = 64  # strings in one cut run at most; their answers fit one 64-bit word
_BYTE = c.mix(np.arange(1, 257, dtype=np.uint64))


#: Bytes of run text that one key may bring to a shard; keys above it are split.
MOST = c.CHUNK_BYTES
_LOW = np.uint64(15)  # bits of a key that carry how much text a chunk would send for it
_NONE = np.empty(0, np.uint64)


def _member(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``keys``, whose low bits are off."""
    if not len(keys):
        return np.zeros(len(values), dtype=bool)
    values = values & ~_LOW
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal neighbours begin, and how many there are. Neighbouring windows mostly share
    their anchor, so what depends on it is asked once for all of them."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


def _runs_of(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending window places and their keys: where runs of neighbours with one key begin,
    and their sizes. Windows of two documents are no neighbours: they start a length apart."""
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (key[1:] != key[:-1])]))
    return first, np.diff(np.concatenate([first, [len(at)]]))


def _whole(own: c.Chunk, length: int) -> np.ndarray:
    """Hash of the string of ``length`` bytes at every place; to be mixed where it is a key."""
    return c.rolling(_BYTE[own.bytes], length, c.FACTOR)


def _weighed(keys: np.ndarray, multi: np.ndarray, key: np.ndarray, at: np.ndarray, whole: np.ndarray, length: int) -> np.ndarray:
    """Distinct ``keys`` with their low bits set to a code: 0 for a single place and a run that
    one place can give; else 1 + n if their distinct runs have 2^n times as many bytes at most."""
    first, size = _runs_of(key, at)
    bytes_ = size + (length - 1) * -(-size // RUN)
    own, start = key[first] & ~_LOW, at[first]
    mark = c.mix(c.mix(whole[start]) ^ c.mix(c.mix(whole[start + size - 1]) + size.astype(np.uint64)))
    by = np.lexsort((mark, own))
    own, mark, bytes_ = own[by], mark[by], bytes_[by]
    fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (mark[1:] != mark[:-1])])
    weight = np.bincount(np.searchsorted(keys, own[fresh]), bytes_[fresh], len(keys))
    times = np.ceil(np.log2(np.maximum(weight / (3 * length), 1))).astype(np.int64)
    return keys | np.where(multi | (times > 0), np.minimum(1 + times, 15), 0).astype(np.uint64)


def _key_rows(chunk: int, keys: np.ndarray, buckets: int, kind: int = 0) -> pa.Table:
    bucket = ((keys >> np.uint64(4)) % np.uint64(buckets)).astype(np.int64) + kind * buckets
    order = np.argsort(bucket, kind="stable")
    numbers, starts = np.unique(bucket[order], return_index=True)
    return pa.table({
        "bucket": pa.array(numbers.astype(np.int32), pa.int32()),
        "chunk": pa.array(np.full(len(numbers), chunk, np.int32), pa.int32()),
        "keys": pa.array([k.tobytes() for k in np.split(keys[order], starts[1:])] if len(numbers) else [], pa.binary()),
    })


def _anchor_rows(own: c.Chunk, chunk: int, buckets: int, length: int, gram: int) -> pa.Table:
    """A chunk's distinct anchors, weighed."""
    least, valid, grams = c.anchors(_BYTE[own.bytes], own.begin, own.end, length, gram)
    keys, counts = c.counted_anchors(least, valid, grams, length - gram + 1)
    if not len(keys):
        return _key_rows(chunk, _NONE, buckets)
    # anchors that differ in the low bits alone are one key
    keys, of = np.unique(keys & ~_LOW, return_inverse=True)
    at = np.flatnonzero(valid)
    return _key_rows(chunk, _weighed(keys, np.bincount(of, counts) > 1, least[at], at, _whole(own, length), length), buckets)


def _longer_rows(own: c.Chunk, chunk: int, hot: np.ndarray, buckets: int, length: int, gram: int) -> pa.Table:
    """Of a chunk's strings whose anchor is hot: the hashes of the whole strings, and in a second
    kind of buckets their longer anchors, weighed."""
    least, valid, _ = c.anchors(_BYTE[own.bytes], own.begin, own.end, length, gram)
    at = np.flatnonzero(valid)
    first, size = _stretches(least[at])
    at = at[np.repeat(_member(hot, least[at[first]]), size)]
    if not len(at):
        return _key_rows(chunk, _NONE, buckets)
    whole = _whole(own, length)
    keys, counts = np.unique(c.mix(whole[at]) & ~_LOW, return_counts=True)
    longer = c.anchors(_BYTE[own.bytes], own.begin, own.end, length, (gram + length) // 2)[0][at]
    second = np.unique(longer & ~_LOW)
    second = _weighed(second, np.zeros(len(second), bool), longer, at, whole, length)
    return pa.concat_tables([_key_rows(chunk, keys | (counts > 1).astype(np.uint64), buckets), _key_rows(chunk, second, buckets, 1)])


FOUND_SCHEMA = "chunk int, kind string, keys binary"


def _found(table: pa.Table, kinds: tuple[str, str], most: int, length: int) -> pa.Table:
    """One bucket: per chunk the keys that occur twice or more, under the second kind those whose
    runs in all chunks together may have more than ``most`` bytes. A kind without a name is left out."""
    memory.enter("suffix_dedup")
    rows = [c.unpacked(k, "u8") for k in table.column("keys").to_pylist()]
    every = np.sort(np.concatenate(rows))
    values, code = every & ~_LOW, (every & _LOW).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    twice = (np.diff(np.concatenate([at, [len(values)]])) > 1) | (np.maximum.reduceat(code, at) > 0)
    heavy = np.add.reduceat(3 * length << np.maximum(code - 1, 0), at) > most
    out = {"chunk": [], "kind": [], "keys": []}
    for kind, found in zip(kinds, (values[at[twice & ~heavy]], values[at[twice & heavy]])):
        for number, r in zip(table.column("chunk").to_pylist(), rows if kind else []):
            r = np.sort(r & ~_LOW)
            r = r[_member(found, r)]
            if len(r):
                for name, value in (("chunk", number), ("kind", kind), ("keys", r.tobytes())):
                    out[name].append(value)
    types = {"chunk": pa.int32(), "kind": pa.string(), "keys": pa.binary()}
    return pa.table({n: pa.array(v, types[n]) for n, v in out.items()})


def _by_kind(table: pa.Table) -> dict[str, np.ndarray]:
    """Sorted keys of one chunk: settled as ``cold``, ``hot``, ``whole`` and ``longer``."""
    rows: dict[str, list] = {"cold": [], "hot": [], "whole": [], "longer": []}
    for kind, keys in zip(table.column("kind").to_pylist(), table.column("keys").to_pylist()):
        rows[kind].append(c.unpacked(keys, "u8"))
    return {k: np.sort(np.concatenate(v)) if v else _NONE for k, v in rows.items()}


def _runs(own: c.Chunk, keys: dict[str, np.ndarray], length: int, gram: int):
    """(place, number of strings, key) of runs of strings that share a repeated key: the anchor;
    if it is hot the longer anchor, of strings that repeat; if that is hot too, the string."""
    least, valid, _ = c.anchors(_BYTE[own.bytes], own.begin, own.end, length, gram)
    at = np.flatnonzero(valid)
    first, stretch = _stretches(least[at])
    hot, cold = (np.repeat(_member(keys[k], least[at[first]]), stretch) for k in ("hot", "cold"))
    hot, at = hot[hot | cold], at[hot | cold]
    key = least[at]
    if hot.any():
        place = at[hot]
        whole = c.mix(_whole(own, length)[place])
        longer = c.anchors(_BYTE[own.bytes], own.begin, own.end, length, (gram + length) // 2)[0][place]
        key[hot] = np.where(_member(keys["longer"], longer), whole, longer)
        keep = ~hot
        keep[hot] = _member(keys["whole"], whole)
        at, key = at[keep], key[keep]
    if not len(at):
        return at, at, key
    first, size = _runs_of(key, at)
    place, anchor = at[first], key[first]
    parts = -(-size // RUN)
    index = np.repeat(np.arange(len(place)), parts)
    nth = np.arange(len(index)) - np.repeat(np.cumsum(parts) - parts, parts)
    return place[index] + nth * RUN, np.minimum(size[index] - nth * RUN, RUN), anchor[index]


RUN_SCHEMA = "shard int, chunk int, text binary, sizes binary, docs binary, starts binary, copy_sizes binary, copy_docs binary, copy_starts binary"


def _run_rows(own: c.Chunk, keys: dict[str, np.ndarray], chunk: int, shards: int, length: int, gram: int) -> pa.Table:
    place, size, anchor = _runs(own, keys, length, gram)
    doc = own.document_of(place)
    ids, starts = own.ids[doc], place - own.first[doc]
    shard = ((anchor >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    numbers, begins = np.unique(shard[order], return_index=True)
    whole, out = own.bytes.tobytes(), {n: [] for n in RUN_SCHEMA.replace(" int", "").replace(" binary", "").split(", ")}
    for number, rows in zip(numbers.tolist(), np.split(order, begins[1:]) if len(numbers) else []):
        seen: set[bytes] = set()
        fresh = np.zeros(len(rows), dtype=bool)
        texts = []
        for i, (p, n) in enumerate(zip(place[rows].tolist(), size[rows].tolist())):
            text = whole[p : p + n + length - 1]
            if text not in seen:
                seen.add(text)
                texts.append(text)
                fresh[i] = True
        one, two = rows[fresh], rows[~fresh]
        for name, value in (
            ("shard", number), ("chunk", chunk), ("text", b"".join(texts)), ("sizes", c.packed(size[one], "u1")),
            ("docs", c.packed(ids[one], "i8")), ("starts", c.packed(starts[one], "i8")), ("copy_sizes", c.packed(size[two], "u1")),
            ("copy_docs", c.packed(ids[two], "i8")), ("copy_starts", c.packed(starts[two], "i8")),
        ):
            out[name].append(value)
    kinds = {n: pa.int32() if n in ("shard", "chunk") else pa.binary() for n in out}
    return pa.table({n: pa.array(v, kinds[n]) for n, v in out.items()})


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of symbols 0..511 (0 ends a string) in the order of their first ``depth``
    symbols at least; ranks are doubled from seven symbols in one word. The rank of a suffix is
    the place of the first of those it is tied with."""
    size = len(text)
    padded = np.concatenate([text.astype(np.uint64), np.zeros(7, np.uint64)])
    word = np.zeros(size, np.uint64)
    for i in range(7):
        word = (word << np.uint64(9)) | padded[i : i + size]
    # nothing behind the end of a string may count
    ended = np.zeros(size, dtype=bool)
    for i in range(7):
        ended |= padded[i : i + size] == 0
        word = np.where(ended, word & ~np.uint64((1 << (9 * (7 - i))) - 1), word)
    order = np.argsort(word)
    done = 7
    ordered = word[order]
    place = np.arange(size)
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])[:size]  # first of those that are equal so far
    rank = np.empty(size, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, place, 0))
    alive = ~ended
    while done < depth:
        # only what is tied and has not ended is sorted again, inside its own stretch
        more = np.flatnonzero((~first | np.concatenate([~first[1:], [False]])[:size]) & alive[order])
        if not len(more):
            break
        own = order[more]
        key = rank[own] * np.int64(size + 1) + rank[own + done] + 1
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[more] = own
        first[more] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[own] = np.maximum.accumulate(np.where(first[more], more, 0))
        after = np.zeros(size, dtype=bool)
        after[: size - done] = alive[done:]
        alive &= after
        done *= 2
    return order


def boundaries(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order, whether it shares fewer than ``length`` symbols with the one
    before it, derived by increasing length of the shared prefix."""
    size = len(text)
    before = np.where(order > 0, text[order - 1], 0).astype(np.uint16)
    extended = np.argsort(before, kind="stable")  # row r of the sorted suffixes extends row extended[r]
    first = before[extended]
    row_of = np.empty(size, np.int64)
    row_of[extended] = np.arange(size)
    cut = np.concatenate([[True], first[1:] != first[:-1]]) | (first == 0)  # shared length 0
    # a boundary between equal characters that stand next to each other extends to one boundary
    next_to = np.concatenate([[False], before[1:] == before[:-1]]) & (before != 0)
    waiting = np.flatnonzero(~cut)
    apart = extended[waiting] - extended[waiting - 1] > 1
    waiting = waiting[apart]
    upper, lower = extended[waiting], extended[waiting - 1]
    new = np.flatnonzero(cut)
    for _ in range(length - 1):
        near = row_of[new[next_to[new]]]
        reached = np.cumsum(cut, dtype=np.int32)
        hit = reached[upper] > reached[lower]
        new = np.concatenate([near[~cut[near]], waiting[hit]])
        if not len(new):
            break
        cut[new] = True
        waiting, upper, lower = waiting[~hit], upper[~hit], lower[~hit]
    return cut


ANSWER_SCHEMA = "chunk int, docs binary, starts binary, marks binary"


def _answers(table: pa.Table, length: int) -> pa.Table:
    """One shard: for every run, which of its strings start earlier elsewhere (bit i: the i-th)."""
    memory.enter("suffix_dedup")
    rows = table.to_pylist()
    classes: dict[bytes, int] = {}
    member, docs, starts, sizes = [], [], [], []
    for r in rows:
        at, own = 0, []
        for n in r["sizes"]:
            text = r["text"][at : at + n + length - 1]
            at += n + length - 1
            own.append(classes.setdefault(text, len(classes)))
        member.append(np.array(own, dtype=np.int64))
        docs.append(c.unpacked(r["docs"], "i8"))
        starts.append(c.unpacked(r["starts"], "i8"))
        sizes.append(np.frombuffer(r["sizes"], np.uint8).astype(np.int64))
    of, doc, start, size = (np.concatenate(x) for x in (member, docs, starts, sizes))
    by_place = np.lexsort((start, doc, of))
    head = by_place[np.concatenate([[True], of[by_place][1:] != of[by_place][:-1]])]  # earliest run of each class
    full = np.where(size >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(size, 63).astype(np.uint64)) - np.uint64(1))
    marks = full.copy()
    marks[head] = _first_marks(list(classes), doc[head], start[head], size[head], length)
    out = {"chunk": [], "docs": [], "starts": [], "marks": []}
    at = 0
    for r, m in zip(rows, member):
        copies = np.frombuffer(r["copy_sizes"] or b"", np.uint8).astype(np.uint64)
        all_of = np.where(copies >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(copies, np.uint64(63))) - np.uint64(1))
        own = marks[at : at + len(m)]
        some = own > 0
        out["chunk"].append(r["chunk"])
        out["docs"].append(c.packed(np.concatenate([doc[at : at + len(m)][some], c.unpacked(r["copy_docs"], "i8")]), "i8"))
        out["starts"].append(c.packed(np.concatenate([start[at : at + len(m)][some], c.unpacked(r["copy_starts"], "i8")]), "i8"))
        out["marks"].append(c.packed(np.concatenate([own[some], all_of]), "u8"))
        at += len(m)
    return pa.table({n: pa.array(v, pa.int32() if n == "chunk" else pa.binary()) for n, v in out.items()})


def _first_marks(texts: list[bytes], doc: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """Of distinct runs, given with their earliest places: the strings that are not the earliest
    of their kind. Runs without a string whose hash occurs twice here are not sorted."""
    marks = np.zeros(len(texts), np.uint64)
    some = _hold_repeats(texts, size, length)
    if len(some):
        marks[some] = _sorted_marks([texts[i] for i in some.tolist()], doc[some], start[some], size[some], length)
    return marks


def _hold_repeats(texts: list[bytes], size: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the runs that hold a string whose hash occurs twice in the shard."""
    begin = np.concatenate([[0], np.cumsum(size + (length - 1))])
    run = np.repeat(np.arange(len(texts)), size)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
    value = c.rolling(_BYTE[np.frombuffer(b"".join(texts), np.uint8)], length, c.FACTOR)[begin[run] + nth]
    order = np.argsort(value)
    value = value[order]
    same = value[1:] == value[:-1]
    return np.unique(run[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]])


def _sorted_marks(texts: list[bytes], doc: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> np.ndarray:
    """``_first_marks`` by suffix array and boundaries."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = ends - np.array([len(t) + 1 for t in texts])
    text = np.zeros(ends[-1], np.uint16)
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    text[:] = raw.astype(np.uint16) + 1
    text[ends - 1] = 0
    order = suffix_array(text, length)
    group = np.cumsum(boundaries(text, order, length))
    run = np.searchsorted(ends, order, side="right")
    nth = order - begins[run]
    whole = nth < size[run]
    group, run, nth = group[whole], run[whole], nth[whole]
    shared = np.bincount(group) > 1
    some = shared[group]
    group, run, nth = group[some], run[some], nth[some]
    marks = np.zeros(len(texts), np.uint64)
    if len(group):
        by = np.lexsort((start[run] + nth, doc[run], group))
        group, run, nth = group[by], run[by], nth[by]
        later = np.concatenate([[False], group[1:] == group[:-1]])
        np.bitwise_or.at(marks, run[later], np.uint64(1) << nth[later].astype(np.uint64))
    return marks


def _covered(own: c.Chunk, answers: pa.Table, length: int) -> np.ndarray:
    """Which bytes of the chunk a repeated string covers."""
    diff = np.zeros(len(own.bytes) + 1, dtype=np.int32)
    for docs, starts, marks in zip(*(answers.column(n).to_pylist() for n in ("docs", "starts", "marks"))):
        docs, starts, marks = c.unpacked(docs, "i8"), c.unpacked(starts, "i8"), c.unpacked(marks, "u8")
        if not len(docs):
            continue
        bits = np.unpackbits(marks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        run, nth = np.nonzero(bits)
        place = own.places(docs, starts)[run] + nth
        np.add.at(diff, place, 1)
        np.add.at(diff, place + length, -1)
    return np.cumsum(diff[:-1]) > 0


RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"


def _characters(data: bytes, spans: list[dict[str, int]]) -> bytes:
    """Whole characters between spans. Each part is decoded on its own, so that what two cuts
    leave of characters never makes another one."""
    edges = zip([0, *(s["end"] for s in spans)], [*(s["start"] for s in spans), len(data)])
    return "".join(data[i:j].decode("utf-8", "ignore") for i, j in edges).encode()


def _results(own: c.Chunk, covered: np.ndarray, characters: bool = False) -> pa.Table:
    doc_id, rows = [], {"n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept": []}
    for i, (a, b) in enumerate(zip(own.begin.tolist(), own.end.tolist())):
        gone = covered[a:b]
        doc_id.append(None if own.no_id[i] else int(own.ids[i]))
        rows["n_bytes"].append(b - a)
        if not gone.any():
            for name, value in (("n_removed", 0), ("n_spans", 0), ("spans", []), ("kept", own.data[i])):
                rows[name].append(value)
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        spans = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])]
        rows["n_removed"].append(int(gone.sum()))
        rows["n_spans"].append(len(spans))
        rows["spans"].append(spans)
        rows["kept"].append(_characters(own.data[i], spans) if characters else own.bytes[a:b][~gone].tobytes())
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({
        "doc_id": pa.array(doc_id, pa.int64()), **{n: pa.array(rows[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")},
        "spans": pa.array(rows["spans"], span), "kept": pa.array(rows["kept"], pa.binary()),
    })


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: tuple[str, ...] = (), most: int = MOST, characters: bool = False,
) -> DataFrame:
    """Documents (doc_id, text) without the bytes that a string of ``length`` bytes covers which
    also starts earlier: at a smaller doc_id, or before it in the same document. Strings are
    judged on the input. Texts are their UTF-8 bytes, null is empty.

    Returns a row per input row: doc_id, n_bytes, n_removed, n_spans (long), spans
    (array<struct<start,end>> of byte offsets), kept (binary: what is left; a cut may fall inside
    a character). Rows that share an id count as one document, their texts in byte order,
    though no string spans two of them; null ids come first. Columns named in ``carry`` are
    returned as a struct of that name, others are not read. ``most`` is the text in bytes that
    one key may bring to a shard; it changes no result. With ``characters`` what a cut leaves
    of a character is not in ``kept`` either; a text without spans is kept as it is.
    """
    own = c.corpus(docs, carry=carry)
    schema = StructType.fromDDL(RESULT_SCHEMA)
    schema = schema.add(own.rows.schema["carry"]) if carry else schema
    buckets, shards = own.buckets, own.chunks

    def keys(table: pa.Table) -> pa.Table:
        memory.enter("suffix_dedup")
        return _anchor_rows(c.Chunk(table), table.column("chunk")[0].as_py(), buckets, length, gram)

    def longer(left: pa.Table, right: pa.Table) -> pa.Table:
        memory.enter("suffix_dedup")
        if not len(left) or not len(right):
            return _key_rows(0, _NONE, buckets)
        return _longer_rows(c.Chunk(left), left.column("chunk")[0].as_py(), c.gathered(right), buckets, length, gram)

    def runs(left: pa.Table, right: pa.Table) -> pa.Table:
        memory.enter("suffix_dedup")
        return _run_rows(c.Chunk(left), _by_kind(right), left.column("chunk")[0].as_py() if len(left) else 0, shards, length, gram)

    def results(left: pa.Table, right: pa.Table) -> pa.Table:
        memory.enter("suffix_dedup")
        chunk = c.Chunk(left)
        out = _results(chunk, _covered(chunk, right, length), characters)
        return out.append_column("carry", left.column("carry").take(pa.array(chunk.order, pa.int64()))) if carry else out

    def found(rows: DataFrame, **kinds: tuple[str, ...]) -> DataFrame:
        names = list(kinds.values())
        return rows.groupBy("bucket").applyInArrow(lambda t: _found(t, names[t.column("bucket")[0].as_py() // buckets], most, length), FOUND_SCHEMA)

    by_chunk = own.rows.groupBy("chunk")
    first = found(by_chunk.applyInArrow(keys, c.KEY_SCHEMA), anchors=("cold", "hot"))
    second = by_chunk.cogroup(first.filter("kind = 'hot'").groupBy("chunk")).applyInArrow(longer, c.KEY_SCHEMA)
    second = found(second, whole=("whole", "whole"), longer=("", "longer"))
    cut = by_chunk.cogroup(first.union(second).groupBy("chunk")).applyInArrow(runs, RUN_SCHEMA)
    answers = cut.groupBy("shard").applyInArrow(lambda t: _answers(t, length), ANSWER_SCHEMA)
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(results, schema)
