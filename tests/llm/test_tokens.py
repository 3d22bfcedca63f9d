"""SentencePiece encoding, word pieces and packing against the libraries."""

import random
import zlib

import numpy as np
import pytest
import sentencepiece
from helpers import SMALL, odd_texts, sha, texts_frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerflow.llm import packing, pieces, sp_model
from ledgerflow.llm.queries import tokenizer_file
from ledgerflow.llm.registry import QUERIES

SP, WORDS = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("word_bpe_49k.json")


def random_texts(seed, count):
    r = random.Random(seed)
    parts = list(" \t\nabcdetionhrIt's're▁éßİΣ漢😀́<s>0x0A.,²½\x00\x85　ﬁ") + ["  ", "    ", "the ", "<unk>", "</s>", "<|endoftext|>", "▁▁"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(count)]


def test_pieces_equal_the_library():
    own, library = sp_model.load(SP), sentencepiece.SentencePieceProcessor(model_file=SP)
    for t in random_texts(1, 1500) + [x or "" for x in odd_texts()]:
        ids = library.encode(t)
        n, joined, decoded, spans = own.encode_text(t)
        assert np.frombuffer(spans, '<u4').reshape(-1, 2).tolist() == [list(x) for x in zip(*own.encode(t)[1:])]
        assert (n, joined, decoded) == (len(ids), ",".join(map(str, ids)), library.decode(ids))
        got = own.encode(t)
        assert got[0] == ids and own.decode(ids) == decoded
        assert list(zip(got[1], got[2])) == [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces]


def test_longest_entry_of_the_character_map_wins():
    class Fixed(sp_model.CharacterMap):
        table = {b"A": b"a", b"AB": b"xyz", "é".encode(): b"e"}

        def __init__(self):
            super().__init__(b"")

        def longest(self, data, at):
            hits = [k for k in self.table if data.startswith(k, at)]
            return (len(max(hits, key=len)), self.table[max(hits, key=len)]) if hits else None

    model = sp_model.Model(open(SP, "rb").read())
    model.map = Fixed()
    data, source = model.normalise("ABAé q")
    assert data.decode() == "▁xyzae▁q"
    assert source == [0] * 3 + [0, 0, 0, 2, 3, 5, 5, 5, 6, 7]


def test_ids_of_the_query_come_from_the_encoding_with_places():
    class Fixed(sp_model.CharacterMap):
        def longest(self, data, at):
            return (2, b"the") if data.startswith(b"AB", at) else None

    model = sp_model.Model(open(SP, "rb").read())
    model.map = Fixed(b"")
    want = sp_model.load(SP).encode_text("the cat the")[:3]
    assert model.encode_text("AB cat AB")[:3] == want
    ids, starts, ends = model.encode("AB cat AB")
    assert want[0] == len(ids) and (starts[0], ends[-1]) == (0, 9)
    library = sentencepiece.SentencePieceProcessor(model_file=SP)
    pieces_ = library.encode("é  漢x the", return_type="proto").pieces
    got = sp_model.load(SP).encode("é  漢x the")
    assert [(p.id, p.begin, p.end) for p in pieces_] == list(zip(*got))


def test_long_texts_and_columns(spark):
    texts = [*odd_texts(), "x" * 30_000]
    frame = texts_frame(spark, texts)
    rows = frame.select("doc_id", pieces.encode_spans(F.col("text"), SP).alias("e"), pieces.encode_text(F.col("text"), SP).alias("t")).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=SP)
    for r in rows:
        ids = library.encode(texts[r["doc_id"] - 1] or "")
        assert list(r["e"]["ids"]) == ids and r["t"]["n"] == len(ids) and r["t"]["decoded"] == library.decode(ids)
    back = spark.createDataFrame([([1, 2, 3],), (None,)], "ids array<int>").select(pieces.decode(F.col("ids"), SP).alias("t")).collect()
    assert back[1]["t"] == ""


def test_round_trip_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=SP)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op7_sentencepiece_round_trip"](spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_word_ids_equal_the_library():
    own, library = packing.WordTokenizer(WORDS), Tokenizer.from_file(WORDS)
    texts = random_texts(2, 1500)
    texts += ["".join(c for c in t if not packing._OTHER.search(c)) for t in texts]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.ids(texts) == want


@pytest.mark.parametrize("draw", [lambda r: r.integers(1, 4097, 400), lambda r: r.integers(1000, 2500, 300), lambda r: np.full(50, 1365), lambda r: np.minimum(4096, r.lognormal(6, 1.3, 2000).astype(int) + 1)])
def test_bins_hold_everything_and_beat_best_fit(draw):
    lengths = draw(np.random.default_rng(5))
    bins = packing.bin_completion(lengths, 4096, nodes=2000)
    assert sorted(x for b in bins for x in b) == sorted(lengths.tolist())
    assert max(map(sum, bins)) <= 4096
    assert -(-lengths.sum() // 4096) <= len(bins) <= len(packing.best_fit(lengths, 4096))


def test_bin_completion_finds_what_best_fit_misses():
    lengths = [6, 5, 5, 4, 4, 4, 2]  # 6+4, 5+5, 4+4+2; best fit decreasing takes four bins of 10
    assert len(packing.bin_completion(np.array(lengths), 10)) == 3


def test_packed_pieces(spark):
    texts = [*odd_texts(), "word " * 9000]
    frame = texts_frame(spark, texts)
    cut = packing.cut_pieces(frame, WORDS, 4096, 1)
    rows = packing.pack(cut, 4096, shard_tokens=3000).collect()
    library = Tokenizer.from_file(WORDS)
    for i, t in enumerate(texts, 1):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 4096))
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["ids"] == part.tolist()
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    end = {}
    for s, o, n in places:
        assert o == end.get(s, 0)
        end[s] = o + n
    assert max(end.values()) <= 4096
    assert packing.pack(cut.limit(0), 4096).count() == 0
