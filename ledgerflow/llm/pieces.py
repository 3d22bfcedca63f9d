"""SentencePiece encoding and decoding of a column of texts."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.llm import sp_model


def encode_spans(text: Column, model_path: str) -> Column:
    """struct(ids array<int>, starts array<int>, ends array<int>): every id with the range of
    UTF-8 bytes of the original text that it covers. Null and empty texts have no ids."""

    @F.pandas_udf("struct<ids:array<int>,starts:array<int>,ends:array<int>>")
    def encoded(texts: pd.Series) -> pd.DataFrame:
        model = sp_model.load(model_path)
        return pd.DataFrame([model.encode(t) for t in texts], columns=["ids", "starts", "ends"])

    return encoded(text)


def encode_text(text: Column, model_path: str) -> Column:
    """struct(n long, ids string, decoded string, spans_sha256 string): number of ids, the ids in
    decimal joined by commas, what they decode to, and a digest of the byte ranges of the
    original text that they cover (start and end as little-endian unsigned 32-bit numbers).
    Null and empty texts give 0 and empty strings. Units that recur are encoded once per worker."""

    @F.pandas_udf("struct<n:long,ids:string,decoded:string,spans_sha256:string>")
    def encoded(texts: pd.Series) -> pd.DataFrame:
        model = sp_model.load(model_path)
        rows = [(n, ids, decoded, hashlib.sha256(spans).hexdigest()) for n, ids, decoded, spans in map(model.encode_text, texts)]
        return pd.DataFrame(rows, columns=["n", "ids", "decoded", "spans_sha256"])

    return encoded(text)


def decode(ids: Column, model_path: str) -> Column:
    """Text of an array of ids; null becomes empty."""

    @F.pandas_udf("string")
    def decoded(rows: pd.Series) -> pd.Series:
        model = sp_model.load(model_path)
        return pd.Series([model.decode([int(i) for i in r]) if r is not None else "" for r in rows], dtype=object)

    return decoded(ids)
