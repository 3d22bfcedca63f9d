"""Quality score from how well a text compresses with dictionaries of good and of bad text.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text
is compressed with each, whole and in blocks; the difference of the two sizes over the larger
one says which side it resembles, and how far it shrinks says how much it repeats itself. A
logistic curve over these figures, fitted on labelled texts that went into neither dictionary,
turns them into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm import memory

SAMPLE_ROWS = 4000  # labelled rows per class that the driver reads at most
SAMPLE_CHARS = 12_000  # longer labelled texts are left out of the sample, never cut
DICTIONARY_BYTES = 112_640
LEVEL = 3
BLOCK_BYTES = 800
CALIBRATION_SHARE = 3  # one sampled text in so many calibrates instead of building


@dataclass(frozen=True)
class CompressionModel:
    """Picklable and of bounded size: two dictionaries and a logistic curve."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    intercept: float

    def probability(self, text: str | None) -> float:
        x = sum(w * f for w, f in zip(self.weights, figures(text, self.good, self.bad)))
        return float(1 / (1 + np.exp(-np.clip(x + self.intercept, -30, 30))))


def build_dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or with too little text to train one the texts themselves."""
    texts = [t for t in texts if t]
    if sum(map(len, texts)) > 8 * size:
        try:
            return zstandard.train_dictionary(size, texts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(texts)[-size:]


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL)
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)


memory.keeps("quality", _compressor.cache_clear)


def _sizes(raw: bytes, good: bytes, bad: bytes) -> tuple[float, float]:
    """(size with the bad dictionary - size with the good one) / the larger, and the logarithm
    of the smaller size over the raw one."""
    with_good = len(_compressor(good).compress(raw))
    with_bad = len(_compressor(bad).compress(raw))
    return (with_bad - with_good) / max(with_bad, with_good), float(np.log(min(with_good, with_bad) / len(raw)))


def figures(text: str | None, good: bytes, bad: bytes) -> tuple[float, ...]:
    """What a text is judged by; all 0 for null and empty texts. Of the whole text: the
    normalised difference, the log ratio and its square; of its blocks: the least and the mean
    difference and the least log ratio. Blocks are of equal size, about ``BLOCK_BYTES``."""
    if not text:
        return (0.0,) * FIGURES
    raw = text.encode("utf-8", "surrogatepass")
    whole, ratio = _sizes(raw, good, bad)
    count = max(1, round(len(raw) / BLOCK_BYTES))
    edges = [len(raw) * i // count for i in range(count + 1)]
    blocks = [_sizes(raw[a:b], good, bad) for a, b in zip(edges, edges[1:])] if count > 1 else [(whole, ratio)]
    each = [d for d, _ in blocks]
    return whole, ratio, ratio * ratio, min(each), sum(each) / count, min(r for _, r in blocks)


FIGURES = 6


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[tuple[float, ...], float]:
    """Weights and intercept by Newton steps with a light ridge, halved until they gain; the
    classes weigh the same."""
    if not len(x) or y.min() == y.max():
        return (0.0,) * FIGURES, 0.0
    w = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    beta = np.zeros(a.shape[1])

    def loss(v: np.ndarray) -> float:
        margin = (a @ v) * np.where(y == 1, 1, -1)
        return float((w * np.logaddexp(0, -margin)).sum() + ridge * (v @ v) / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (w * (y - p)) - ridge * beta
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(beta)), gradient)
        size, now = 1.0, loss(beta)
        while size > 1e-6 and loss(beta + size * step) > now:
            size /= 2
        beta = beta + size * step
        if size * np.abs(step).max() < 1e-6:
            break
    weights = beta[:-1] / spread
    return tuple(float(v) for v in weights), float(beta[-1] - weights @ middle)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> CompressionModel:
    """Fit on documents (doc_id, text) with labels (doc_id, label 0/1; other labels and null
    ids are not used, of an id's labels the largest counts). Other columns are not read.

    Of each class about nine tenths of ``sample_rows`` ids are drawn, by a hash of the id and a
    share that follows from the class's size; with fewer, all. The driver reads their texts of
    up to ``sample_chars`` code points, and no more than ``sample_rows`` of a class. Class shares are
    counted over all labels. With a class missing, every score is the share of good rows (one
    half without any).
    """
    labels, docs = labels.select("doc_id", "label"), docs.select("doc_id", "text")
    known = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    share = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = share.get(0, 0), share.get(1, 0)
    drawn = F.lit(False)
    for k, n in share.items():
        part = 1_000_000 if n <= sample_rows else max(1, 900_000 * sample_rows // n)
        drawn = drawn | ((F.col("label") == k) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part))
    # at most about 2 * sample_rows ids, whatever the size of the table
    ids = known.filter(drawn).select(F.col("doc_id").alias("id"), "label")
    fair = docs.join(F.broadcast(ids), docs["doc_id"] == F.col("id")).filter((F.length("text") > 0) & (F.length("text") <= sample_chars))
    sample = {}
    for k in (0, 1):
        rows = fair.filter(F.col("label") == k).select(F.xxhash64("doc_id", "text").alias("h"), "text").orderBy("h", "text").limit(sample_rows).collect()
        sample[k] = [r["text"] for r in rows]
    if not sample[0] or not sample[1]:
        p = n1 / (n0 + n1) if n0 + n1 else 0.5
        return CompressionModel(b"", b"", (0.0,) * FIGURES, float(np.log((p + 1e-6) / (1 - p + 1e-6))))
    parts = {}
    for k, texts in sample.items():
        small = len(texts) < 2 * CALIBRATION_SHARE
        parts[k] = (
            [t for i, t in enumerate(texts) if small or i % CALIBRATION_SHARE],
            [t for i, t in enumerate(texts) if small or not i % CALIBRATION_SHARE],
        )
    good, bad = (build_dictionary([t.encode("utf-8", "surrogatepass") for t in parts[k][0]]) for k in (1, 0))
    x = np.array([figures(t, good, bad) for k in (0, 1) for t in parts[k][1]])
    y = np.array([k for k in (0, 1) for _ in parts[k][1]])
    weights, intercept = _fit_logistic(x, y)
    return CompressionModel(good, bad, weights, intercept + float(np.log(n1 / n0)))


def score(text: Column, model: CompressionModel) -> Column:
    """Probability of label 1 in (0, 1). Null and empty texts get the curve's value where all figures are 0."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        memory.enter("quality")
        return pd.Series([model.probability(t) for t in texts], dtype=float)

    return scored(text)


def in_fold(doc_id: Column, folds: int = 5) -> Column:
    """Fold number of a document: crc32 of its id as text, modulo ``folds``; null ids: fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the table of labels outside fold 0."""
    return labels.filter(in_fold(F.col("doc_id")) != 0).select("doc_id", F.col("quality").alias("label"))
