"""Window encoders: user-supplied ones as Arrow batch jobs, and a built-in statistical one."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.schema import EventSchema
from ledgerflow.sources.writers import publish_panel

# frame of sequence records -> float matrix, one row per record
Encoder = Callable[[pd.DataFrame], np.ndarray]


def _encode_batches(encoder: Encoder, keys: Sequence[str], dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            m = np.asarray(encoder(frame), dtype=np.float32)
            if m.shape != (len(frame), dim):
                raise ValueError(f"encoder returned {m.shape}, expected {(len(frame), dim)}")
            if not np.isfinite(m).all():
                raise ValueError("encoder returned NaN or infinite values")
            out = frame[list(keys)].copy()
            out["emb"] = list(m)
            yield out

    return run


def embed_windows(sequences: DataFrame, keys: Sequence[str], encoder: Encoder, dim: int) -> DataFrame:
    """(keys, emb) of sequence records. Records are rows, so any number of windows streams
    through in Arrow batches; the encoder ships once per task and keeps no state."""
    types = dict(sequences.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "emb array<float>"])
    return sequences.mapInPandas(_encode_batches(encoder, keys, dim), schema)


def embed_series(series: DataFrame, keys: Sequence[str], encoder: Encoder, dim: int, column: str = "series") -> DataFrame:
    """Same for regular series: only keys and the series reach the encoder."""
    return embed_windows(series.select(*keys, column), keys, encoder, dim)


@dataclass(frozen=True)
class Ragged:
    """The arrays of many rows end to end: row i holds values[offsets[i]:offsets[i + 1]]."""

    offsets: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, column: pa.ListArray) -> Ragged:
        """Without copying; a null array is an empty one."""
        lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
        return cls(np.concatenate([[0], np.cumsum(lengths)]), np.asarray(column.flatten()))

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Per row the sum of ``rows``, which belong to the values one by one."""
        total = np.zeros((len(rows) + 1, *rows.shape[1:]))
        np.cumsum(rows, axis=0, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def places(self) -> np.ndarray:
        """Place of every value inside its row, from 0."""
        return np.arange(len(self.values)) - np.repeat(self.offsets[:-1], self.lengths)


# columns by name (arrays as Ragged, others as numpy arrays) and number of rows -> float matrix
RaggedEncoder = Callable[[dict, int], np.ndarray]
_LOADED: dict[str, RaggedEncoder] = {}


def embed_ragged(
    records: DataFrame, keys: Sequence[str], load: Callable[[str], RaggedEncoder], weights: str, dim: int,
    columns: Sequence[str] | None = None, chunk_rows: int = 4096,
) -> DataFrame:
    """(keys, emb) of records by an encoder that works on whole columns.

    ``load(weights)`` runs once per worker process and path; what it returns gets the arrays of up to
    ``chunk_rows`` records as offsets and values, straight from Arrow, so no Python loop runs
    over rows and memory does not depend on the table. A matrix of another shape or with
    values that are not finite fails the job."""
    columns = [c for c in records.columns if c not in keys] if columns is None else list(columns)
    types = dict(records.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, chunk_rows):
                batch = whole.slice(at, chunk_rows)
                if weights not in _LOADED:
                    _LOADED.clear()  # one set of weights a process
                    _LOADED[weights] = load(weights)
                own = {c: batch.column(c) for c in columns}
                own = {c: Ragged.of(v) if pa.types.is_list(v.type) else v.to_numpy(zero_copy_only=False) for c, v in own.items()}
                m = np.asarray(_LOADED[weights](own, batch.num_rows), np.float32)
                if m.shape != (batch.num_rows, dim):
                    raise ValueError(f"encoder returned {m.shape}, expected {(batch.num_rows, dim)}")
                if not np.isfinite(m).all():
                    raise ValueError("encoder returned NaN or infinite values")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dim, dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], lists], [*keys, "emb"])

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "emb array<float>"])
    return records.select(*keys, *columns).mapInArrow(run, schema)


def embed_panel(
    records: DataFrame, keys: Sequence[str], load: Callable[[str], RaggedEncoder], weights: str, dim: int, root: str, date: str,
    columns: Sequence[str] | None = None, chunk_rows: int = 4096,
) -> list:
    """Encode and publish whole dates below ``root``; dates that lie there are not encoded again.
    Returns the dates that were done now. A date appears only once all of it is written."""
    spark = records.sparkSession
    try:
        done = {r[0] for r in spark.read.parquet(root).select(F.col(date).cast("date")).distinct().collect()}
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        done = set()
    dates = sorted({r[0] for r in records.select(F.col(date).cast("date")).distinct().collect()} - done)  # as many as target dates
    if dates:
        todo = records.where(F.col(date).cast("date").isin(dates))
        publish_panel(embed_ragged(todo, keys, load, weights, dim, columns, chunk_rows), root, date)
    return dates


def stat_features(windows: DataFrame, schema: EventSchema, date: str = "target_date") -> DataFrame:
    """Built-in encoder: counts, sums, moments, recency in days and the number of distinct
    values per category, one row per (client, date)."""
    age = F.date_diff(F.col(date), F.to_date(schema.time))
    aggs = [F.count(F.lit(1)).alias("n_events"), F.min(age).alias("recency_days"), F.max(age).alias("span_days")]
    for c in schema.numerics:
        v = F.col(c)
        aggs += [F.sum(v).alias(f"{c}_sum"), F.avg(v).alias(f"{c}_mean"), F.stddev_pop(v).alias(f"{c}_std"),
                 F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max")]
    out = windows.groupBy(schema.client, date).agg(*aggs)
    shares = windows.select(
        schema.client, date,
        F.inline(F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("string").alias("_v")) for i, c in enumerate(schema.categories)])),
    ).groupBy(schema.client, date, "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    shares = shares.where(F.col("_v").isNotNull()).groupBy(schema.client, date).agg(
        *[F.count_if(F.col("_c") == i).alias(f"{c}_distinct") for i, c in enumerate(schema.categories)],
        *[F.coalesce(F.max(F.when(F.col("_c") == i, F.col("_n"))), F.lit(0)).alias(f"{c}_top") for i, c in enumerate(schema.categories)],
    )
    # one row of each per window; a join would filter one side's clients and so compute the windows twice
    both = out.unionByName(shares, allowMissingColumns=True).groupBy(schema.client, date)
    out = both.agg(*[F.max(c).alias(c) for c in dict.fromkeys(out.columns + shares.columns) if c not in (schema.client, date)])
    return out.select(
        schema.client, date, "n_events", "recency_days", "span_days",
        *[f"{c}_{s}" for c in schema.numerics for s in ("sum", "mean", "std", "min", "max")],
        *[F.coalesce(F.col(f"{c}_distinct"), F.lit(0)).alias(f"{c}_distinct") for c in schema.categories],
        *[(F.coalesce(F.col(f"{c}_top"), F.lit(0)) / F.col("n_events")).alias(f"{c}_top_share") for c in schema.categories],
    )


def stat_panel(features: DataFrame, client: str, date: str = "target_date") -> DataFrame:
    """Statistical features as an embedding panel (client, date, emb)."""
    values = [c for c in features.columns if c not in (client, date)]
    return features.select(
        client, F.col(date).alias("date"), F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in values]).alias("emb")
    )
