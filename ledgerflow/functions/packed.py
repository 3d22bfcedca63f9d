"""Many columns as two: the codes of all categories of a row in one binary value, its numbers in one array."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.sources.readers import materialise


def code_type(most: int) -> str:
    """Smallest type for codes up to ``most``."""
    return "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"


def unpacked(codes: pa.Array, type_: str, width: int) -> np.ndarray:
    """Codes of a batch by row and category."""
    codes = codes.cast(pa.binary())
    n = len(codes)
    ends = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + n + 1] if n else np.zeros(1, np.int32)
    data = np.frombuffer(codes.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return data.view(type_).reshape(n, width)


@dataclass(frozen=True)
class Packed:
    """``rows`` (codes binary, values array<double>). A code is 0 for a missing value, else the position that
    ``book`` (column, value, position) gives a value of the column named second in ``categories``."""

    rows: DataFrame
    categories: list[tuple[str, str]]
    numbers: list[str]
    type: str
    sizes: dict[str, int]
    book: DataFrame | None

    def materialised(self) -> Packed:
        return replace(self, rows=materialise(self.rows))

    def category_counts(self) -> DataFrame:
        """(column, kind, s, d, n) of the categories, as ``profile.value_counts_long`` has them. Codes are counted
        inside the tasks and become text afterwards."""
        type_, width, dense = self.type, [self.sizes.get(c, 0) + 1 for _, c in self.categories], self.type != "<u4"

        def cells(at, codes, n):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (at, codes, n)], ["at", "code", "n"])

        def counted(batches):
            totals = None
            for batch in batches:
                codes = unpacked(batch.column(0), type_, len(width))
                if dense:
                    new = [np.bincount(codes[:, k], minlength=w) for k, w in enumerate(width)]
                    totals = new if totals is None else [a + b for a, b in zip(totals, new)]
                else:  # too many values for a table of all
                    each = [np.unique(codes[:, k], return_counts=True) for k in range(len(width))]
                    yield cells([np.full(len(c), k) for k, (c, _) in enumerate(each)], *zip(*each))
            if totals is not None:
                found = [np.flatnonzero(x) for x in totals]
                yield cells([np.full(len(c), k) for k, c in enumerate(found)], found, [x[c] for x, c in zip(totals, found)])

        counts = self.rows.select("codes").mapInArrow(counted, "at bigint, code bigint, n bigint").groupBy("at", "code").agg(F.sum("n").alias("n"))
        names, of = (F.array(*[F.lit(c[k]) for c in self.categories]) for k in (0, 1))
        counts = counts.select(F.get(names, F.col("at").cast("int")).alias("column"), F.get(of, F.col("at").cast("int")).alias("_of"), "code", "n")
        book = self.book.select(F.col("column").alias("_of"), F.col("position").alias("code"), F.col("value").alias("s"))
        return counts.join(book, ["_of", "code"], "left").select(
            "column", F.lit("categorical").alias("kind"), "s", F.lit(None).cast("double").alias("d"), "n")

    def numeric_cells(self) -> DataFrame:
        """(at, d): every value of every numeric column, by its place in ``numbers``."""
        return self.rows.select(F.posexplode("values").alias("at", "d"))

    def positions(self, kept: DataFrame) -> dict[str, list[int]]:
        """Of kept categories (column, value, code) the positions by column, in the order of their codes."""
        of = self.rows.sparkSession.createDataFrame(self.categories, "column string, _of string")
        book = self.book.select(F.col("column").alias("_of"), "value", "position")
        lists = kept.join(of, "column").join(book, ["_of", "value"]).groupBy("column").agg(
            F.array_sort(F.collect_list(F.struct("code", "position")))["position"].alias("positions"))
        return {r["column"]: list(r["positions"]) for r in lists.collect()}
