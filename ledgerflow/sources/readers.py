"""Parquet readers and client-level selections."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions.scalars import hash60


def read_ledger(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if columns is None:
        return df
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return df.select(*columns)


def read_folds(spark: SparkSession, root: str, folds: Sequence[int], column: str = "fold") -> DataFrame:
    """Hive-partitioned scan; the fold test becomes a partition filter."""
    return spark.read.parquet(root).where(F.col(column).isin(*[int(f) for f in folds]))


def read_panel(spark: SparkSession, root: str, date: str = "date") -> DataFrame:
    """All published dates of an embedding panel; the date is a column or a partition."""
    df = spark.read.parquet(root)
    return df.withColumn(date, F.col(date).cast("date"))


def client_ids(df: DataFrame, client: str) -> DataFrame:
    return df.select(client).distinct()


def sample_clients(df: DataFrame, client: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct clients in seeded hash order; each task keeps only its own best ``n``."""
    ids = client_ids(df, client)
    return ids.orderBy(hash60(seed, client), client).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """``n`` rows in seeded hash order of their key."""
    return df.orderBy(hash60(seed, *key), *key).limit(n)


def rows_for_clients(
    df: DataFrame, ids: DataFrame, client: str, columns: Sequence[str] | None = None
) -> DataFrame:
    kept = df.join(ids.select(client), client, "left_semi")
    return kept.select(*columns) if columns else kept


_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``, or what was given to
    ``setCheckpointDir``. Only a local session may go without it; it gets a temporary folder,
    which is deleted when the process ends."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return shared
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH[app], ignore_errors=True)
    return _LOCAL_SCRATCH[app]


def materialise(df: DataFrame) -> DataFrame:
    """Compute once, reuse: write a Parquet table to the shared folder and read it back.

    The result survives lost executors, its plan is a bare scan whatever came before, and
    the planner knows its true size, so later joins broadcast it only while it really is
    below the broadcast threshold."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/ledgerflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Columns of a one-row aggregate on every row of ``df``. An aggregate without keys has
    exactly one row, which is what makes this broadcast safe at any size of ``df``."""
    one = F.lit(1).alias("_one_row")
    return df.select("*", one).join(F.broadcast(row.select("*", one)), "_one_row").drop("_one_row")
