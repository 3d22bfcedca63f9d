"""Parquet and CSV sinks: sharded, checked, with lineage, and per-date publishing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerflow.functions.scalars import hash60, shard_of


def write_ledger(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_sharded(df: DataFrame, path: str, key: str, n: int, mode: str = "errorifexists") -> None:
    """One directory per hash shard. A shard is written by as many tasks as its rows
    need: the salt keeps a shard that holds a hot client from becoming one task."""
    sharded = df.withColumn("shard", shard_of(n, key))
    sharded.hint("rebalance", "shard").write.mode(mode).partitionBy("shard").parquet(path)


def write_checked(df: DataFrame, path: str, mode: str = "errorifexists", compression: str = "snappy") -> int:
    """Write, then compare rows going in (counted on the fly) with rows on disk."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    observed.write.mode(mode).option("compression", compression).parquet(path)
    written = df.sparkSession.read.parquet(path).count()
    if written != seen.get["rows"]:
        raise RuntimeError(f"{path}: {seen.get['rows']} rows in, {written} rows on disk")
    return written


def write_with_lineage(df: DataFrame, path: str, meta: dict, mode: str = "errorifexists") -> int:
    """zstd Parquet; lineage goes into the stored schema and into a one-row JSON side table."""
    text = json.dumps(meta, sort_keys=True)
    first, *rest = df.columns
    tagged = df.select(F.col(first).alias(first, metadata={"lineage": text}), *rest)
    rows = write_checked(tagged, path, mode, "zstd")
    lineage = df.sparkSession.range(1).select(F.lit(text).alias("value"))
    lineage.coalesce(1).write.mode("overwrite").text(f"{path}.lineage")
    return rows


def read_lineage(spark: SparkSession, path: str) -> dict:
    schema = spark.read.parquet(path).schema
    return json.loads(schema[0].metadata["lineage"])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Small report as one headed CSV part."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def publish_panel(df: DataFrame, root: str, date: str = "date", done: DataFrame | None = None) -> None:
    """Publish whole dates; dates in ``done`` are skipped, others are replaced atomically
    by the dynamic partition overwrite at job commit."""
    todo = df if done is None else df.join(done.select(date), date, "left_anti")
    (
        todo.hint("rebalance", date)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(date)
        .parquet(root)
    )


def pending(expected: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected parts that are not finished yet."""
    return expected.join(done.select(*keys).distinct(), list(keys), "left_anti")


def finalize_panel(parts: DataFrame, expected: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """All parts as one frame; every expected part must be marked complete (an empty
    part is complete with no rows)."""
    missing = pending(expected, completed, [key]).orderBy(key).limit(1).collect()
    if missing:
        raise FileNotFoundError(f"missing {key} {missing[0][0]}")
    return parts.join(expected.select(key), key, "left_semi")


def pending_work(expected: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts still to run, with the settings check: a finished part counts only if it
    ran with the settings wanted now; ``conflict`` marks parts finished under others."""
    done = ledger.groupBy(*keys).agg(
        F.max("settings").alias("_settings"),
        F.count_distinct("settings").alias("_variants"),
    )
    j = expected.join(done, list(keys), "left")
    clean = (F.col("_variants") == 1) & (F.col("_settings") == F.col("settings"))
    return (
        j.where(F.col("_variants").isNull() | ~clean)
        .withColumn("conflict", F.col("_variants").isNotNull())
        .drop("_settings", "_variants")
    )


def require_no_conflict(work: DataFrame) -> DataFrame:
    if work.where("conflict").limit(1).count():
        raise ValueError("finished parts were made with other settings")
    return work.drop("conflict")


def cohort_hash(keys: Sequence[str | Column], seed: str = "cohort") -> list[Column]:
    """Order-free fingerprint aggregates of a row set: row count, xor and sum of hashes."""
    h = hash60(seed, *keys)
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor(h).alias("hash_xor"),
        F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("hash_sum"),
    ]
