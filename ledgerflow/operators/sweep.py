"""How well matching recovers known columns under noise: a job that can be stopped and gone on
with. Every (copy, mixing weight) is a part of a run ledger; what is finished is never done
again, and parts made under other settings are refused."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators import match, noise, profile
from ledgerflow.schema import ColumnSpec
from ledgerflow.sources.readers import materialise
from ledgerflow.sources.writers import pending_work, require_no_conflict

# The grid of the full sweep.
ALPHAS = tuple(i / 10 for i in range(11))
SEEDS = (0, 1, 2)
RESTARTS = 5
CASES_A_PART = 4

_RUNS = "case string, alpha double, settings string, part string"


def sweep_cases(conditions: Sequence[str] = tuple(noise.NOISE_LEVELS), seeds: Sequence[int] = SEEDS) -> list[tuple[str, float, float, int]]:
    """(case, numeric strength, category probability, seed) of every noisy copy; the one without
    noise has no seeds to differ by."""
    out = []
    for name in conditions:
        lam, p = noise.NOISE_LEVELS[name]
        out += [(f"{name}/{seed}", lam, p, seed) for seed in (seeds if lam or p else (0,))]
    return out


def _table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def case_problems(
    df: DataFrame, specs: Sequence[ColumnSpec], names: dict[str, str], key: Sequence[str], cases: Sequence[tuple[str, float, float, int]]
) -> DataFrame:
    """One matching problem per noisy copy of ``df`` against itself; a copy's column c is named
    ``names[c]``. All copies are columns of one table, each distinct one once, packed into two, so they
    are corrupted in one pass, profiled together and paired in one pass. Passports and
    dependences of shared columns are handed out to the copies afterwards."""
    df = materialise(df)
    clean, dependency = profile.matching_source(df, specs)
    wide, own = noise.packed_variants(df, specs, clean, cases, key)
    plain = [s.name for s in specs]
    pairs = dict.fromkeys((own[c[0], a], own[c[0], b]) for c in cases for i, a in enumerate(plain) for b in plain[i + 1:])
    passports, dependencies = profile.packed_source(wide.materialised(), list(pairs))
    spark = df.sparkSession
    # one row per case and column, or pair of columns
    owners = spark.createDataFrame([(own[c[0], n], c[0], names[n]) for c in cases for n in plain], "source string, case string, name string")
    d = match.passport_distance(passports, clean).join(owners, "source")
    d = d.select("case", F.col("name").alias("source"), *[c for c in d.columns if c not in ("source", "case", "name")])
    left = owners.select(F.col("source").alias("i"), "case", F.col("name").alias("_i"))
    right = owners.select(F.col("source").alias("j"), "case", F.col("name").alias("_j"))
    x = match.symmetric(dependencies).join(left, "i").join(right, ["j", "case"]).select("case", F.col("_i").alias("i"), F.col("_j").alias("j"), "c")
    every = F.explode(F.array(*[F.lit(c[0]) for c in cases])).alias("case")
    return match.match_problems(materialise(d), x, match.symmetric(dependency).select(every, "*"))


def run_sweep(
    df: DataFrame, specs: Sequence[ColumnSpec], names: dict[str, str], key: Sequence[str], out: str,
    cases: Sequence[tuple[str, float, float, int]], alphas: Sequence[float] = ALPHAS, n_init: int = RESTARTS,
    settings: dict | None = None, most_parts: int | None = None,
) -> DataFrame:
    """Runs what the ledger below ``out`` lacks and returns ``sweep_recoveries``.

    ``settings`` are the caller's own (input, sample); a part finished under others raises.
    Results of a few cases at a time are written, then entered in the ledger; results without
    an entry, from a job that died between, are not read. ``most_parts`` ends the job early."""
    spark = df.sparkSession
    config = json.dumps({
        "alphas": list(map(float, alphas)), "n_init": n_init, "cases": [list(c) for c in cases], "names": names,
        "columns": [[s.name, s.kind] for s in specs], "own": settings or {},
    }, sort_keys=True)
    expected = spark.createDataFrame([(c[0], float(a), config) for c in cases for a in alphas], "case string, alpha double, settings string")
    ledger = _table(spark, f"{out}/runs", _RUNS)
    ledger = spark.createDataFrame([], _RUNS) if ledger is None else ledger
    todo: dict[str, list[float]] = {}
    for r in require_no_conflict(pending_work(expected, ledger, ["case", "alpha"])).collect():  # at most the grid
        todo.setdefault(r["case"], []).append(r["alpha"])
    if todo:
        stored = _table(spark, f"{out}/problems")
        have = set() if stored is None else {r[0] for r in stored.where(F.col("settings") == config).select("case").distinct().collect()}
        missing = [c for c in cases if c[0] in todo and c[0] not in have]
        if missing:
            case_problems(df, specs, names, key, missing).withColumn("settings", F.lit(config)).write.mode("append").parquet(f"{out}/problems")
        problems = spark.read.parquet(f"{out}/problems").where(F.col("settings") == config).drop("settings").dropDuplicates(["case"])
        truth = spark.createDataFrame([(s.name, s.kind, names[s.name]) for s in specs], "target string, kind string, truth string")
        groups: dict[tuple, list[str]] = {}
        for case, own in sorted(todo.items()):
            groups.setdefault(tuple(sorted(own)), []).append(case)
        parts = [(own, some[i : i + CASES_A_PART]) for own, some in groups.items() for i in range(0, len(some), CASES_A_PART)]
        for own, some in parts[:most_parts]:
            _run_part(spark, problems.where(F.col("case").isin(some)), truth, own, n_init, config, out)
    return sweep_recoveries(spark, out)


def _run_part(spark, problems, truth, alphas, n_init, config, out) -> None:
    part = uuid.uuid4().hex
    problems = materialise(problems)
    solved = materialise(match.solve_plans(problems, alphas, n_init=n_init))
    d = problems.select("case", F.inline("pairs"))
    chosen = match.match_columns(d, solved)
    true_pair = d.select("case", F.col("source").alias("truth"), "target", F.col("allowed").alias("truth_allowed"), F.col("distance").alias("truth_distance"))
    rows = chosen.select("case", "alpha", "target", F.col("source").alias("recovered"), "status", "candidate_count").join(truth, "target")
    rows = rows.join(true_pair, ["case", "target", "truth"], "left")
    facts = solved.select("case", "alpha", "objective", "feature_loss", "structure_loss", "gap", "converged", F.lit(n_init).alias("optimizer_starts"))
    rows.withColumn("part", F.lit(part)).write.mode("append").parquet(f"{out}/recovery")
    facts.withColumn("part", F.lit(part)).write.mode("append").parquet(f"{out}/solved")
    facts.select("case", "alpha", F.lit(config).alias("settings"), F.lit(part).alias("part")).coalesce(1).write.mode("append").parquet(f"{out}/runs")


def sweep_recoveries(spark: SparkSession, out: str) -> DataFrame:
    """Every field of every finished run: case, alpha, target, kind, truth, recovered and the rest."""
    done = spark.read.schema(_RUNS).parquet(f"{out}/runs").select("case", "alpha", "part").distinct()
    return spark.read.parquet(f"{out}/recovery").join(done, ["case", "alpha", "part"], "left_semi").drop("part")


def sweep_runs(spark: SparkSession, out: str) -> DataFrame:
    """One row per finished run: its solver facts, and its recovery in total and by kind."""
    done = spark.read.schema(_RUNS).parquet(f"{out}/runs").select("case", "alpha", "part").distinct()
    facts = spark.read.parquet(f"{out}/solved").join(done, ["case", "alpha", "part"], "left_semi").drop("part")
    metrics = match.recovery_by_kind(sweep_recoveries(spark, out), ["case", "alpha"])
    return metrics.join(facts, ["case", "alpha"]).withColumn("condition", F.substring_index("case", "/", 1))


def sweep_report(runs: DataFrame) -> DataFrame:
    """Means over the noise seeds per (condition, alpha), with the spread of both accuracies."""
    return runs.groupBy("condition", "alpha").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("accuracy").alias("accuracy_mean"), F.stddev_samp("accuracy").alias("accuracy_sd"),
        F.avg("categorical_accuracy").alias("categorical_accuracy_mean"), F.stddev_samp("categorical_accuracy").alias("categorical_accuracy_sd"),
        F.avg("coverage").alias("coverage_mean"), F.avg("unfilled_rate").alias("unfilled_rate_mean"),
        F.avg("truth_filtered").alias("truth_filtered_mean"), F.count_if("converged").alias("converged_runs"),
    )
