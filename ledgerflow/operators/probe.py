"""Probes on frozen embeddings with Spark ML: boosted trees, a small network, and the
selection protocol around them. The test rows are read once, after everything is chosen."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.operators.metrics import precision_recall_at, precision_recall_at_k, ranking_metrics
from ledgerflow.operators.panel import fit_standardiser, standardise
from ledgerflow.operators.targets import tune_cohort
from ledgerflow.sources.readers import attach_row, materialise

# Clip of standardised features, the tree baseline.
CLIP = 10.0


@dataclass(frozen=True)
class TreeParams:
    depth: int = 5
    min_rows: int = 300
    rate: float = 0.05
    subset: float = 1.0
    rounds: int = 20


@dataclass(frozen=True)
class MlpParams:
    hidden: int = 128
    rounds: int = 50
    rate: float = 0.03


def tree_candidates(seed: int, trials: int) -> list[TreeParams]:
    """The default settings, then ``trials - 1`` points that fill the ranges evenly: a Kronecker
    sequence, shifted by the seed. Leaf size and rate are spread on a logarithmic scale."""
    steps = (0.8566748838545029, 0.733891856627126, 0.6287067210378087, 0.5385972572236101)  # powers of 1/1.1673
    shift = (seed * 0.6180339887498949) % 1
    out = [TreeParams()]
    for i in range(1, trials):
        u = [(shift + i * s) % 1 for s in steps]
        depth, rows = 3 + int(5 * u[0]), round(40 * 40 ** u[1])
        out.append(TreeParams(depth, rows, round(0.02 * 6 ** u[2], 4), round(0.6 + 0.4 * u[3], 3)))
    return out


def _weighted(df: DataFrame, train: DataFrame, y: str) -> DataFrame:
    """``weight``: positives count neg / max(pos, 1) times, both counted over ``train`` alone."""
    n = train.agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_q"))
    w = F.when(F.col(y) == 1, F.col("_q") / F.greatest(F.col("_p"), F.lit(1))).otherwise(F.lit(1.0))
    return attach_row(df, n).withColumn("weight", w).drop("_p", "_q")


def _vectors(df: DataFrame, y: str, emb: str) -> DataFrame:
    v = array_to_vector(F.col(emb).cast("array<double>"))
    return df.withColumn("features", v).withColumn("label", F.col(y).cast("double"))


def score_with(model, df: DataFrame, emb: str) -> DataFrame:
    """``df`` with the model's ``score`` for the positive class."""
    v = df.withColumn("features", array_to_vector(F.col(emb).cast("array<double>")))
    out = model.transform(v)
    return out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).select(*df.columns, "score")


def fit_gbt_probe(
    train: DataFrame, val: DataFrame | None, y: str, emb: str, params: TreeParams, seed: int = 0, weighted: bool = True
) -> tuple[PipelineModel, int]:
    """Boosted trees for one binary target; with ``val``, boosting stops early on it.
    Returns the model and the number of rounds kept."""
    rows = train.withColumn("_val", F.lit(False))
    if val is not None:
        rows = rows.unionByName(val.withColumn("_val", F.lit(True)))
    rows = _vectors(_weighted(rows, train, y) if weighted else rows, y, emb)
    gbt = GBTClassifier(
        maxDepth=params.depth, maxIter=params.rounds, stepSize=params.rate, minInstancesPerNode=params.min_rows,
        featureSubsetStrategy=str(params.subset), seed=seed, maxBins=32,
    )
    if weighted:
        gbt.setWeightCol("weight")
    if val is not None:
        gbt.setValidationIndicatorCol("_val")
    model = gbt.fit(rows)
    return PipelineModel([model]), model.getNumTrees


def fit_mlp_probe(
    train: DataFrame, y: str, emb: str, dim: int, params: MlpParams, seed: int = 0
) -> tuple[PipelineModel, DataFrame]:
    """Two equal hidden layers on standardised, clipped features. The standardiser is fit on
    the train rows and returned with the model. Spark ML has no dropout, weight decay or
    class weights here; the protocol and the metrics are the contract, not the scores."""
    fitted = materialise(fit_standardiser(train, emb))
    rows = _vectors(standardise(train, fitted, emb, CLIP), y, emb)
    mlp = MultilayerPerceptronClassifier(
        layers=[dim, params.hidden, params.hidden, 2], maxIter=params.rounds, stepSize=params.rate, seed=seed
    )
    return PipelineModel([mlp.fit(rows)]), fitted


def test_metrics(scored: DataFrame, y: str, key: Sequence[str]) -> DataFrame:
    """One row: ranking metrics, precision and recall at 0.5 and in the top shares. Rows are scored
    once; the metrics read a table of key, label and score."""
    scored = materialise(scored.select(*dict.fromkeys([*key, y, "score"])))
    rank = ranking_metrics(scored, y, "score", [])
    at = precision_recall_at(scored, y, "score", []).select(
        F.col("precision").alias("precision_at_0_5"), F.col("recall").alias("recall_at_0_5")
    )
    top = precision_recall_at_k(scored, y, "score", [], key)
    cells = []
    for f, n in ((0.01, 1), (0.05, 5), (0.10, 10)):
        here = F.col("fraction") == f
        cells.append(F.max(F.when(here, F.col("precision"))).alias(f"precision_at_top_{n}pct"))
        cells.append(F.max(F.when(here, F.col("recall"))).alias(f"recall_at_top_{n}pct"))
    return attach_row(attach_row(rank, at), top.agg(*cells))


def _val_pr_auc(scored: DataFrame, y: str) -> float:
    return ranking_metrics(scored, y, "score", [], strict=True).first()["pr_auc"]


@dataclass
class Selection:
    """What the protocol chose, and its trail."""

    params: TreeParams
    rounds: int
    trials: list[tuple[int, float, int]] = field(default_factory=list)
    model: PipelineModel | None = None


def tune_and_test(
    panel: DataFrame, y: str, emb: str, client: str, key: Sequence[str], candidates: Sequence[TreeParams],
    tune_clients: int, seed: int = 0, save: Callable[[PipelineModel], None] | None = None, weighted: bool = False,
) -> tuple[DataFrame, DataFrame, Selection]:
    """Candidates are compared by validation average precision on a capped client cohort;
    the winner's rounds are chosen again on all train rows; then train and validation rows
    are fit together and the test rows scored once. ``weighted`` balances the classes in every fit.

    ``panel`` has ``role`` train/val/test. Returns (test metrics, trials, selection)."""
    panel = materialise(panel)
    train, val, test = (panel.where(F.col("role") == r).drop("role") for r in ("train", "val", "test"))
    tune = materialise(tune_cohort(train, client, tune_clients, seed))
    trials, best = [], None
    for i, params in enumerate(candidates):
        model, rounds = fit_gbt_probe(tune, val, y, emb, params, seed, weighted=weighted)
        ap = _val_pr_auc(score_with(model, val, emb), y)
        trials.append((i, ap, rounds))
        if best is None or ap > best[1]:
            best = (params, ap)
    params = best[0]
    _, rounds = fit_gbt_probe(train, val, y, emb, params, seed, weighted=weighted)
    final = TreeParams(params.depth, params.min_rows, params.rate, params.subset, max(1, rounds))
    model, _ = fit_gbt_probe(train.unionByName(val), None, y, emb, final, seed, weighted=weighted)
    if save is not None:
        save(model)
    metrics = test_metrics(score_with(model, test, emb), y, key)
    table = panel.sparkSession.createDataFrame(trials, "trial int, val_pr_auc double, rounds int")
    return metrics, table, Selection(params, rounds, trials, model)


def score_only(spark: SparkSession, path: str, test: DataFrame, y: str, emb: str, key: Sequence[str]) -> DataFrame:
    """Metrics of a saved model on test rows, without training."""
    return test_metrics(score_with(PipelineModel.load(path), test, emb), y, key)
