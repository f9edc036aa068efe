"""Training and choosing the scorer of candidate pairs."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.operators.decide import decide
from samewise.operators.evaluate import macro_f05
from samewise.operators.features import FEATURES
from samewise.operators.sampling import folds, sample, unit
from samewise.session import cut

#: Settings of the boosted trees: the careful and the fast preset.
PRESETS = {"careful": {"stepSize": 0.06, "minInstancesPerNode": 50}, "fast": {"stepSize": 0.08, "minInstancesPerNode": 100}}


def _assemble(names: tuple[str, ...]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="keep")


def fit_gbt(rows: DataFrame, names: tuple[str, ...] = FEATURES, rounds: int = 40, preset: str = "careful", depth: int = 5, seed: int = 0, validation: str | None = None) -> PipelineModel:
    """Boosted trees on ``y``; with a ``validation`` column (true for held-out rows) they stop early."""
    p = PRESETS[preset]
    gbt = GBTClassifier(labelCol="y", featuresCol="features", maxIter=rounds, maxDepth=depth, stepSize=p["stepSize"], minInstancesPerNode=p["minInstancesPerNode"], subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[_assemble(names), gbt]).fit(rows)


def fit_mlp(rows: DataFrame, names: tuple[str, ...] = FEATURES, hidden: int = 32, rounds: int = 100, seed: int = 0) -> PipelineModel:
    """A small neural network on the scaled features."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), MultilayerPerceptronClassifier(labelCol="y", layers=[len(names), hidden, 2], maxIter=rounds, seed=seed)]).fit(rows)


def probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with ``p``, the probability of a match."""
    keep = rows.columns
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).select(*keep, "p")


def best_rounds(model: PipelineModel) -> int:
    """Trees of a model; after early stopping those up to the best on the held-out rows."""
    return model.stages[-1].getNumTrees


def fit_stopping(rows: DataFrame, names: tuple[str, ...] = FEATURES, held: float = 0.15, seed: int = 1, **settings: object) -> PipelineModel:
    """Boosted trees that stop early on the rows of a share ``held`` of the ``s1``; plain ones if either part would lack a class."""
    parts = rows.withColumn("held", unit("s1", seed) < held)
    if parts.where("y is not null").select("held", "y").distinct().count() < 4:
        return fit_gbt(rows, names, **settings)
    return fit_gbt(parts, names, validation="held", **settings)


def fit_folds(rows: DataFrame, n: int = 4, names: tuple[str, ...] = FEATURES, **settings: object) -> tuple[DataFrame, list[int]]:
    """``p`` of each row by a model that saw no row of its ``s1``, and the best rounds of each fold's model."""
    parts = cut(folds(rows, "s1", n), "folds")
    out, rounds = None, []
    for k in range(n):
        train, test = parts.where(F.col("fold") != k), parts.where(F.col("fold") == k)
        model = fit_stopping(train, names, **settings)
        rounds.append(best_rounds(model))
        some = probability(model, test)
        out = some if out is None else out.unionByName(some)
    return out.drop("fold"), rounds


def out_of_fold(rows: DataFrame, n: int = 4, names: tuple[str, ...] = FEATURES, **settings: object) -> DataFrame:
    """The first of :func:`fit_folds`."""
    return fit_folds(rows, n, names, **settings)[0]


def leave_country_out(rows: DataFrame, names: tuple[str, ...] = FEATURES, most: int = 1000, **settings: object) -> DataFrame:
    """``p`` of the rows of each ``country`` with a match by a model that saw none of it; more than ``most`` countries are an error."""
    lands = [r[0] for r in rows.groupBy("country").agg(F.sum("y").alias("k")).where("k > 0").select("country").orderBy("country").limit(most + 1).collect()]
    if len(lands) > most:
        raise ValueError(f"more than {most} countries, each of which would need a model")
    out = None
    for land in lands if len(lands) > 1 else ():
        some = probability(fit_gbt(rows.where(F.col("country") != land), names, **settings), rows.where(F.col("country") == land))
        out = some if out is None else out.unionByName(some)
    return out if out is not None else rows.withColumn("p", F.lit(0.0)).limit(0)


def decision_grid(thresholds: tuple[float, ...], pmins: tuple[float, ...] = (0.25, 0.35, 0.45, 0.55), ceils: tuple[float, ...] = (0.95, 0.99)) -> list[dict]:
    """The decision rules to compare, thresholds first; of equal ones the first wins."""
    return [{"mode": "thr", "thr": t} for t in thresholds] + [{"mode": "ef", "pmin": a, "ceil": b} for a in pmins for b in ceils]


def grid_search(scored: DataFrame, truth: DataFrame, entities: DataFrame, grid: list[dict]) -> DataFrame:
    """``rule, setting, macro_f05`` of each decision rule, as one plan."""
    out = None
    for k, g in enumerate(grid):
        score = macro_f05(decide(scored, **g), truth, entities).select(F.lit(k).alias("rule"), F.lit(" ".join(f"{a}={b}" for a, b in g.items())).alias("setting"), "macro_f05")
        out = score if out is None else out.unionByName(score)
    return out


def final_rounds(best: list[int]) -> int:
    """Rounds of the refit on all rows from the best rounds of the folds."""
    return int(sum(best) / len(best) * 1.1)


def importances(model: PipelineModel, names: tuple[str, ...] = FEATURES, most: int = 15) -> list[tuple[str, float]]:
    """The features by how much the trees gain from them."""
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, map(float, values)), key=lambda x: (-x[1], x[0]))[:most]


def holdout(truth: DataFrame, n: int = 50_000, seed: int = 0) -> DataFrame:
    """``s1`` of the records kept for validation; no training may see them."""
    ids = truth.select(F.col("source1_entity_id").alias("s1")).distinct()
    return sample(ids, "s1", n, seed)
