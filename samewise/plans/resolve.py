"""The pipeline from prepared sources to each record's matches."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.config import ErConfig
from samewise.operators import blocking, decide, evaluate, features, model, rerank, sampling
from samewise.session import cut
from samewise.sources.sinks import write_metadata


def candidates(index: DataFrame, pool: DataFrame, cfg: ErConfig | None = None) -> DataFrame:
    cfg = cfg or ErConfig()
    raw = blocking.block(index, pool, cfg.k, cfg.threshold, cfg.max_df, cfg.strategy)
    return blocking.prune(raw, **asdict(cfg.prune))


def baseline_probability(pairs: DataFrame) -> DataFrame:
    """A probability from the retrieval score alone, for use before a model is trained."""
    return pairs.withColumn("p", F.round(1.0 / (1.0 + F.exp(-(8.0 * F.col("score") - 8.0))), 6))


def train(index: DataFrame, pool: DataFrame, truth: DataFrame, cfg: ErConfig | None = None, rounds: int = 40, path: str | None = None) -> tuple[PipelineModel, dict]:
    """A scorer and the decision rule that does best out of fold. The index is always whole.

    Each fold stops early on held-out records, at ``rounds`` at most; the refit on all rows has 1.1 times their mean of
    best rounds. ``truth`` has ``s1, cand``. With a ``path`` model and metadata are stored there.
    """
    cfg = cfg or ErConfig()
    known = truth.select("s1").distinct()
    pairs = candidates(index, pool, cfg).join(known, "s1", "left_semi")
    rows = cut(sampling.labelled(features.features(pairs, index, pool), truth), "training")
    oof, best = model.fit_folds(rows, rounds=rounds)
    oof = cut(oof.select("s1", "cand", "score", "p"), "scored")
    grid = model.decision_grid(tuple(round(0.35 + 0.05 * k, 2) for k in range(10)))
    scores = model.grid_search(oof, truth, known, grid).orderBy(F.desc("macro_f05"), "rule").collect()
    rule, last = grid[scores[0]["rule"]], max(1, model.final_rounds(best))
    fitted = model.fit_gbt(rows, rounds=last)
    meta = {"features": list(features.FEATURES), "decision": rule, "prune": asdict(cfg.prune), "K": cfg.k, "rounds": last, "macro_f05": scores[0]["macro_f05"], "importances": model.importances(fitted)}
    if path:
        fitted.write().overwrite().save(f"{path}/model")
        write_metadata(meta, f"{path}/model_meta.json")
    return fitted, meta


def resolve(index: DataFrame, pool: DataFrame, scorer: PipelineModel | None = None, cfg: ErConfig | None = None) -> DataFrame:
    """``s1, ids`` of every index record: block, prune, featurise, score, rescore, decide. One lazy plan.

    Without a scorer the retrieval score decides.
    """
    cfg = cfg or ErConfig()
    pairs = candidates(index, pool, cfg)
    if scorer is None:
        scored = baseline_probability(pairs).select("s1", "cand", "score", "p")
    else:
        scored = model.probability(scorer, features.features(pairs, index, pool)).select("s1", "cand", "score", "p")
    c = cfg.cascade
    if cfg.rerank == "cascade":
        scored = rerank.cascade(scored, index, pool, c.low, c.high, c.weight)
    elif cfg.rerank == "full":
        scored = rerank.full_rescore(scored, index, pool, c.full_weight)
    d = cfg.decision
    decided = decide.by_threshold(scored, d.thr) if d.mode == "thr" else decide.expected_f05(scored, d.pmin, d.ceil)
    return decide.id_lists(decided, index.select(F.col("entity_id").alias("s1")))


def evaluate_blocking(index: DataFrame, pool: DataFrame, truth: DataFrame, entities: DataFrame, cfg: ErConfig | None = None) -> DataFrame:
    return evaluate.blocking_report(candidates(index, pool, cfg), truth, entities)
