"""Metrics of candidates and of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truth_pairs(truth: DataFrame, s1: str = "source1_entity_id", ids: str = "matched_entity_ids") -> DataFrame:
    """``s1, cand`` of comma-separated lists; empty places are no pairs."""
    return truth.select(F.col(s1).alias("s1"), F.explode(F.split(F.coalesce(F.col(ids), F.lit("")), ",")).alias("cand")).where("cand <> ''")


def per_entity(pred: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """``s1, np, nt, tp`` of every entity: sizes of its prediction and truth, and of what they share."""
    both = pred.select("s1", "cand", F.lit(1).alias("p"), F.lit(0).alias("t")).distinct().unionByName(truth.select("s1", "cand", F.lit(0).alias("p"), F.lit(1).alias("t")).distinct())
    pair = both.groupBy("s1", "cand").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    sums = pair.groupBy("s1").agg(F.sum("p").alias("np"), F.sum("t").alias("nt"), F.sum(F.col("p") * F.col("t")).alias("tp"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return entities.select("s1").distinct().join(sums, "s1", "left").select("s1", zero("np"), zero("nt"), zero("tp"))


def f05() -> Column:
    """F0.5 of one entity from ``np, nt, tp``; an entity without truth scores 1 for no prediction, else 0."""
    p, r = F.col("tp") / F.col("np"), F.col("tp") / F.col("nt")
    return F.when(F.col("nt") == 0, (F.col("np") == 0).cast("double")).when(F.col("tp") == 0, F.lit(0.0)).otherwise(1.25 * p * r / (0.25 * p + r))


def macro_f05(pred: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    return per_entity(pred, truth, entities).agg(F.round(F.avg(f05()), 6).alias("macro_f05"), F.count("*").alias("n"))


def micro(pred: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """Precision and recall over all pairs, and how many entities without a match were left without."""
    e = per_entity(pred, truth, entities).agg(F.sum("tp").alias("tp"), F.sum(F.col("np") - F.col("tp")).alias("fp"), F.sum(F.col("nt") - F.col("tp")).alias("fn"), F.sum((F.col("nt") == 0).cast("long")).alias("singletons"), F.sum(((F.col("nt") == 0) & (F.col("np") == 0)).cast("long")).alias("singletons_right"))
    tiny = 1e-9
    return e.withColumns({"precision": F.round(F.col("tp") / (F.col("tp") + F.col("fp") + tiny), 6), "recall": F.round(F.col("tp") / (F.col("tp") + F.col("fn") + tiny), 6), "singleton_accuracy": F.round(F.col("singletons_right") / (F.col("singletons") + tiny), 6)})


def blocking_report(candidates: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """Recall of the candidates, candidates per entity, and the F0.5 of a perfect choice among them."""
    e = per_entity(candidates, truth, entities)
    r = F.col("tp") / F.col("nt")
    oracle = F.when(F.col("nt") == 0, 1.0).when(F.col("tp") > 0, 1.25 * r / (0.25 + r)).otherwise(0.0)
    return e.agg(F.round(F.sum("tp") / F.sum("nt"), 6).alias("recall"), F.round(F.avg("np"), 6).alias("avg_cands"), F.round(F.avg(oracle), 6).alias("oracle_f05"))


def prune_sweep(candidates: DataFrame, truth: DataFrame, entities: DataFrame, margins: tuple[float, ...] = (0.0, 0.05, 0.1, 0.2), floors: tuple[float, ...] = (0.0, 0.15, 0.25), max_rank: int = 10) -> DataFrame:
    """The report for each margin and floor, in one pass: a candidate is exploded to the settings that keep it."""
    grid = F.array(*[F.struct(F.lit(m).alias("margin"), F.lit(f).alias("floor")) for m in margins for f in floors])
    mine = candidates.where(F.col("rank") < max_rank).join(entities.select("s1").distinct(), "s1", "left_semi")
    kept = F.filter(grid, lambda g: (F.col("best") >= g["floor"]) & (F.col("score") >= F.col("best") - g["margin"]))
    hit = truth.select("s1", "cand", F.lit(1).alias("t")).distinct()
    rows = mine.join(hit, ["s1", "cand"], "left").select("s1", "t", F.explode(kept).alias("g")).groupBy("g", "s1").agg(F.count("*").alias("np"), F.coalesce(F.sum("t"), F.lit(0)).alias("tp"))
    sizes = entities.select("s1").distinct().join(truth.distinct().groupBy("s1").agg(F.count("*").alias("nt")), "s1", "left").select("s1", F.coalesce("nt", F.lit(0)).alias("nt"), F.explode(grid).alias("g"))
    e = sizes.join(rows, ["g", "s1"], "left").select("g", "nt", F.coalesce("np", F.lit(0)).alias("np"), F.coalesce("tp", F.lit(0)).alias("tp"))
    r = F.col("tp") / F.col("nt")
    oracle = F.when(F.col("nt") == 0, 1.0).when(F.col("tp") > 0, 1.25 * r / (0.25 + r)).otherwise(0.0)
    return e.groupBy("g.margin", "g.floor").agg(F.round(F.sum("tp") / F.sum("nt"), 6).alias("recall"), F.round(F.avg("np"), 6).alias("avg_cands"), F.round(F.avg(oracle), 6).alias("oracle_f05"))


def misses(kept: DataFrame, raw: DataFrame, truth: DataFrame, pool: DataFrame) -> DataFrame:
    """``s1, cand, pruned, country, no_address, is_s3`` of the true pairs that the kept candidates lack."""
    gone = truth.select("s1", "cand").distinct().join(kept.select("s1", "cand"), ["s1", "cand"], "left_anti")
    seen = raw.select("s1", "cand", F.lit(1).alias("pruned")).distinct()
    facts = pool.select(F.col("entity_id").alias("cand"), "country", (F.col("addr") == "").cast("int").alias("no_address"))
    return gone.join(seen, ["s1", "cand"], "left").join(facts, "cand", "left").select("s1", "cand", F.coalesce("pruned", F.lit(0)).alias("pruned"), "country", "no_address", F.col("cand").startswith("S3-").cast("int").alias("is_s3"))


def miss_report(found: DataFrame) -> DataFrame:
    """Misses by country: how many, how many of them were pruned, without address, of Source 3."""
    return found.groupBy("country").agg(F.count("*").alias("misses"), F.sum("pruned").alias("pruned"), F.round(F.avg("no_address"), 6).alias("no_address_share"), F.round(F.avg("is_s3"), 6).alias("s3_share"))


def prediction_stats(lists: DataFrame, entities: DataFrame) -> DataFrame:
    """Matches per entity and the share without, by country. ``lists`` has ``s1, ids``, ``entities`` ``s1, country``."""
    d = lists.join(entities, "s1")
    return d.groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg(F.size("ids")), 6).alias("avg_matches"), F.round(F.avg((F.size("ids") == 0).cast("double")), 6).alias("empty_share"))
