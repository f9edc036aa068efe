"""From probabilities to each record's set of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Largest probability that counts when "no match at all" is weighed.
CERTAIN = 1 - 1e-6


def one_to_one(scored: DataFrame) -> DataFrame:
    """Each candidate keeps the Source 1 record with the highest ``p``; then the better ``score``, then the smaller id."""
    tie = [F.desc("score")] if "score" in scored.columns else []
    w = Window.partitionBy("cand").orderBy(F.desc("p"), *tie, "s1")
    return scored.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def by_threshold(scored: DataFrame, thr: float = 0.5) -> DataFrame:
    """``s1, cand, p, ord`` of the candidates with ``p`` of the threshold or more, in the order of their ids."""
    kept = one_to_one(scored).where(F.col("p") >= thr)
    return kept.select("s1", "cand", "p", F.row_number().over(Window.partitionBy("s1").orderBy("cand")).alias("ord"))


def expected_f05(scored: DataFrame, pmin: float = 0.05, ceil: float = 0.99) -> DataFrame:
    """The same for the set with the highest expected F0.5, if that is above the chance of no match at all.

    With the candidates in the order of their probability, ``ef`` of the first ``k`` is
    ``1.25 * sum(p_1..k) / (0.25 * sum(p) / ceil + k)``. The smallest ``k`` with the highest ``ef`` wins.
    """
    d = one_to_one(scored).where(F.col("p") >= pmin)
    by = Window.partitionBy("s1")
    order = by.orderBy(F.desc("p"), "cand")
    d = d.withColumns({"k": F.row_number().over(order), "run": F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, 0)), "whole": F.sum("p").over(by), "p0": F.exp(F.sum(F.log1p(-F.least("p", F.lit(CERTAIN)))).over(by))})
    d = d.withColumn("ef", F.round(1.25 * F.col("run") / (0.25 * F.col("whole") / ceil + F.col("k")), 12))
    top = F.max(F.struct("ef", (-F.col("k")).alias("k"))).over(by)
    d = d.withColumns({"__best": -top["k"], "__ef": top["ef"]})
    return d.where((F.col("__ef") > F.col("p0")) & (F.col("k") <= F.col("__best"))).select("s1", "cand", "p", F.col("k").alias("ord"))


def decide(scored: DataFrame, mode: str = "ef", thr: float = 0.5, pmin: float = 0.05, ceil: float = 0.99) -> DataFrame:
    return by_threshold(scored, thr) if mode == "thr" else expected_f05(scored, pmin, ceil)


def id_lists(decided: DataFrame, ids: DataFrame, key: str = "s1") -> DataFrame:
    """``s1, ids`` for every id, the list in the order of ``ord``, without repeats; no match gives an empty list."""
    items = F.array_sort(F.collect_list(F.struct("ord", "cand")))
    lists = decided.groupBy("s1").agg(F.array_distinct(F.transform(items, lambda x: x["cand"])).alias("ids"))
    return ids.select(F.col(key).alias("s1")).join(lists, "s1", "left").select("s1", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
