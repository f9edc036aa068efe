"""Rescoring of candidate pairs by a second scorer that reads the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions.similarity import jaro_winkler, token_set_ratio

#: A scorer takes two series of texts and gives probabilities. It is made once per Python worker.
Scorer = Callable[[list[str], list[str]], list[float]]


def pair_text(name: Column, address: Column, land: Column) -> Column:
    """The text of a record as scorers read it, the same in training and in use."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(blank(name), F.lit(" | "), blank(address), F.lit(" ["), blank(land), F.lit("]"))


def similarity_scorer() -> Scorer:
    """The scorer that is always at hand: names by Jaro-Winkler, addresses by their sets of words."""

    def score(a: list[str], b: list[str]) -> list[float]:
        out = []
        for x, y in zip(a, b):
            (n1, _, r1), (n2, _, r2) = x.lower().partition(" | "), y.lower().partition(" | ")
            z = 9.0 * jaro_winkler(n1, n2) + 3.0 * token_set_ratio(r1, r2) / 100.0 - 9.0
            out.append(float(1.0 / (1.0 + pow(2.718281828459045, -z))))
        return out

    return score


def _scored(pairs: DataFrame, make: Callable[[], Scorer]) -> DataFrame:
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = make()
        for a, b in batches:
            yield pd.Series(scorer(a.tolist(), b.tolist()), dtype="float64")

    return pairs.withColumn("p_second", F.pandas_udf(run, "double")("text_l", "text_r"))


def with_pair_texts(scored: DataFrame, index: DataFrame, pool: DataFrame) -> DataFrame:
    """``text_l`` and ``text_r`` of each pair; an id that is in no table has an empty text."""
    side = lambda d, i, t: d.select(F.col("entity_id").alias(i), pair_text(F.col("business_name"), F.col("business_address"), F.col("country")).alias(t))
    out = scored.join(side(index, "s1", "text_l"), "s1", "left").join(side(pool, "cand", "text_r"), "cand", "left")
    return out.withColumns({"text_l": F.coalesce("text_l", F.lit("")), "text_r": F.coalesce("text_r", F.lit(""))})


def cascade(scored: DataFrame, index: DataFrame, pool: DataFrame, low: float = 0.15, high: float = 0.70, weight: float = 0.50, make: Callable[[], Scorer] = similarity_scorer) -> DataFrame:
    """``p`` mixed with the second scorer's where ``low < p < high``; the others never reach it."""
    open_ = (F.col("p") > low) & (F.col("p") < high)
    columns = scored.columns
    some = _scored(with_pair_texts(scored.where(open_), index, pool), make).withColumn("p", (1 - weight) * F.col("p") + weight * F.col("p_second"))
    return scored.where(~open_ | F.col("p").isNull()).unionByName(some.select(columns))


def full_rescore(scored: DataFrame, index: DataFrame, pool: DataFrame, weight: float = 0.60, make: Callable[[], Scorer] = similarity_scorer) -> DataFrame:
    """``p`` of all pairs mixed with the second scorer's."""
    columns = scored.columns
    return _scored(with_pair_texts(scored, index, pool), make).withColumn("p", (1 - weight) * F.col("p") + weight * F.col("p_second")).select(columns)


def from_logits(logits: Column, labels: int = 1) -> Column:
    """The probability from a model's raw outputs: one output by the sigmoid, two by the softmax, else the first's sigmoid."""
    sigmoid = lambda x: 1.0 / (1.0 + F.exp(-x))
    if labels == 2:
        a, b = F.get(logits, F.lit(0)), F.get(logits, F.lit(1))
        return sigmoid(b - a)
    return sigmoid(F.get(logits, F.lit(0)))
