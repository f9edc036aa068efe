"""Samples, folds and splits that are the same on every run and in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(c: str, seed: int = 0) -> Column:
    """A pseudo-random order of ids by MD5, which any engine can repeat."""
    return F.md5(F.concat(F.coalesce(F.col(c), F.lit("")), F.lit(f"|{seed}")))


def sample(df: DataFrame, c: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, in the order of their keys; ties go by the id. All rows if there are fewer."""
    return df.orderBy(order_key(c, seed), c).limit(n)


def unit(c: str, seed: int = 0) -> Column:
    """A number in [0, 1) of the id: the first 28 bits of its key."""
    return F.conv(F.substring(order_key(c, seed), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))


def folds(df: DataFrame, c: str, n: int = 4, seed: int = 0) -> DataFrame:
    """A column ``fold``: rows of one id are in one fold."""
    return df.withColumn("fold", F.floor(unit(c, seed) * n).cast("int"))


def group_split(df: DataFrame, c: str, train: float = 0.85, seed: int = 0) -> DataFrame:
    """A column ``is_train``: rows of one id are on one side."""
    return df.withColumn("is_train", (unit(c, seed) < train).cast("int"))


def negative_plan(pool: DataFrame, pairs: DataFrame, sampled: DataFrame, ratio: float = 1.5, hard_share: float = 0.7, seed: int = 0) -> DataFrame:
    """``entity_id, kind`` of the pool records to train on.

    ``true`` are matched to a sampled record; ``hard`` are matched to another, ``easy`` to none; of these as many
    as ``ratio`` says for each true one, ``hard_share`` of them hard.
    """
    ids = pool.select("entity_id").distinct()
    of = lambda p: p.select(F.col("cand").alias("entity_id")).distinct()
    mine = of(pairs.join(sampled.select("s1").distinct(), "s1", "left_semi"))
    true = ids.join(mine, "entity_id", "left_semi")
    n = int(ratio * true.count())
    n_hard = int(n * hard_share)
    matched = ids.join(of(pairs), "entity_id", "left_semi")
    hard = sample(matched.join(mine, "entity_id", "left_anti"), "entity_id", n_hard, seed)
    easy = sample(ids.join(of(pairs), "entity_id", "left_anti"), "entity_id", n - n_hard, seed)
    tag = lambda d, k: d.withColumn("kind", F.lit(k))
    return tag(true, "true").unionByName(tag(hard, "hard")).unionByName(tag(easy, "easy"))


def hard_negatives(candidates: DataFrame, pairs: DataFrame, n: int = 2) -> DataFrame:
    """``s1, cand, y``: the true pairs, and of each record the ``n`` best-scored candidates that are none."""
    false = candidates.join(pairs.select("s1", "cand"), ["s1", "cand"], "left_anti")
    w = Window.partitionBy("s1").orderBy(F.desc("score"), "cand")
    worst = false.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("s1", "cand", F.lit(0).alias("y"))
    return pairs.select("s1", "cand", F.lit(1).alias("y")).distinct().unionByName(worst)


def labelled(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidates with ``y``: 1 for true pairs. Repeated pairs do not multiply rows."""
    return candidates.join(pairs.select("s1", "cand", F.lit(1).alias("y")).distinct(), ["s1", "cand"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
