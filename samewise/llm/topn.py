"""The N highest-scoring items of every group, also where single groups hold much of the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.operators.hot import PARTS, hot_keys

#: Histogram bins for each factor of e of the score's size.
BINS_PER_E = 32


def score_bin(score: Column) -> Column:
    """A bin that never decreases with the score, for any double but NaN: logarithmic in the size, signed."""
    size = F.abs(score)
    log = F.when(size == float("inf"), F.lit(40_000)).otherwise(F.floor(F.log(size) * BINS_PER_E)).cast("int") + F.lit(50_000)
    return F.when(score == 0, F.lit(0)).when(score > 0, log).otherwise(-log)


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 5, hot_parts: int = PARTS) -> DataFrame:
    """``group, item, score`` of the ``n`` items with the highest score of each group; rank is ``rank``.

    * An item that occurs several times in a group counts once, with its highest score.
    * Scores that are NULL or NaN do not count; rows with a NULL group or item neither.
    * Of equal scores the smaller item goes first. A group with fewer items keeps them all.

    The rows are first reduced to one per group and item, partly before the shuffle; no group is ever in
    one task. A histogram of the scores of each hot group gives the lowest bin that still has ``n`` items at
    or above it, and what is below is filtered out. The histograms are of hot groups only (those with more
    than ``1 / hot_parts`` of all rows), so the thresholds are fewer than ``hot_parts`` rows and are broadcast.
    What is left is ranked exactly, with the item as tie key.
    """
    g, i, s = (F.col(f"`{c}`") for c in (group, item, score))
    rows = df.select(g.alias(group), i.alias(item), s.cast("double").alias("__s"))
    rows = rows.where(g.isNotNull() & i.isNotNull() & F.col("__s").isNotNull() & ~F.isnan("__s"))
    best = rows.groupBy(g, i).agg(F.max("__s").alias("__s"))

    # per bin, then per group: both partly aggregated before their shuffles
    bins = best.groupBy(g, score_bin(F.col("__s")).alias("__bin")).agg(F.count("*").alias("__n"))
    sizes = bins.groupBy(g).agg(F.sum("__n").alias("__rows"))
    hot = hot_keys(sizes, group, "__rows", df.count(), hot_parts, 4 * n).select(g)
    down = Window.partitionBy(g).orderBy(F.desc("__bin"))
    above = F.coalesce(F.sum("__n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lowest = bins.join(F.broadcast(hot), group, "left_semi").withColumn("__above", above).where(F.col("__above") < n).groupBy(g).agg(F.min("__bin").alias("__least"))

    kept = best.join(F.broadcast(lowest), group, "left").where(F.col("__least").isNull() | (score_bin(F.col("__s")) >= F.col("__least")))
    order = Window.partitionBy(g).orderBy(F.desc("__s"), i)
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select(group, item, F.col("__s").alias(score), "rank")
