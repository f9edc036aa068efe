"""Keys that hold a large share of all rows.

A key is *hot* when it holds more than ``1 / parts`` of the rows. There can be at most ``parts - 1``
such keys whatever the size of the input, so a table with one row per hot key has a proven bound and
may be broadcast; every other key is small against the whole and may be shuffled as usual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.session import cut

#: Bound on the number of hot keys.
PARTS = 20_000


def hot_keys(counts: DataFrame, key: str, n: str, total: int, parts: int = PARTS, least: int = 0) -> DataFrame:
    """``key, n`` of the keys with more than ``max(least, total / parts)`` rows, to be broadcast.

    ``counts`` has one row per key. Fewer than ``parts`` rows are returned, by pigeonhole.
    """
    return F.broadcast(counts.where(F.col(n) > max(least, total // parts)).select(key, n))


#: Buckets that keys are counted in, so a table of the heavy ones has a bound.
BUCKETS = 1 << 16


def join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle of two tables that both grow with the data, whatever the size of their files.

    A compressed table may look small enough to be broadcast and be too large once it is read; the hint keeps
    Spark from that, also when it plans anew at run time. Skewed partitions are split by adaptive execution.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)


def _heavy(df: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """``__h, <name>``: buckets of keys that hold many rows, and in how many blocks they are laid out.

    The rows are counted in ``BUCKETS`` hash buckets, before the shuffle in each task, so nothing of the size of
    the keys is moved. A bucket is heavy with more than ``most`` rows and with more than eight times the mean; there are
    fewer than ``BUCKETS`` of them, whatever the data.
    """
    counts = df.select(_bucket(keys).alias("__h")).groupBy("__h").agg(F.count("*").alias("__n"))
    mean = counts.agg((F.sum("__n") / BUCKETS).alias("__mean"))
    limit = F.greatest(F.lit(float(most)), 8.0 * F.col("__mean"))
    return counts.join(F.broadcast(mean), F.col("__n") > limit).select("__h", F.ceil(F.col("__n") / limit).cast("int").alias(name))


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def salted_pairs(df: DataFrame, bucket: list[str], item: str, block: int = 1024) -> DataFrame:
    """All unordered pairs ``a < b`` of the distinct ``item`` of each bucket, as ``bucket..., a, b``.

    A bucket of more than ``block`` items is laid out in blocks, and each pair of blocks is its own join key, so no
    task ever holds a whole large bucket. Nothing is dropped or capped. Both sides of the join are one table, so
    its shuffle is made once. ``df`` must be distinct on ``bucket + item``, and is read twice: it should be a stored
    table. Null items or bucket keys pair with nothing.
    """
    df = df.where(F.col(item).isNotNull()).select(*bucket, F.col(item).alias("__item"))
    large = cut(df.groupBy(*bucket).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("__k")).where("__k > 1"), "large")
    sized = df.join(F.broadcast(large), bucket, "left") if large.count() <= BUCKETS else join(df, large, bucket, "left")
    own = F.when(F.col("__k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("__item"), F.col("__k")).cast("int"))
    laid = sized.withColumn("__b", own).withColumn("__o", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__k"), F.lit(1)) - 1)))
    laid = laid.select(*bucket, F.least("__b", "__o").alias("__lo"), F.greatest("__b", "__o").alias("__hi"), "__b", "__item")
    right = laid.select(*bucket, "__lo", "__hi", F.col("__b").alias("__b2"), F.col("__item").alias("__item2"))
    both = join(laid, right, [*bucket, "__lo", "__hi"])
    keep = (F.col("__item") < F.col("__item2")) & ((F.col("__lo") == F.col("__hi")) | (F.col("__b") != F.col("__b2")))
    return both.where(keep).select(*bucket, F.col("__item").alias("a"), F.col("__item2").alias("b"))


def salted_join(left: DataFrame, right: DataFrame, key: str, block: int = 20_000) -> DataFrame:
    """Inner join of two tables on ``key``; keys with many rows on either side are split.

    A heavy bucket of keys (see above) is laid out in blocks of about ``block`` rows on its side, the other side is
    sent to each of them, and both sides are split so: a task meets a block by a block at a time. Each side is shuffled
    once. The other columns must have different names. NULL keys join with nothing.
    """
    shapes = [F.broadcast(_heavy(d, [key], block, k)) for d, k in ((left, "__kl"), (right, "__kr"))]

    def laid(df: DataFrame, mine: str, theirs: str) -> DataFrame:
        at = F.pmod(F.xxhash64(*[c for c in df.columns if c != key], F.lit(1)), F.coalesce(F.col(mine), F.lit(1))).cast("int")
        d = df.where(F.col(key).isNotNull()).withColumn("__h", _bucket([key]))
        for s in shapes:
            d = d.join(s, "__h", "left")
        own, other = ("__i", "__j") if mine == "__kl" else ("__j", "__i")
        d = d.withColumn(own, at).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(theirs), F.lit(1)) - 1)))
        return d.drop("__kl", "__kr", "__h")

    return join(laid(left, "__kl", "__kr"), laid(right, "__kr", "__kl"), [key, "__i", "__j"]).drop("__i", "__j")
