"""The second candidate generator: an inverted index over blocking keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.functions.normalize import words
from samewise.functions.tokens import first_ngrams
from samewise.operators import retrieve
from samewise.operators.blocking import channel_topk, with_parts
from samewise.operators.hot import salted_join
from samewise.session import cut

#: The reference setting of ``hot``: index records from which on a key counts for none. Not the default, as it drops keys as data grow.
HOT = 10_000


def block_keys(nosp: Column, core: Column, nums: Column) -> Column:
    """The set of keys of a record: whole name, word pairs, prefixes, first 4-grams and address numbers."""
    none = F.array().cast("array<string>")
    w = words(core)
    tag = lambda kind, a: F.transform(a, lambda x: F.concat(F.lit(kind + ":"), x))
    pairs = F.when(F.size(w) >= 2, F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i))), lambda x: F.length(x) >= 5))
    single = F.when((F.size(w) == 1) & (F.length(F.get(w, F.lit(0))) >= 4), w)
    prefixes = F.array_sort(F.transform(F.filter(w, lambda x: F.length(x) >= 3), lambda x: F.substring(x, 1, 3)))
    number = F.slice(F.filter(words(nums), lambda x: F.length(x) <= 5), 1, 3)
    return F.array_distinct(
        F.concat(
            F.when(F.length(nosp) >= 4, F.array(F.concat(F.lit("nosp:"), nosp))).otherwise(none),
            tag("bg", F.coalesce(pairs, single, none)),
            F.when((F.size(w) >= 2) & (F.size(prefixes) >= 2), F.array(F.concat(F.lit("pfx:"), F.array_join(prefixes, " ")))).otherwise(none),
            F.when(F.length(nosp) >= 6, tag("c4", first_ngrams(nosp))).otherwise(none),
            tag("num", number),
        )
    )


def block_inverted(index: DataFrame, pool: DataFrame, most: int = 30, hot: int | None = None) -> DataFrame:
    """``s1, cand, block_hits``: shared keys of a pool record and its ``most`` best index records of its country.

    All keys count, however common. With ``hot`` a key of so many index records or
    more counts for none. Countries the index lacks search all of it. Of equal hits the smaller index id goes first.
    """
    left, right = with_parts(index, pool)
    if hot is not None:
        return _best_hits(_all_hits(left, right, hot), most)
    # Hits add up over the parts of a record, so an id that is in several has its hits counted pair by pair.
    several = cut(right.groupBy("entity_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("entity_id"), "several")
    if several.isEmpty():
        return _counted(left, right, most)
    whole, rest = right.join(several, "entity_id", "left_anti"), right.join(several, "entity_id", "left_semi")
    return _counted(left, whole, most).unionByName(_best_hits(_all_hits(left, rest), most))


def _keys(d: DataFrame, name: str) -> DataFrame:
    return d.select("part", F.col("entity_id").alias(name), F.explode(block_keys(F.col("nosp"), F.col("core"), F.col("nums"))).alias("key"))


def _all_hits(left: DataFrame, right: DataFrame, hot: int | None = None) -> DataFrame:
    """``s1, cand, block_hits`` of all pairs that share a key."""
    a, b = _keys(left, "s1"), _keys(right, "cand")
    if hot is not None:
        rare = a.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") < hot).select("part", "key")
        b = b.join(rare, ["part", "key"], "left_semi")
    keyed = [d.select(F.xxhash64("part", "key").alias("h"), F.struct("part", "key").alias(f"k_{x}"), x) for d, x in ((a, "s1"), (b, "cand"))]
    return salted_join(*keyed, "h").where("k_s1 = k_cand").groupBy("s1", "cand").agg(F.count("*").cast("int").alias("block_hits"))


def _best_hits(hits: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("cand").orderBy(F.desc("block_hits"), "s1")
    return hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def _counted(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """The same by inverted lists in stored blocks: no pair leaves a task but the best."""
    found = retrieve.best(left, right, ["nosp", "core", "nums"], block_keys, most, 0.0)
    return found.select(F.col("s").alias("s1"), F.col("q").alias("cand"), F.col("sim").cast("int").alias("block_hits"))


def block_combined(index: DataFrame, pool: DataFrame, k: int = 5, most: int = 20, threshold: float = 0.1, max_df: float = 0.3) -> DataFrame:
    """Inverted index and two TF-IDF channels together: ``s1, cand, block_hits, sim_name, sim_addr, score``."""
    left, right = with_parts(index, pool)
    zero = F.lit(0.0)
    parts = [block_inverted(index, pool, most).select("s1", "cand", "block_hits", zero.alias("sim_name"), zero.alias("sim_addr"))]
    for channel, name, other in (("nosp", "sim_name", "sim_addr"), ("addr", "sim_addr", "sim_name")):
        found = channel_topk(left, right, channel, k, threshold, max_df)
        parts.append(found.select(F.col("s").alias("s1"), F.col("q").alias("cand"), F.lit(0).alias("block_hits"), F.col("sim").alias(name), zero.alias(other)))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    one = whole.groupBy("s1", "cand").agg(F.max("block_hits").alias("block_hits"), F.max("sim_name").alias("sim_name"), F.max("sim_addr").alias("sim_addr"))
    return one.withColumn("score", F.col("sim_name") + 0.5 * F.col("sim_addr") + 0.1 * F.col("block_hits"))
