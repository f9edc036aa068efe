"""Candidate retrieval: for each pool record the most similar index records of its country."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.operators import retrieve
from samewise.operators.retrieve import DIGITS
from samewise.operators.tfidf import CHANNELS, fit_transform, rare_enough

#: Records of each side of a block.
BLOCK = 3072


def with_parts(index: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index part each record belongs to: its country, or ``*`` (the whole index) if the index has none of it."""
    lands = index.select(F.col("country").alias("part")).distinct()
    known = pool.join(lands.withColumnRenamed("part", "country").withColumn("part", F.col("country")), "country", "left")
    pool = known.withColumn("part", F.coalesce("part", F.lit("*")))
    wanted = pool.select("part").distinct()
    both = index.withColumn("part", F.explode(F.array("country", F.lit("*"))))
    return both.join(wanted, "part", "left_semi"), pool


def similar(index: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """``part, q, s, sim`` of the pairs with a cosine above the threshold, by a join of the postings.

    The sum is partly aggregated before its shuffle; AQE splits the postings of frequent terms. Exact.
    """
    a = index.select("part", "term", F.col("id").alias("s"), F.col("w").alias("ws"))
    b = queries.select("part", "term", F.col("id").alias("q"), F.col("w").alias("wq"))
    dots = b.join(a, ["part", "term"]).groupBy("part", "q", "s").agg(F.sum(F.col("wq") * F.col("ws")).alias("sim"))
    return dots.withColumn("sim", F.round("sim", DIGITS)).where(F.col("sim") > threshold)


def _expand(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the owners and of the items of runs that begin at ``first`` and have ``size`` items."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[owner]


def block_product(a: pd.DataFrame, b: pd.DataFrame, threshold: float, k: int | None = None, at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, record, sim)`` of the postings ``id, term, w`` of two blocks: a sparse product, term by term.

    Only what terms the two sides share is multiplied. With ``k`` a query keeps its ``k`` best records of the block and those
    that are equal to the last of them, so no more than that leaves the task.
    """
    (ra, sa), (rb, sb) = pd.factorize(a["id"]), pd.factorize(b["id"])
    terms, code = np.unique(a["term"].to_numpy(), return_inverse=True)
    order = np.argsort(code, kind="stable")
    ra, wa = ra[order], a["w"].to_numpy()[order]
    first = np.searchsorted(code[order], np.arange(len(terms) + 1))
    at = pd.Index(terms).get_indexer(b["term"])
    rb, wb, at = rb[at >= 0], b["w"].to_numpy()[at >= 0], at[at >= 0]
    size = first[at + 1] - first[at]
    sim = np.zeros(len(sb) * len(sa))
    ends = np.searchsorted(np.cumsum(size), np.arange(at_once, size.sum() + at_once, at_once), "right") + 1 if len(size) else []
    lo = 0
    for hi in ends:  # so many products at a time
        owner, item = _expand(first[at[lo:hi]], size[lo:hi])
        sim += np.bincount(rb[lo:hi][owner] * len(sa) + ra[item], wb[lo:hi][owner] * wa[item], len(sim))
        lo = hi
    sim = np.round(sim.reshape(len(sb), len(sa)), DIGITS)
    keep = sim > threshold
    if k is not None and k < len(sa):
        keep &= sim >= np.partition(sim, len(sa) - k, axis=1)[:, len(sa) - k, None]
    q, s = np.nonzero(keep)
    return np.asarray(sb, object)[q], np.asarray(sa, object)[s], sim[q, s]


def similar_block(index: DataFrame, queries: DataFrame, threshold: float, size: int = BLOCK, k: int | None = None) -> DataFrame:
    """The same by blocks: each pair of a block of the index and one of the queries is one sparse product in a task.

    A block has ``size`` records at most on average, so a task's memory has a bound however large a part is. With ``k`` the
    best of each query within the block leave it, so the shuffle behind has ``k`` rows a query and block.
    """
    n = lambda d: d.select("part", "id").distinct().groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias("k"))

    def laid(d: DataFrame, mine: str, theirs: str, other: DataFrame) -> DataFrame:
        own = d.withColumn("term", F.xxhash64("term")).join(n(d), "part").withColumn(mine, F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).drop("k")
        return own.join(n(other), "part").withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col("k") - 1))).drop("k")

    def product(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"part": [], "q": [], "s": [], "sim": []})
        q, s, sim = block_product(a, b, threshold, k)
        return pd.DataFrame({"part": key[0], "q": q, "s": s, "sim": sim})

    left = laid(index, "i", "j", queries).groupBy("part", "i", "j")
    right = laid(queries, "j", "i", index).groupBy("part", "i", "j")
    return left.cogroup(right).applyInPandas(product, "part string, q string, s string, sim double")


def similar_lsh(index: DataFrame, queries: DataFrame, threshold: float, bands: int = 48, bits: int = 6, seed: int = 7) -> DataFrame:
    """The same approximately: pairs that share a band of signs of random projections, then their exact cosine.

    A pair with cosine 0.5 is found with a chance of 0.99, one of 0.3 with 0.87; the recall against the exact
    search is measured in the tests. The projection of a term is drawn from the term's hash, so no model is shipped.
    """
    count = bands * bits

    def signs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo: dict[int, np.ndarray] = {}
        for terms, ws in batches:
            out = []
            for t, w in zip(terms, ws):
                total = np.zeros(count)
                for h, x in zip(t, w):
                    if h not in memo:
                        if len(memo) > 50_000:
                            memo.clear()
                        memo[h] = np.random.default_rng([seed, int(h) & 0xFFFFFFFF, int(h) >> 32 & 0xFFFFFFFF]).standard_normal(count)
                    total += x * memo[h]
                bit = (total.reshape(bands, bits) > 0) @ (1 << np.arange(bits))
                out.append((bit + np.arange(bands) * (1 << bits)).tolist())
            yield pd.Series(out)

    sketch = F.pandas_udf(signs, "array<bigint>")

    def banded(d: DataFrame, name: str) -> DataFrame:
        rows = d.groupBy("part", "id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("h"), "w")).alias("v"))
        return rows.select("part", F.col("id").alias(name), F.explode(sketch(F.col("v.h"), F.col("v.w"))).alias("band"))

    pairs = banded(queries, "q").join(banded(index, "s"), ["part", "band"]).select("part", "q", "s").distinct()
    b = queries.select("part", F.col("id").alias("q"), "term", F.col("w").alias("wq"))
    a = index.select("part", F.col("id").alias("s"), "term", F.col("w").alias("ws"))
    dots = pairs.join(b, ["part", "q"]).join(a, ["part", "s", "term"]).groupBy("part", "q", "s").agg(F.sum(F.col("wq") * F.col("ws")).alias("sim"))
    return dots.withColumn("sim", F.round("sim", DIGITS)).where(F.col("sim") > threshold)


STRATEGIES = {"relational": similar, "block": similar_block, "lsh": similar_lsh}


def channel_topk(index: DataFrame, pool: DataFrame, channel: str, k: int = 7, threshold: float = 0.1, max_df: float = 0.3, min_df: int | None = None, strategy: str = "auto") -> DataFrame:
    """``part, q, s, sim`` of the ``k`` best index records of each pool record in one channel, above the threshold.

    Both sides have a ``part`` column. Of equal similarities the smaller index id goes first. The strategies
    ``auto`` and ``block`` read inverted lists of stored blocks; ``relational`` joins postings; the results are the same.
    """
    if strategy in ("auto", "block"):
        text, tokenise, least = CHANNELS[channel]
        least = least if min_df is None else min_df
        return retrieve.best(index, pool, text, tokenise, k, threshold, lambda posted, sizes: rare_enough(posted, sizes, max_df, least))
    a, b = fit_transform(index, pool, channel, max_df=max_df, min_df=min_df)
    found = STRATEGIES[strategy](a, b, threshold)
    order = Window.partitionBy("part", "q").orderBy(F.desc("sim"), "s")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def scores(fused: DataFrame) -> DataFrame:
    """Name and address similarity over the channels, the pair's score, and best, rank and gap per pool record."""
    s = fused.withColumns({"sim_name": F.greatest("nosp", "name_word"), "sim_addr": F.greatest("addr", "addr_word")})
    s = s.withColumn("score", F.greatest("sim_name", "sim_addr") + 0.5 * F.least("sim_name", "sim_addr"))
    w = Window.partitionBy("cand")
    s = s.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "s1")) - 1, "best": F.max("score").over(w)})
    second: Column = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(w)
    s = s.withColumn("gap", F.col("best") - F.coalesce(second, F.lit(0.0)))
    return s.select("s1", "cand", "sim_name", "sim_addr", F.col("name_word").alias("sim_name_word"), F.col("addr_word").alias("sim_addr_word"), "score", "best", "rank", "gap")


def block(index: DataFrame, pool: DataFrame, k: int = 7, threshold: float = 0.1, max_df: float = 0.3, strategy: str = "auto") -> DataFrame:
    """Candidates of all four channels, fused and scored.

    The channels are one union and one aggregation, not a chain of outer joins; what a channel did not
    find counts 0. Pool countries that the index lacks are searched in the whole index. Empty tables give no row.
    """
    left, right = with_parts(index, pool)
    parts = [channel_topk(left, right, c, k, threshold, max_df, strategy=strategy).withColumn("channel", F.lit(c)) for c in CHANNELS]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole = whole.withColumnsRenamed({"q": "cand", "s": "s1"}).repartition("cand")  # the one shuffle: the ranks are by cand, too
    fused = whole.groupBy("cand", "s1").agg(*[F.coalesce(F.max(F.when(F.col("channel") == c, F.col("sim"))), F.lit(0.0)).alias(c) for c in CHANNELS])
    return scores(fused)


def prune(candidates: DataFrame, margin: float = 1.0, floor: float = 0.0, max_rank: int = 10) -> DataFrame:
    """Candidates near enough to the best of their pool record."""
    return candidates.where((F.col("best") >= floor) & (F.col("score") >= F.col("best") - F.lit(float(margin))) & (F.col("rank") < max_rank))
