"""Connected components by hash-to-min, and group-aware splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.operators.hot import PARTS, hot_keys
from samewise.session import cut, drop


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, component`` of all nodes of the edges; the component is its smallest node.

    Every node keeps a cluster, at first itself and its neighbours. In each round it sends its cluster to
    the cluster's minimum, and the minimum to all members; what arrives is the new cluster. When no cluster
    changes, each node's cluster is its component's minimum, and the minimum has the whole component. The
    number of rounds is logarithmic in the longest path. Clusters are rows ``node, member``, so no cluster
    is ever in one task; the minimum of a node that has a large share of all rows is broadcast (there are
    fewer such nodes than a fixed bound), the others' are joined by shuffle.

    Self-loops and repeated edges do no harm. Edges with a NULL end are dropped. No edges give no rows.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = F.explode(F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("member")), F.struct(F.col("y").alias("node"), F.col("x").alias("member")), F.struct(F.col("x").alias("node"), F.col("x").alias("member")), F.struct(F.col("y").alias("node"), F.col("y").alias("member"))))
    now = cut(ends.select(both.alias("e")).select("e.*").distinct(), "clusters")
    before = None
    for _ in range(most_rounds):
        total = now.count()
        stats = cut(now.groupBy("node").agg(F.min("member").alias("least"), F.count("*").alias("n")), "minima")
        hot = hot_keys(stats, "node", "n", total, PARTS, 10_000).select("node")
        hot_minima = F.broadcast(stats.join(hot, "node").select("node", "least"))
        minima = stats.join(hot, "node", "left_anti").select("node", "least")
        told = now.join(hot, "node", "left_anti").join(minima, "node").unionByName(now.join(hot_minima, "node"))
        sent = F.explode(F.array(F.struct(F.col("least").alias("node"), F.col("member").alias("member")), F.struct(F.col("member").alias("node"), F.col("least").alias("member"))))
        new = cut(told.select(sent.alias("e")).select("e.*").distinct(), "clusters")
        # sizes and order-free checksums of both tables; equal ones mean that nothing changed
        sums = [t.agg(F.count("*"), F.sum(F.xxhash64("node", "member").cast("decimal(38,0)"))).first() for t in (now, new)]
        drop(stats)
        drop(before)
        before, now = now, new
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError("components are not stable yet")
    drop(before)
    return now.groupBy("node").agg(F.min("member").alias("component"))
