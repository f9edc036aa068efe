"""Assignment to splits that keeps related records together."""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions.ids import standard_s1
from samewise.llm.components import hash_to_min
from samewise.operators.packed import explode_packed
from samewise.session import cut

#: Components with more than 1/HEAVY of all rows are placed one by one; there are fewer than HEAVY.
HEAVY = 1_000


def _unit(key: str, split: str) -> float:
    """A number in (0, 1) that depends on the two strings alone."""
    return (xxhash.xxh64_intdigest(f"{split}\0{key}") + 0.5) / 2.0**64


def rendezvous(key: str, weights: dict[str, float]) -> str:
    """The split with the highest weighted rendezvous score; a changed weight moves only what it must."""
    return max(sorted(weights), key=lambda s: -weights[s] / math.log(_unit(key, s)) if weights[s] > 0 else -1.0)


def entity_components(ids: DataFrame, labels: DataFrame, s1: str = "s1") -> DataFrame:
    """``s1, component`` of each distinct string of ``ids.s1``: the smallest entity id it is tied to.

    Writings of one id are tied, and ids whose labels hold a matched id in common, directly or through
    others. NULL strings have no row; a string that is no id is a component of its own.
    """
    written = ids.select(F.col(f"`{s1}`").alias("s1")).where("s1 is not null").distinct().withColumn("id", standard_s1("s1"))
    held = explode_packed(labels, "source1_entity_id", "matched_entity_ids", "member").select(standard_s1("source1_entity_id").alias("id"), "member").where("id is not null").distinct()
    shared = held.groupBy("member").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("member", "first")
    ties = held.join(shared, "member").where("id <> first").select("id", "first").distinct()
    found = hash_to_min(ties, "id", "first")
    return written.join(found, written.id == found.node, "left").select("s1", F.coalesce("component", "id").alias("component"))


def assign_splits(rows: DataFrame, component: str, plan: DataFrame, split: str = "split_name", share: str = "share", weight: str | None = None) -> DataFrame:
    """``component, split`` such that the splits' shares of *rows* are near those of ``plan``.

    Components that hold a large share of the rows (fewer than ``HEAVY``, so they fit the driver) are
    placed first, the largest first, by weighted rendezvous hashing among the splits that still have room
    for them, weighted with that room. All others follow by weighted rendezvous hashing with what
    room is left, inside Spark. Equal components always get the same split; ``plan`` is a small table.
    ``weight`` names a column that says for how many rows each row of ``rows`` stands. NULL components get none.
    """
    wanted = {r[0]: max(0.0, float(r[1])) for r in plan.where(F.col(share).isNotNull()).select(split, share).limit(1_000).collect()}
    whole = sum(wanted.values())
    sizes = cut(rows.where(F.col(component).isNotNull()).groupBy(component).agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if not whole:
        raise ValueError("the plan has no shares")
    room = {s: w / whole * total for s, w in wanted.items()}
    heavy = sizes.where(F.col("n") > total / HEAVY).orderBy(F.desc("n"), component).collect()
    placed = []
    for key, n in ((r[component], r["n"]) for r in heavy):
        fits = {s: r for s, r in room.items() if r >= n} or {max(sorted(room), key=room.get): 1.0}
        to = rendezvous(key, fits)
        room[to] -= n
        placed.append((key, to))
    light = sizes.where(F.col("n") <= total / HEAVY)
    left = {s: max(r, 0.0) for s, r in room.items()}
    if not any(left.values()):
        left = dict(wanted)
    unit = lambda s: ((F.shiftrightunsigned(F.xxhash64(F.lit(s), F.col(component)), 11)).cast("double") + 0.5) / F.lit(2.0**53)
    scores = [F.struct((F.lit(-w) / F.log(unit(s))).alias("w"), F.lit(s).alias("s")) for s, w in sorted(left.items()) if w > 0]
    hashed = light.select(component, F.array_max(F.array(*scores))["s"].alias("split"))
    spark: SparkSession = rows.sparkSession
    return hashed.unionByName(spark.createDataFrame(placed, hashed.schema)) if placed else hashed
