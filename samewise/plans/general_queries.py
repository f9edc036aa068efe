"""Queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from samewise.operators.packed import explode_packed
from samewise.plans.duck import packed
from samewise.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct (source1_entity_id, pos, matched_entity_id) of train_labels."""
    labels = table(spark, sf_dir, "train_labels")
    return explode_packed(labels, "source1_entity_id", "matched_entity_ids", "matched_entity_id").distinct()


QUERIES = {"p5_found": p5_found}
ORACLE = {
    "p5_found": f"""SELECT DISTINCT source1_entity_id, CAST(pos AS INTEGER) AS pos, ids[pos] AS matched_entity_id
    FROM (SELECT source1_entity_id, ids, unnest(range(1, len(ids) + 1)) AS pos FROM (SELECT source1_entity_id, {packed('matched_entity_ids')} AS ids FROM train_labels))"""
}
