"""Schemas of the tables of the pipeline."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


SOURCE = T.StructType(_s("entity_id", "business_name", "business_address", "country"))
TRUTH = T.StructType(_s("source1_entity_id", "matched_entity_ids"))
PREPARED = T.StructType([*SOURCE.fields, *_s("name_full", "core", "nosp", "addr", "nums", "zips")])
PAIRS = T.StructType(_s("s1", "cand"))
CANDIDATES = T.StructType([*PAIRS.fields, *(T.StructField(n, T.DoubleType()) for n in ("sim_name", "sim_addr", "sim_name_word", "sim_addr_word", "score", "best")), T.StructField("rank", T.IntegerType()), T.StructField("gap", T.DoubleType())])
