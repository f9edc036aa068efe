"""Queries of the data preparation problems, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions.ids import standard_s1
from samewise.llm.chunking import cut_corpus
from samewise.llm.encode import encode_corpus
from samewise.llm.leakage import find_leaks
from samewise.llm.matching import match
from samewise.llm.places import same_places
from samewise.llm.splits import assign_splits, entity_components
from samewise.llm.topn import top_n
from samewise.llm.variants import same_organisations
from samewise.operators.hot import join, salted_pairs
from samewise.operators.packed import explode_packed
from samewise.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of Source 1 records at the same building or plot."""
    return same_places(table(spark, sf_dir, "train_source1"), "entity_id", "business_address", "country")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true pairs of the labelled records; those without a match have a NULL candidate."""
    labels = table(spark, sf_dir, "train_labels")
    pairs = explode_packed(labels, "source1_entity_id", "matched_entity_ids", "cand").select(standard_s1("source1_entity_id").alias("s1"), "cand")
    return labels.select(standard_s1("source1_entity_id").alias("s1"), F.lit(None).cast("string").alias("cand")).unionByName(pairs).distinct()


def _matches(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    columns = ["entity_id", "business_name", "business_address", "country"]
    left, two, three = (table(spark, sf_dir, f"train_source{k}").select(columns) for k in (1, 2, 3))
    return match(left, two.unionByName(three), _labels(spark, sf_dir), least=least)


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of Source 1 records with Source 2 and 3, and their confidence."""
    return _matches(spark, sf_dir, 0.0)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches held to be true of the Source 1 records that have no label."""
    known = _labels(spark, sf_dir).select("s1").distinct()
    return join(_matches(spark, sf_dir, 0.5), known, "s1", "left_anti").select("s1", "cand")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different writings in candidate_pairs.s1 that must land in the same split."""
    found = cut(entity_components(table(spark, sf_dir, "candidate_pairs"), table(spark, sf_dir, "train_labels")), "entities")
    return salted_pairs(found, ["component"], "s1").select(F.col("a").alias("s1_a"), F.col("b").alias("s1_b"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every row of candidate_pairs: each distinct writing, its component, split and rows."""
    pairs = table(spark, sf_dir, "candidate_pairs")
    found = cut(entity_components(pairs, table(spark, sf_dir, "train_labels")), "entities")
    per = pairs.groupBy("s1").agg(F.count("*").alias("rows"))
    weighted = per.join(found, "s1")
    split = assign_splits(weighted, "component", table(spark, sf_dir, "split_plan"), weight="rows")
    return weighted.join(split, "component").select("s1", "component", "split", "rows")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of Source 1 records whose names mean the same organisation."""
    return same_organisations(table(spark, sf_dir, "train_source1"), "entity_id", "business_name")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of each Source 1 record."""
    pairs = table(spark, sf_dir, "candidate_pairs").select(standard_s1("s1").alias("s1"), "cand", "score")
    return top_n(pairs, "s1", "cand", "score", 5).select("s1", "cand")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's text."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test passage wholly, or half of its words unbroken, and the item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have to be cut: those for which the operator gives a second piece."""
    pieces = cut_corpus(table(spark, sf_dir, "documents"), only_cut=True, with_text=False)
    return pieces.where("piece = 1").select("doc_id")


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents, with their texts."""
    return cut_corpus(table(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_matches": p2_matches, "p3_found": p3_found, "p3_splits": p3_splits, "p4_found": p4_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found, "p9_pieces": p9_pieces}

ORACLE = {
    "p6_found": r"""
        WITH written AS (
            SELECT upper(translate(s1, '０１２３４５６７８９Ｓｓ', '0123456789Ss')) AS w, s1, cand, score FROM candidate_pairs
            WHERE score IS NOT NULL AND NOT isnan(score) AND s1 IS NOT NULL AND cand IS NOT NULL),
        cut AS (
            SELECT regexp_extract(w, '^[^\p{L}\p{N}]*S[^\p{L}\p{N}]*1(?:[^\p{L}\p{N}]+0*|0*)([0-9]+)[^\p{L}\p{N}]*$', 1) AS d, * FROM written),
        best AS (
            SELECT CASE WHEN d = '' THEN trim(s1) WHEN length(d) < 8 THEN 'S1-' || lpad(d, 8, '0') ELSE 'S1-' || d END AS s1, cand, max(score) AS score
            FROM cut GROUP BY 1, 2),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, cand) AS r FROM best)
        SELECT s1, cand FROM ranked WHERE r <= 5""",
}
