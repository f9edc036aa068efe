"""TF-IDF in long form: one row per document and term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions import tokens as T

#: Retrieval channels: the text column, its tokeniser, and in how many documents a term must be.
CHANNELS = {
    "nosp": ("nosp", T.char_ngrams, 1),
    "name_word": ("core", T.word_ngrams, 2),
    "addr": ("addr", T.char_wb_ngrams, 1),
    "addr_word": ("addr", T.word_ngrams, 2),
}


def term_counts(docs: DataFrame, key: str, part: str, tokens: Column) -> DataFrame:
    """``part, id, term, tf`` of the terms of each document."""
    posted = docs.select(F.col(part).alias("part"), F.col(key).alias("id"), F.explode(tokens).alias("term"))
    return posted.groupBy("part", "id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, sizes: DataFrame, max_df: float = 0.3, min_df: int = 1) -> DataFrame:
    """``part, term, idf`` of the terms in ``min_df`` documents at least and a share of ``max_df`` at most.

    ``sizes`` has the number of documents ``n`` of each part, those without a term included; idf is
    ``ln((1 + n) / (1 + df)) + 1``. A part in which no term is left has no row.
    """
    return rare_enough(counts, sizes, max_df, min_df)


def rare_enough(posted: DataFrame, sizes: DataFrame, max_df: float = 0.3, min_df: int = 1) -> DataFrame:
    """The same of any table with one row for each ``part``, document and ``term``."""
    df = posted.groupBy("part", "term").agg(F.count("*").alias("df")).join(sizes, "part")
    kept = df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    return kept.select("part", "term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weights(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``part, id, term, w``: ``(1 + ln tf) * idf`` over the vector's length; unknown terms are dropped before."""
    raw = counts.join(vocab, ["part", "term"]).withColumn("w", (1.0 + F.log("tf")) * F.col("idf"))
    length = raw.groupBy("part", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(length, ["part", "id"]).select("part", "id", "term", (F.col("w") / F.col("len")).alias("w"))


def fit_transform(index: DataFrame, queries: DataFrame, channel: str, key: str = "entity_id", part: str = "part", max_df: float = 0.3, min_df: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Weights of the index and of the queries by the vocabulary of the index, part by part."""
    text, tokenise, least = CHANNELS[channel]
    sizes = index.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n"))
    counts = term_counts(index, key, part, tokenise(F.col(text)))
    vocab = vocabulary(counts, sizes, max_df, least if min_df is None else min_df)
    return weights(counts, vocab), weights(term_counts(queries, key, part, tokenise(F.col(text))), vocab)
