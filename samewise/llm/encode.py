"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.bpe import MEMO, VOCABULARY, load, split


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids``: the ids of each row's text, without special tokens.

    NULL and empty texts give an empty list. One row for every row, repeated keys included; texts of any
    length are encoded whole; other columns of ``df`` are not read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(vocabulary).table
        for batch in batches:
            if len(table) > MEMO:
                table.renew()
            pieces, ends = [], [0]
            for value in batch.column(1).to_pylist():
                if value:
                    pieces += split(value)
                ends.append(len(pieces))
            rows = table.rows(pieces)
            tokens = np.concatenate(([0], np.cumsum(table.counts(rows))))
            lists = pa.ListArray.from_arrays(pa.array(tokens[ends].astype(np.int32)), pa.array(table.ids(rows)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, ids])

    kind = df.select(F.col(f"`{key}`").alias(key)).schema[0].dataType.simpleString()
    return df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")
