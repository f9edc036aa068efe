"""Tokenisers of the retrieval channels, as Column expressions that give arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once for a row; a lambda computes what it refers to again for each item."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _windows(c: Column, n: int) -> Column:
    def of(text: Column) -> Column:
        last = F.length(text) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return let(c, of)


def char_ngrams(c: Column, n: int = 3) -> Column:
    """All runs of ``n`` characters, white space collapsed; shorter texts have none."""
    return _windows(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s\s+", " "), n)


def char_wb_ngrams(c: Column, n: int = 3) -> Column:
    """Runs of ``n`` characters within each word, which has a space put before and behind."""
    found = F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(found, lambda w: _windows(F.concat(F.lit(" "), w, F.lit(" ")), n)))


def word_ngrams(c: Column) -> Column:
    """Words of two letters or more, and pairs of such words that follow each other."""
    def of(w: Column) -> Column:
        pairs = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))).otherwise(F.array().cast("array<string>"))
        return F.concat(w, pairs)

    return let(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b\w\w+\b"), F.lit(0)), of)


def first_ngrams(c: Column, n: int = 4, most: int = 8) -> Column:
    """The first ``most`` runs of ``n`` characters of the trimmed text; a shorter text is its only one."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) < n, F.array(t)).otherwise(F.slice(_windows(t, n), 1, most))
