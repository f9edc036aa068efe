"""Several values packed in one field: one row per value with its position.

The field is read by a finite-state tokenizer that keeps the open quote, a pending escape and the depth
of open brackets. A delimiter ends a value only outside quotes; brackets around the whole list are
wrapping, brackets inside it nest and protect what they hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that separate values outside quotes.
DELIMITERS = ",;|/\n\r\t"
#: Opening and closing quotes.
QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”", "‘": "’", "«": "»"}
BRACKETS = {"[": "]", "{": "}", "(": ")"}
#: Words that say that there is no value, compared without case.
NONE_WORDS = frozenset({"", "none", "null", "nil", "nan", "n/a", "na", "-", "--", "no match", "nothing", "empty"})


def split_packed(text: str | None, delimiters: str = DELIMITERS, spaces: bool = True, none_words: frozenset[str] = NONE_WORDS) -> list[str]:
    """The values of ``text`` in the order of the field.

    * White space outside quotes ends a value too, if ``spaces``.
    * A quote opens only where a value begins. Inside, a backslash takes the next character as it is and a
      doubled quote stands for one. A quote that is never closed ends with the field.
    * Brackets that open before the first character of a value at depth 0 wrap the list and are dropped;
      deeper brackets nest, and delimiters inside them belong to the value.
    * Empty places, and values that are a word for "none" and were not quoted, are left out, as are quoted
      values of white space only. NULL gives no value. Repeated values stay, each at its place.
    """
    if text is None or text.strip().lower() in none_words:
        return []
    out: list[str] = []
    value: list[str] = []
    quote, escaped, quoted, wraps, nest = "", False, False, [], []

    def emit() -> None:
        nonlocal quoted
        found = "".join(value).strip()
        if found and (quoted or found.lower() not in none_words):
            out.append(found)
        value.clear()
        quoted = False

    i, n = 0, len(text)
    while i < n:
        ch = text[i]
        i += 1
        if escaped:
            value.append(ch)
            escaped = False
        elif quote:
            if ch == "\\" and i < n:
                escaped = True
            elif ch == quote:
                if i < n and text[i] == quote and QUOTES.get(quote) == quote:
                    value.append(ch)
                    i += 1
                else:
                    quote = ""
            else:
                value.append(ch)
        elif nest:
            value.append(ch)
            if ch in BRACKETS:
                nest.append(BRACKETS[ch])
            elif ch == nest[-1]:
                nest.pop()
        elif ch in QUOTES and not quoted and not "".join(value).strip():
            value.clear()
            quote, quoted = QUOTES[ch], True
        elif ch in BRACKETS and not out and not quoted and not value:
            wraps.append(BRACKETS[ch])
        elif ch in BRACKETS and value:
            value.append(ch)
            nest.append(BRACKETS[ch])
        elif wraps and ch == wraps[-1]:
            wraps.pop()
            emit()
        elif ch == "/" and ch in delimiters and "".join(value).lower() == "n" and text[i : i + 1].lower() == "a":
            value.append(ch)  # the word n/a inside a list
        elif ch in delimiters:
            emit()
        elif ch.isspace() or ch in "​﻿":
            if quoted or not value:
                continue
            if spaces:
                emit()
            else:
                value.append(ch)
        elif quoted:
            emit()  # text right after a closing quote begins the next value
            value.append(ch)
        else:
            value.append(ch)
    emit()
    return out


def explode_packed(df: DataFrame, key: str, packed: str, value: str = "value", pos: str = "pos", delimiters: str = DELIMITERS, spaces: bool = True) -> DataFrame:
    """One row ``key, pos, value`` per packed value of each row of ``df``; other columns are dropped.

    ``pos`` counts from 1 over the values of the field. Rows without values give no row. Repeated rows
    give repeated rows. A NULL key stays NULL. Fields of any length are read whole.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: split_packed(t, delimiters, spaces))

    values = F.pandas_udf(run, "array<string>")
    at = F.posexplode(values(F.col(f"`{packed}`")))
    return df.select(F.col(f"`{key}`").alias(key), at.alias("__p", value)).select(key, (F.col("__p") + 1).alias(pos), value)
