"""Record ids written in many ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms and the plain characters they stand for (fixed values).
_WIDE = "０１２３４５６７８９ＳｓＩｌＯ"
_PLAIN = "0123456789SsIlO"


def standard_s1(c: Column | str, digits: int = 8) -> Column:
    """The standard form ``S1-`` and ``digits`` digits of any writing of a Source 1 id.

    Case, full-width characters, quotes, ``#``, white space, invisible characters, other or missing
    separators and missing or surplus leading zeros make no difference. A string that is no such id
    stays as it is, trimmed; NULL stays NULL.
    """
    c = F.col(c) if isinstance(c, str) else c
    plain = F.upper(F.translate(c, _WIDE, _PLAIN))
    # what stands between the prefix and the number, and around both, is anything but letters and digits
    number = F.regexp_extract(plain, r"^[^\p{L}\p{N}]*S[^\p{L}\p{N}]*1(?:[^\p{L}\p{N}]+0*|0*)([0-9]+)[^\p{L}\p{N}]*$", 1)
    padded = F.when(F.length(number) < digits, F.lpad(number, digits, "0")).otherwise(number)
    return F.when(number != "", F.concat(F.lit("S1-"), padded)).otherwise(F.trim(c))
