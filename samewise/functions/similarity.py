"""String similarities: Column expressions where SQL has them, Arrow functions for the rest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samewise.functions.normalize import words


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 characters and more at a time as the bits of one integer."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & full).bit_count()


def ratio(a: str, b: str) -> float:
    """Indel similarity in percent; two empty texts are alike."""
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio of the common words, and the common words with the rest of either side."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    s, l, r = " ".join(both), " ".join(left), " ".join(right)
    sl, sr = (f"{s} {l}" if s else l), (f"{s} {r}" if s else r)
    found = [ratio(sl, sr)]
    if both:
        found += [ratio(s, sl), ratio(s, sr)]
    return max(found)


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of its length of the longer, cut short at the ends."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _windows(short, long)
    return max(best, _windows(long, short)) if len(a) == len(b) else best


def _windows(short: str, long: str) -> float:
    n, chars, best = len(short), set(short), 0.0
    for end in range(1, n):
        if long[end - 1] in chars:
            best = max(best, ratio(short, long[:end]))
    for start in range(len(long) - n + 1):
        if long[start + n - 1] in chars:
            best = max(best, ratio(short, long[start : start + n]))
        if best == 100.0:
            return best
    for start in range(max(0, len(long) - n + 1), len(long)):
        if long[start] in chars:
            best = max(best, ratio(short, long[start:]))
    return best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for a common prefix of up to four characters if it is above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [c for c, u in zip(b, used) if u]
    turned = sum(x != y for x, y in zip(mine, theirs)) // 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def _arrow(fn):  # noqa: ANN001, ANN202
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x or "", y or "") for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())


ratio_udf, token_sort_udf, token_set_udf, partial_udf, jaro_winkler_udf = map(_arrow, (ratio, token_sort_ratio, token_set_ratio, partial_ratio, jaro_winkler))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two texts; -1 if both have none."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    whole = F.size(F.array_union(x, y))
    return F.when(whole == 0, F.lit(-1.0)).otherwise(F.size(F.array_intersect(x, y)) / whole)


def same_first(a: Column, b: Column) -> Column:
    x, y = F.get(words(a), F.lit(0)), F.get(words(b), F.lit(0))
    return F.coalesce((x == y).cast("double"), F.lit(0.0))


def length_ratio(a: Column, b: Column) -> Column:
    """The shorter length over the longer; 0 if one is empty."""
    x, y = F.length(a), F.length(b)
    return F.when((x == 0) | (y == 0), F.lit(0.0)).otherwise(F.least(x, y) / F.greatest(x, y))
