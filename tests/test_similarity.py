import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from samewise.functions import similarity as S

words = st.text("ab c", max_size=14)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@given(st.text("abcd", max_size=90), st.text("abcd", max_size=90))
def test_lcs(a, b):
    assert S.lcs(a, b) == slow_lcs(a, b)


@given(words, words)
def test_ranges_and_symmetry(a, b):
    for f, top in ((S.ratio, 100), (S.token_sort_ratio, 100), (S.token_set_ratio, 100), (S.jaro_winkler, 1)):
        assert 0 <= f(a, b) <= top + 1e-9
        assert f(a, b) == pytest.approx(f(b, a))
    assert S.ratio(a, a) == 100 and S.jaro_winkler(a, a) == 1
    assert S.partial_ratio(a, b) >= S.ratio(a, b) - 1e-9 or not a or not b


@pytest.mark.parametrize(
    ("f", "a", "b", "want"),
    [
        (S.ratio, "", "", 100), (S.ratio, "a", "", 0), (S.ratio, "kitten", "sitting", 200 * 4 / 13), (S.token_set_ratio, "", "a", 0), (S.token_set_ratio, "a b", "b a c", 100),
        (S.token_sort_ratio, "b a", "a b", 100), (S.partial_ratio, "abc", "xxabcxx", 100), (S.partial_ratio, "", "", 100), (S.partial_ratio, "a", "", 0),
        (S.jaro_winkler, "martha", "marhta", 0.9611111), (S.jaro_winkler, "", "", 1), (S.jaro_winkler, "a", "", 0),
    ],
)
def test_values(f, a, b, want):
    assert f(a, b) == pytest.approx(want, abs=1e-6)


def test_jaccard_and_lengths(spark):
    df = spark.createDataFrame([("", ""), ("a b", ""), ("a b", "b c c"), (None, "x")], "a string, b string").fillna("")
    rows = df.select(S.jaccard(F.col("a"), F.col("b")), S.length_ratio(F.col("a"), F.col("b")), S.same_first(F.col("a"), F.col("b")), S.ratio_udf("a", "b")).collect()
    assert [r[0] for r in rows] == [-1.0, 0.0, pytest.approx(1 / 3), 0.0]
    assert [r[1] for r in rows] == [0.0, 0.0, pytest.approx(3 / 5), 0.0]
    assert [r[2] for r in rows] == [0.0, 0.0, 0.0, 0.0]
    assert rows[0][3] == 100.0
