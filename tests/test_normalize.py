import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from samewise.functions import dictionaries as D
from samewise.functions import normalize as N
from samewise.functions import tokens as T


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("45ND", "45"), ("www.foo.com", "fu"), ("www.acmetools.com", "acmetuls"), ("LLC", "lc"), ("", ""), (None, ""), ("Café Ünï", "cafe uni"), ("mississippi", "misisipi"), ("www", "ww"), ("11", "11")],
)
def test_base(spark, text, want):
    assert one(spark, text, N.base) == want


def test_base_words(spark):
    assert one(spark, "A & B", lambda c: N.words(N.base(c))) == ["a", "and", "b"]


def test_name(spark):
    df = spark.createDataFrame([("1", "Ltd", "5 5 Road", " US "), ("2", "Sharma & Sons Pvt. Ltd.", "12 MG Road, Karnataka 560001", "India"), ("3", None, None, None), ("4", "Acme LLC", "1 Illinois Street", "us")], "entity_id string, business_name string, business_address string, country string")
    rows = {r.entity_id: r for r in N.prepare(df).collect()}
    assert rows["1"].core == "ltd" and rows["1"].addr == "5 5 rd" and rows["1"].nums == "5" and rows["1"].country == "us"
    assert rows["2"].name_full == "sharma and sons pvt ltd" and rows["2"].core == "sharma and sons" and rows["2"].zips == "560001" and "ka" in rows["2"].addr.split()
    assert rows["3"].asDict() == {"entity_id": "3", "business_name": "", "business_address": "", "country": "unk", "name_full": "", "core": "", "nosp": "", "addr": "", "nums": "", "zips": ""}
    assert rows["4"].core == "acme" and rows["4"].addr == "1 il st"  # folded dictionaries reach folded text
    literal = {r.entity_id: r for r in N.prepare(df, fold_dictionaries=False).collect()}
    assert literal["4"].core == "acme lc" and literal["4"].addr == "1 ilinois strit"


def test_extra_columns_and_clashing_names(spark):
    df = spark.createDataFrame([("1", "A", "B", "C", "x", "y")], "entity_id string, business_name string, business_address string, country string, core string, __n string")
    assert N.prepare(df).first().core == "a"


def test_variant_g1(spark):
    df = spark.createDataFrame([("1", "Mississippi GmbH", "1 Texas Road", "france")], "entity_id string, business_name string, business_address string, country string")
    r = N.prepare(df, "g1").first()
    assert r.core == "mississippi" and r.addr == "1 rd tx"


def test_transliterate(spark):
    assert one(spark, "राम Road", N.transliterate) == "raama Road"


def test_states_longest_name_first(spark):
    df = spark.createDataFrame([("west virginia virginia new york",)], "x string")
    assert df.select(N.states(F.col("x"), F.lit("us"))).first()[0] == "wv va ny"
    assert df.select(N.states(F.col("x"), F.lit("spain"))).first()[0] == "west virginia virginia new york"


@given(st.text("abceghnoprstu ", max_size=12))
def test_folding_is_one_pass_of_the_rules(word):
    want = word
    for a, b in D.PHONETIC:
        want = re.sub(a, b, want)
    assert D.fold_word(word) == re.sub(r"([a-z])\1", r"\1", want)


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (T.char_ngrams, "ab", []), (T.char_ngrams, "abcd", ["abc", "bcd"]), (T.char_ngrams, None, []), (T.char_ngrams, "", []),
        (T.char_wb_ngrams, "a", [" a "]), (T.char_wb_ngrams, "ab c", [" ab", "ab ", " c "]), (T.word_ngrams, "a bc d ef", ["bc", "ef", "bc ef"]), (T.word_ngrams, "", []),
        (T.first_ngrams, "abc", ["abc"]), (T.first_ngrams, "abcdefghijklmn", ["abcd", "bcde", "cdef", "defg", "efgh", "fghi", "ghij", "hijk"]), (T.first_ngrams, " ", []),
    ],
)
def test_tokens(spark, make, text, want):
    assert one(spark, text, make) == want


@pytest.mark.parametrize(("text", "want"), [("शर्मा", "sharma"), ("राम Road", "rama road"), ("Москва", "moskva"), ("Ωμέγα", "omega"), ("Société", "societe")])
def test_base_spells_other_scripts(spark, text, want):
    assert one(spark, text, N.base) == want
