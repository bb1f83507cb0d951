"""Normalisation, n-grams, MinHash and similarities against values worked by hand and plain Python."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.functions import grams, normalize
from concord.functions import similarity as S


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [("St. Mary & Co", "saint mary and company"), ("Café_Ltd", "cafe limited"), (None, ""), ("", ""), ("NA", "na"), ("ＡＢＣ Corp", "abc corporation"), ("Straße", "strasse"), (" . ", "")],
)
def test_names(spark, text, want):
    assert one(spark, normalize.normalize_name(F.col("a")), a=text) == want


def test_addresses(spark):
    assert one(spark, normalize.normalize_address(F.col("a")), a="12 St. Mary Rd, Ste 4") == "12 street mary road suite 4"


def test_country(spark):
    assert one(spark, normalize.country_key(F.col("a")), a="  United \t STATES ") == "united states"
    assert one(spark, normalize.country_key(F.col("a")), a=None) == ""


def test_both_ways_of_folding_agree(spark):
    rng = random.Random(1)
    texts = ["".join(chr(rng.randrange(128)) for _ in range(rng.randrange(12))) for _ in range(400)] + ["É" + "a_b" * 3, "ß & ½", "", "\x1c x \x1f"]
    frame = spark.createDataFrame([(t,) for t in texts], "a string")
    for r in frame.select("a", normalize._fold(F.col("a")).alias("x"), normalize.country_key(F.col("a")).alias("y")).collect():
        assert (r.x, r.y) == (normalize.fold(r.a), normalize.fold_country(r.a))


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_folding_is_stable(text):
    folded = normalize.fold(text)
    assert folded == folded.strip() and "_" not in folded and not any(unicodedata.combining(c) for c in folded)
    if folded.isascii():
        assert normalize.fold(folded) == folded


def test_grams_of_short_tokens(spark):
    assert sorted(one(spark, grams.char_grams(F.col("a")), a="ab")) == sorted([" a", "ab", "b ", " ab", "ab ", " ab "])
    assert sorted(one(spark, grams.char_grams(F.col("a")), a="x")) == sorted([" x", "x ", " x "])
    assert one(spark, grams.char_grams(F.col("a")), a="") == []


def test_grams_against_python(spark):
    text = "saint mary and company 42"
    want = []
    for token in text.split():
        padded = f" {token} "
        for n in range(2, 6):
            found = [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]
            want += found
            if len(found) == 1:
                break
    assert sorted(one(spark, grams.char_grams(F.col("a")), a=text)) == sorted(want)


def test_minhash_agrees_as_sets_do(spark):
    a, b = list(range(0, 900)), list(range(300, 1200))
    row = spark.createDataFrame([(a, b, [])], "a array<int>, b array<int>, c array<int>").select(*(grams.minhash(F.col(c), 256).alias(c) for c in "abc")).first()
    assert abs(sum(x == y for x, y in zip(row.a, row.b, strict=True)) / 256 - 0.5) < 0.12
    assert row.c is None


def test_token_similarities(spark):
    a, b = S.token_set(F.col("a")), S.token_set(F.col("b"))
    both = spark.createDataFrame([("a a b", "a c"), ("", "")], "a string, b string")
    rows = both.select(S.overlap(a, b), S.jaccard(a, b), S.containment(a, b), F.size(a), F.size(b)).collect()
    assert tuple(rows[0]) == (1, pytest.approx(1 / 3), 0.5, 2, 2)
    assert tuple(rows[1]) == (0, 0.0, 0.0, 0, 0)


def test_empty_texts_have_no_similarity(spark):
    a, b = F.col("a"), F.col("b")
    row = spark.createDataFrame([("", "")], "a string, b string").select(S.exact(a, b), S.edit_similarity(a, b), S.length_ratio(a, b), F.levenshtein(a, b)).first()
    assert tuple(row) == (0, 0.0, 0.0, 0)


@pytest.mark.parametrize("a, b, want", [("12 main 75001", "14 main 75001", (1, 1, 0)), ("12 main", "12 oak", (1, 0, 1)), ("a12 x", "a12 x", (0, 0, 0)), ("main 7", "7 oak", (1, 0, 1))])
def test_numbers(spark, a, b, want):
    x, y = S.numbers(F.col("a")), S.numbers(F.col("b"))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(S.shares_number(x, y), S.shares_number(x, y, 3, 10), S.same_first(x, y)).first()
    assert tuple(row) == want
