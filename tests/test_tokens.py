import math

import pytest
from pyspark.sql import functions as F

from schemaloom import vocabulary as V
from schemaloom.functions import tokens as T


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, words",
    [
        ("OrderDateX1", ["order", "date", "x1"]),
        ("SP_CODE#2", ["sp", "code", "2"]),
        ("Addresses", ["addresses", "addresse"]),
        ("this/that", ["this", "thi"]),
        ("UTME", ["utme"]),
        ("", []),
        ("Größe_cm", ["gr", "e", "cm"]),
        ("bus gas ass", ["bus", "gas", "ass"]),
        # A stem may be a stopword: "alls" is none, its stem "all" is.
        ("alls", ["alls", "all"]),
        ("Obs Count#", ["obs", "count"]),
    ],
)
def test_split_identifier(spark, text, words):
    assert value(spark, T.split_identifier(F.lit(text))) == words


def test_question_tokens_expand_once_in_order(spark):
    got = value(spark, T.question_tokens(F.lit("Year of utm alls")))
    date = ["date", "day", "month", "time", "year"]
    utm = sorted({w for g in V.SYNONYM_GROUPS if "utm" in g for w in g})
    assert got == ["year"] + [w for w in date if w != "year"] + ["utm"] + [w for w in utm if w != "utm"] + ["alls"]
    # `number` stands for `count` but is a stopword.
    assert "number" not in value(spark, T.question_tokens(F.lit("count")))


def test_token_overlap(spark):
    words = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    assert value(spark, T.token_overlap(words("a", "b"), words("b", "c", "b"))) == pytest.approx(1 / math.sqrt(2))
    assert value(spark, T.token_overlap(words("a"), words())) == 0.0
    assert value(spark, T.token_overlap(words(), words("a"))) == 0.0


@pytest.mark.parametrize(
    "question, name, score",
    [
        ("show the ship date", "ship_date", 4.5),
        ("show the shipdate", "ship_date", 1.5),
        ("max value", "x", 3.0),  # a one-letter name needs no word of its own
        ("abc", "", 0.0),
        ("abc", "##", 0.0),
        ("the cat", "cat", 3.0),
    ],
)
def test_substring_score(spark, question, name, score):
    assert value(spark, T.substring_score(F.lit(question), F.lit(name))) == score


def test_hints_need_both_sides(spark):
    hints = lambda q, c: value(spark, T.operator_hints(T.question_tokens(F.lit(q)), F.lit(c)))
    assert hints("which month", "VisitDate") == 0.35
    assert hints("which place", "VisitDate") == 0.0
    assert hints("total", "obs_count") == 0.25
    assert hints("mean", "RateTime") == pytest.approx(0.15)
    assert hints("mean per year", "RateTime") == pytest.approx(0.5)


def test_sql_helpers(spark):
    sql = F.lit("SELECT a FROM b JOIN c ON x JOIN d ON y WHERE joiner IN (SELECT 1)")
    assert value(spark, T.join_count(sql)) == 2
    assert value(spark, T.sql_contains(sql, V.SUBQUERY_FRAGMENTS)) is True
    assert value(spark, T.sql_contains(sql, V.GROUP_ORDER_FRAGMENTS)) is False
    assert value(spark, T.word_count(F.lit("  one\ttwo\n three "))) == 3


def test_word_mask(spark):
    """Words that are shared show in the masks, whatever else is there."""
    mask = lambda *words: T.word_mask(F.array(*map(F.lit, words)))
    assert value(spark, mask("order", "date").bitwiseAND(mask("date", "x1"))) != 0
    assert value(spark, mask("order", "order") == mask("order"))
    assert value(spark, T.word_mask(F.array().cast("array<string>"))) == 0
