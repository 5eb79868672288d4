"""Value rules, domains and text helpers."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import semantics as sem
from cairn.functions.semantics import ids_of
from cairn.functions.text import (
    clean_query,
    count_words,
    fold_word,
    free_terms,
    holds_words,
    like_pattern,
    matches,
    query_terms,
    rank,
)
from cairn.operators.domains import domain_methods, domains
from tests.fixtures import rows

TEXTS = ["12", " 12 ", "12abc", "", None, "Infinity", "NaN", "1e999", "12d", ".5", "-3.5e1x", "<3"]


def one_column(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_leading_number(spark):
    got = one_column(spark, TEXTS, sem.leading_number)
    assert got == [12, 12, 12, None, None, None, None, float("inf"), 12, 0.5, -35, None]


def test_leading_integer(spark):
    got = one_column(spark, ["12.7", "77b", "x", "-4", None], sem.leading_integer)
    assert got == [12, 77, None, -4, None]


def test_finite_number_needs_the_whole_text(spark):
    got = one_column(spark, TEXTS, sem.finite_number)
    assert got == [12, 12, None, None, None, None, None, None, None, 0.5, None, None]


def test_half_up(spark):
    df = spark.createDataFrame([(0.5,), (-0.5,), (1.4,), (-1.6,)], "v double")
    assert [r[0] for r in df.select(sem.half_up(F.col("v"))).collect()] == [1, 0, 1, -2]


def test_truthy(spark):
    df = spark.createDataFrame([(0.0, ""), (None, None), (-1.0, "a")], "n double, s string")
    got = df.select(sem.truthy(F.col("n")), sem.truthy_text(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(False, False), (False, False), (True, True)]


def test_id_lists(spark, roles):
    site = roles["site"]
    count = lambda ids: sem.ids_of(site, ids).count()
    assert count(None) == 5
    assert count([]) == 0
    assert count([2]) == 1
    assert count([1, 1, 77]) == 1
    assert count(list(range(3, 5000))) == 3  # long lists join
    assert count(spark.createDataFrame([(1,), (1,), (4,)], "x long")) == 2


def test_domains_parse_the_first_plain_list(roles):
    got = rows(domains(roles).select("domain_id", "method_ids"))
    assert got == [(1, [8, 3, 60]), (2, [60])]
    every = rows(domains(roles, drop_empty=False).select("domain_id", F.size("method_ids")))
    assert every == [(1, 3), (2, 1), (3, 0), (4, 0)]
    digits = dict(rows(domains(roles, digit_runs=True).select("domain_id", "method_ids")))
    assert digits == {1: [8, 3, 60, 2020, 1], 2: [60], 3: [3]}
    assert rows(domain_methods(roles).where("domain_id = 1").select("method_pos", "method_id")) == [
        (0, 8), (1, 3), (2, 60),
    ]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("  a \n b ", "a b"), ("%%", ""), (None, ""), ("é", "é"), ("\x00x\x7f", "x")],
)
def test_clean_query(raw, clean):
    assert clean_query(raw) == clean


@pytest.mark.parametrize(
    ("query", "text", "holds"),
    [
        ("alpha farm", "Farm north alpha", True),
        ('"alpha farm"', "Farm north alpha", False),
        ('"alpha farm"', "the Alpha Farm", True),
        ("alpha -north", "Farm north alpha", False),
        ("beta or alpha", "Alpha", True),
        ("alph", "Alpha", False),
        ("alpha-farm", "old alpha farm", True),
        ("alpha-farm", "farm alpha", False),
        ("-north", "south", True),
        ("Ä", "ä ö", True),
    ],
)
def test_query_matches(spark, query, text, holds):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(matches(F.col("v"), query_terms(query))).first()[0] is holds


def test_rank_of_one_term_counts_occurrences(spark):
    df = spark.createDataFrame([("a b a",), ("c",), (None,)], "v string")
    got = [r[0] for r in df.select(rank(F.col("v"), query_terms("a"), "B")).collect()]
    assert got == [pytest.approx(0.8 / 1.8), 0.0, 0.0]


def test_id_lists_of_any_length_and_type(spark):
    texts = spark.createDataFrame([(f"id-{k}",) for k in range(3000)], "entity string")
    for n in (0, 900, 1500):
        assert ids_of(texts, [f"id-{k}" for k in range(n)], "entity").count() == n
    assert ids_of(texts, None, "entity").count() == 3000


def test_accents_of_any_kind():
    for text, word in (("šč ł ő ā", "šč"), ("Ö", "o")):
        assert fold_word(text[0]) == fold_word(word[0]) or len(word) == 1
    assert fold_word("ŁÓDŹ") == "lodz" and fold_word("e\u0301") == "e"
    assert like_pattern("a\\b") == "ab" and like_pattern("a\\%_") == "a\\%_" and like_pattern("a\\") == "a\\\\"


def test_free_terms():
    words, phrases, unwanted = free_terms('big "old barn" -wet -"new roof" or x-y')
    assert words == ["barn", "big", "old", "x", "y"] and phrases == [("old", "barn")]
    assert unwanted == [("wet",), ("new", "roof")]


def test_words_match_with_any_accents(spark):
    rows = spark.createDataFrame([("Šč łódź",), ("s\u030cc\u030c LODZ lodz",), ("scx",)], "t string")
    counted = rows.select(count_words(F.col("t"), ["sc", "łodz"])).collect()
    assert [r[0] for r in counted] == [2, 3, 0]
    assert [r[0] for r in rows.select(holds_words(F.col("t"), ("SC", "lodz"))).collect()] == [True, True, False]
