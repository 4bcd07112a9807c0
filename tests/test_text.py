"""Literal cases of the text and metadata functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inkwell.functions import language, metadata
from inkwell.functions import text as T


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_paragraphs(spark):
    assert one(spark, T.paragraphs, "first line\nsecond line\n\n\nnext block\n") == ["first line second line", "next block"]
    assert one(spark, T.paragraphs, "") == []
    assert one(spark, T.paragraphs, None) is None


def test_clean_book(spark):
    assert one(spark, T.clean_book, "A [Illustration: a cat] _very_ [Pg 12]good day.").split() == "A very good day.".split()


def test_split_long_is_lossless(spark):
    text = " ".join(["One two three four five six seven eight nine ten."] * 30)
    pieces = [p["passage"] for p in one(spark, lambda t: T.split_long(t, 60), text)]
    assert len(pieces) > 1 and all(len(p.split()) <= 60 for p in pieces) and " ".join(pieces) == text


def test_a_longer_sentence_stays_whole(spark):
    text = "word " * 80 + "end. Next one."
    assert [(len(p["passage"].split()), p["n_words"]) for p in one(spark, lambda t: T.split_long(t, 60), text)] == [(81, 81), (2, 2)]


@pytest.mark.parametrize("text", ["CHAPTER I", "See https://x.org for more.", "1. 2. 3. 4. 5.", "“Yes.” “No.” “Why?”", "Some text without an end", "The SHOUTED words are no prose."])
def test_no_prose(spark, text):
    assert one(spark, T.is_prose, text) is False


def test_prose(spark):
    assert one(spark, T.is_prose, "The garden was quiet, and the old man walked slowly to the gate.") is True


def test_running_prose(spark):
    assert one(spark, T.is_running_prose, "The old man walked to the gate. He opened it and looked down the road. ") is True
    assert one(spark, T.is_running_prose, "Apples 12, pears 30, plums 45, figs 60.") is False


def test_strange_accents(spark):
    assert one(spark, T.has_strange_accents, "Gráce á l'obscurité, fréres") is True
    assert one(spark, T.has_strange_accents, "Il était allé à Besançon, naïve et ravi.") is False


def test_fold(spark):
    assert one(spark, T.fold, "Été ÇA naïve Ÿ") == "ete ca naive y"


def test_strip_boilerplate(spark):
    body = "head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nThe book.\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nfoot"
    assert one(spark, T.strip_boilerplate, body) == "\nThe book.\n"
    with pytest.raises(Exception, match="markers not found"):
        one(spark, T.strip_boilerplate, "no markers")


@pytest.mark.parametrize(
    ("text", "guess"),
    [
        ("It was the best of times, and it was the worst of times for all of them.", "en"),
        ("L'homme est un animal qui pense, et il n'a pas toujours raison dans ce monde.", "fr"),
        ("L'Oréal shares fell after D'Amico's note on L'Occitane's sales.", None),
        ("Bonjour", None),
        ("", None),
        ("the le of de and et to à in dans is est", None),
    ],
)
def test_language(spark, text, guess):
    assert one(spark, language.guess, text) == guess


@pytest.mark.parametrize(("dump", "year"), [("CC-MAIN-2021-21", 2021), (None, None), ("unknown", None)])
def test_crawl_year(spark, dump, year):
    assert one(spark, metadata.crawl_year, dump) == year


def test_mojibake_is_left_alone_where_it_is_none(spark):
    assert one(spark, metadata.fix_mojibake, "déjà vu Ã") == "déjà vu Ã"
    assert one(spark, metadata.fix_mojibake, "mÃ©tiers") == "métiers"
