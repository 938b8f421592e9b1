"""Text and Arabic functions on the pairs that must and must not agree."""

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import arabic as ar
from lumenfold.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Pairs made from the rules: a suffix goes if three letters stay, the longest first, twice over; y after a consonant turns to i; an ending double letter halves.
SAME = [("plant", "plants"), ("plant", "planted"), ("plant", "planter"), ("kindness", "kind"), ("slow", "slowly"), ("stop", "stopping"), ("bake", "baking"), ("careful", "care"), ("govern", "governments")]
APART = [("plant", "planet"), ("bat", "batter_x"), ("king", "kind"), ("sea", "seed"), ("card", "care")]


def test_stems(spark):
    rows = spark.createDataFrame([(a, b, True) for a, b in SAME] + [(a, b, False) for a, b in APART], "a string, b string, same boolean")
    assert rows.where((tx.stem(F.col("a")) == tx.stem(F.col("b"))) != F.col("same")).collect() == []


def test_keys(spark):
    same = [("faarooq", "farouk"), ("khadeeja", "kadija"), ("shukr", "sukr"), ("latteef", "lateef"), ("qadir", "kaadir")]
    apart = [("farooq", "rafiq"), ("salim", "malik"), ("nur", "nadir")]
    rows = spark.createDataFrame([(a, b, True) for a, b in same] + [(a, b, False) for a, b in apart], "a string, b string, same boolean")
    assert rows.where((tx.spelling_key(F.col("a")) == tx.spelling_key(F.col("b"))) != F.col("same")).collect() == []


@pytest.mark.parametrize("mark", [*range(0x64B, 0x660), 0x670])
def test_marks_go(spark, mark):
    assert chr(mark) not in one(spark, ar.normalized(F.lit(f"م{chr(mark)}ن")))


def test_arabic_forms(spark):
    assert "موسي" in one(spark, ar.passage_forms(F.lit("يَٰمُوسَىٰ")))
    assert "الصبر" in one(spark, ar.passage_forms(F.lit("بِٱلصَّبْرِ")))
    assert {"العالمين", "العلمين"} <= set(one(spark, ar.passage_forms(F.lit("ٱلْعَٰلَمِينَ"))))
    assert one(spark, ar.query_terms(F.lit("من و الذي"))) == []
    assert one(spark, ar.query_terms(F.lit("mercy الرحمن"))) == [["الرحمن"]]


def test_vector_terms(spark):
    assert one(spark, tx.vector_terms(F.lit("The Cat and a dog"))) == ["cat", "dog", "cat dog"]
    assert one(spark, tx.vector_terms(F.lit("the a"))) == [] and one(spark, tx.vector_terms(F.lit("one"))) == ["one"]


def test_cleaning(spark):
    text = "header line\n12\nThe Lord7 of the  worlds [1:2] , and .\n99 out of 100\n"
    assert one(spark, tx.clean(F.lit(text))) == "header line The Lord of the worlds, and. 99 out of 100".replace("and. 99", "and. 99")
    assert "[1:2]" in one(spark, tx.clean(F.lit(text), keep_citations=True))
    kept = one(spark, tx.without_furniture(F.lit("My Book p1\n\n 3 out of 9 \n12 Footnote\n(Repeated)\ntext"), "My Book"))
    assert kept == "text"


def test_opening_and_budget(spark):
    cut = lambda t, c, v: one(spark, tx.without_opening(F.lit(t), F.lit(c), F.lit(v), F.lit("﻿In the name ")))
    assert cut("﻿In the name Read", 96, 1) == "Read" and cut("In the name", 1, 1) == "In the name" and cut("In the name x", 2, 2) == "In the name x"
    assert one(spark, tx.within_budget(F.lit(""))).startswith("(no") and one(spark, tx.within_budget(F.lit("x" * 12_001))).endswith("length]")
    assert tx.origins(" a, ,b ") == ["a", "b"]


def test_client_keys(spark):
    key = lambda f, p, h: one(spark, tx.client_key(F.lit(f).cast("string"), F.lit(p).cast("string"), h))
    assert key("6.6.6.6, 1.2.3.4", "10.0.0.1", 1) == "1.2.3.4" and key("a, b, c", "p", 2) == "b" and key("a", "p", 5) == "a"
    assert key("a", "p", 0) == "p" and key(None, "p", 1) == "p" and key(" , ", "p", 1) == "p" and key(None, None, 1) == "unknown"
