"""String functions against CPython."""

import unicodedata

from pyspark.sql import functions as F

from corpusloom.functions import text as tx

TEXTS = ["", "  a b  ", "\x1c x　y\x85", "A\tB C\nd", "²①٣ 12", "İSTANBUL Iğdır ışık", "CANLI MAÇ İZLE", "canlı maç izle", "kaçak ﬁnans ½", "straße ÄÖÜ ǅ", "日本 ｆｕｌｌ", "a\r\nb\rc\x0bd\x1ee", None]


def column(spark, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", expr.alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


def test_strip_and_normalise(spark):
    assert column(spark, tx.strip(F.col("t"))) == [t if t is None else t.strip() for t in TEXTS]
    assert column(spark, tx.normalise(F.col("t"))) == [t if t is None else " ".join(t.strip().lower().split()) for t in TEXTS]
    assert column(spark, tx.words(tx.normalise(F.col("t"))))[:-1] == [t.lower().split() for t in TEXTS[:-1]]


def test_lines_and_digits(spark):
    assert column(spark, tx.split_lines(F.col("t")))[:-1] == [[s.strip() for s in t.splitlines() if s.strip()] for t in TEXTS[:-1]]
    assert column(spark, tx.count_digits(F.col("t")))[:-1] == [sum(c.isdigit() for c in t) for t in TEXTS[:-1]]


def test_fold(spark):
    def fold(t):
        d = unicodedata.normalize("NFKD", t.replace("İ", "i").replace("I", "i").lower())
        return "".join(c for c in d if not unicodedata.combining(c))

    assert column(spark, tx.fold(F.col("t")))[:-1] == [fold(t) for t in TEXTS[:-1]]
    assert column(spark, tx.fold(F.col("t")))[-1] is None


def test_fold_of_every_latin_letter(spark):
    letters = [chr(c) for c in range(1, 0x250)]
    got = {r["c"]: r["f"] for r in spark.createDataFrame([(c,) for c in letters], "c string").select("c", tx.fold(F.col("c")).alias("f")).collect()}
    for c in letters:
        d = unicodedata.normalize("NFKD", c.replace("İ", "i").replace("I", "i").lower())
        assert got[c] == "".join(x for x in d if not unicodedata.combining(x)), hex(ord(c))


def test_close_blank_lines(spark):
    cases = {"a\n\n\n\nb": "a\nb", "a\n \n \nb": "a\n \nb", "a\r\n\r\nb": "a\r\n\r\nb", "a\nb": "a\nb"}
    got = {r["t"]: r["v"] for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", tx.close_blank_lines(F.col("t")).alias("v")).collect()}
    assert got == cases
