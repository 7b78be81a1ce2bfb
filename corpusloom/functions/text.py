"""String functions with CPython's meaning, as column expressions.

Spark's ``trim`` strips spaces only and Java's ``\\s`` is ASCII, so white space,
line ends and digits are explicit classes here.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points that CPython takes for white space, and its line ends.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TURKISH = "çğıöşüÇĞİÖŞÜ"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"^[{WS}]+|[{WS}]+\z", "")


def normalise(col: Column) -> Column:
    """Stripped, lower case, runs of white space as one space."""
    return F.regexp_replace(F.lower(strip(col)), rf"[{WS}]+", " ")


def words(col: Column) -> Column:
    """Words of a normalised text."""
    return F.filter(F.split(col, " "), lambda w: w != "")


def split_lines(col: Column) -> Column:
    """Lines, stripped, without blank ones."""
    return F.filter(F.transform(F.split(col, LINE_END), strip), lambda s: s != "")


def close_blank_lines(col: Column) -> Column:
    """Blank lines inside a document go, so that they do not look like its end (one pass)."""
    return F.regexp_replace(col, "\n[ \t]*\n+", "\n")


@cache
def digits() -> str:
    """What CPython's isdigit accepts: decimal digits and further ones, such as superscripts."""
    return "".join(chr(c) for c in range(0x110000) if chr(c).isdigit())


def count_digits(col: Column) -> Column:
    """A character is looked up once: a regular expression would try each on a class of over a hundred characters."""
    return count_any(col, digits())


def count_any(col: Column, letters: str) -> Column:
    return F.length(col) - F.length(F.translate(col, letters, ""))


def _fold_text(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.replace("İ", "i").replace("I", "i").lower())
    return "".join(c for c in s if not unicodedata.combining(c))


@cache
def _latin() -> tuple[str, str, str]:
    """Letters up to U+024F whose folding is one character: (from, to), and a class of all others."""
    simple = [(chr(c), f) for c in range(0x250) if len(f := _fold_text(chr(c))) == 1]
    others = "".join(f"\\x{{{c:x}}}" for c in range(0x250) if len(_fold_text(chr(c))) != 1)
    changed = [(a, b) for a, b in simple if a.lower() != b and a not in "Iİ"]
    return "".join(a for a, _ in changed), "".join(b for _, b in changed), rf"[{others}\x{{250}}-\x{{10ffff}}]"


@F.pandas_udf(T.StringType())
def _fold_rest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(_fold_text, na_action="ignore")


def fold(col: Column) -> Column:
    """Lower case without marks; I and dotted I become i, a dotless i stays.

    Texts of simple Latin letters are folded in the JVM; only others, as nulls do
    not travel, reach the Arrow function that decomposes all of Unicode.
    """
    source, target, rest = _latin()
    simple = F.translate(F.lower(F.translate(F.translate(col, "İ", "i"), "I", "i")), source, target)
    return F.coalesce(_fold_rest(F.when(F.regexp_like(col, F.lit(rest)), col)), simple)
