"""Column functions that clean the text fields of a catalogue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_year(text: Column) -> Column:
    """Year of a date text: empty is 0, ``*`` is dropped, ``?`` reads as 0, what follows a ``-`` doesn't count.

    Text that is no number then gives null.
    """
    plain = F.split(F.regexp_replace(F.regexp_replace(text, r"\*", ""), r"\?", "0"), "-")[0]
    return F.when(text == "", F.lit(0)).otherwise(F.trim(plain).try_cast("int"))


def parse_list(text: Column) -> Column:
    """Elements of a printed list: brackets go, and double quotes if there are any, else single ones."""
    bare = text
    for mark in ('"[', ']"', "[", "]"):
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    bare = F.replace(bare, F.lit(", "), F.lit(","))
    quoted = F.contains(bare, F.lit('"'))
    bare = F.when(quoted, F.replace(bare, F.lit('"'), F.lit(""))).otherwise(F.replace(bare, F.lit("'"), F.lit("")))
    return F.split(bare, ",", -1)


def parse_categories(text: Column) -> Column:
    """Categories of ``['A & B']``."""
    bare = F.replace(F.replace(text, F.lit("['"), F.lit("")), F.lit("']"), F.lit(""))
    return F.split(bare, " & ", -1)


def list_literal(text: Column) -> Column:
    """A quoted list with either kind of quotes; null if it isn't one."""
    return F.from_json(text, "array<string>", {"allowSingleQuotes": "true"})


def decade(year: Column) -> Column:
    return year - F.pmod(year, F.lit(10))


def score(text: Column) -> Column:
    return text.try_cast("double")


def contains_folded(text: Column, keyword: str) -> Column:
    """Whether a text has the keyword anywhere, whatever the case."""
    return F.contains(F.lower(text), F.lit(keyword.lower()))
