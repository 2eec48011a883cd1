"""Sentiment by lexicon."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A lexicon of no more entries is looked up row by row in a table that is a constant of the plan; a larger one is joined.
TABLE_WORDS = 50_000


def words(text: Column) -> Column:
    """Lower-case words of Latin letters, in order."""
    return F.filter(_pieces(text), lambda w: w != "")


def _pieces(text: Column) -> Column:
    """``words``, and an empty text where something else stands before the first word or after the last."""
    return F.split(F.lower(text), "[^a-z]+")


def with_polarity(df: DataFrame, lexicon: DataFrame, text: str, key: str, negations: list[str] | None = None) -> DataFrame:
    """``df`` with ``sentiment``: mean polarity of the words in the lexicon (``word, polarity``); 0 if none is, or no text.

    A hit right after one of the ``negations`` counts the other way, by half. Each word stands in the lexicon once.
    Rows stay where they are unless the lexicon is larger than TABLE_WORDS; then words are joined with it and brought
    together again by ``key``, which must be unique.
    """
    known = _known(lexicon)
    n = known.limit(TABLE_WORDS + 1).count()
    if n > TABLE_WORDS:
        return _joined(df, known, text, key, negations or [])
    table, before = _table(known, n), [w for w in negations or [] if w]
    # one fold over the pieces, of which empty ones stand at the ends only and are in neither list; most words leave the state as it is
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(False).alias("turned"))

    def step(a: Column, w: Column) -> Column:
        value = table(w)
        turns = w.isin(before) if before else F.lit(False)
        hit = F.struct((a["s"] + F.when(a["turned"], value * -0.5).otherwise(value)).alias("s"), (a["n"] + 1).alias("n"), turns.alias("turned"))
        if not before:
            return F.when(value.isNull(), a).otherwise(hit)
        other = F.struct(a["s"].alias("s"), a["n"].alias("n"), turns.alias("turned"))
        return F.when(value.isNotNull(), hit).when(turns == a["turned"], a).otherwise(other)

    mean = F.aggregate(_pieces(F.col(text)), start, step, lambda a: F.try_divide(a["s"], a["n"]))
    return df.withColumn("sentiment", F.coalesce(mean, F.lit(0.0)))


def polarity(df: DataFrame, lexicon: DataFrame, text: str, key: str, negations: list[str] | None = None) -> DataFrame:
    """``key, sentiment`` as ``with_polarity`` finds it."""
    return with_polarity(df.select(key, text), lexicon, text, key, negations).select(key, "sentiment")


def with_intensity(df: DataFrame, lexicon: DataFrame, text: str, intensifiers: dict[str, float], negations: list[str] | None = None) -> DataFrame:
    """``df`` with ``sentiment`` as ``with_polarity`` has it, but for the modifiers that stand right before a word of the lexicon.

    Each intensifier in an unbroken row of modifiers multiplies the word's polarity by its strength, each negation by -0.5: so
    "not very good" is -0.5 times the strength of "very" times "good". What comes out is held to -1 to 1. A modifier carries no
    polarity of its own, and any other word ends its effect. One fold over the words of a row, which stays where it is; the
    lexicon has TABLE_WORDS entries at most.
    """
    known = _known(lexicon)
    n = known.limit(TABLE_WORDS + 1).count()
    if n > TABLE_WORDS:
        raise ValueError(f"intensity takes a lexicon of {TABLE_WORDS} words at most")
    table = _table(known, n)
    strength = {w: by for w, by in {**intensifiers, **dict.fromkeys(negations or [], -0.5)}.items() if w}
    modifiers = F.from_json(F.lit(json.dumps(strength)), "map<string,double>")
    one, none = F.lit(1.0), F.lit(0.0)
    start = F.struct(one.alias("factor"), none.alias("s"), F.lit(0).alias("n"))

    def step(a: Column, w: Column) -> Column:
        factor, value = F.element_at(modifiers, w), table(w)
        hit = F.struct(one.alias("factor"), (a["s"] + F.greatest(F.least(value * a["factor"], one), F.lit(-1.0))).alias("s"), (a["n"] + 1).alias("n"))
        other = F.struct(one.alias("factor"), a["s"].alias("s"), a["n"].alias("n"))
        carried = F.struct((a["factor"] * factor).alias("factor"), a["s"].alias("s"), a["n"].alias("n"))
        return F.when(factor.isNotNull(), carried).when(value.isNotNull(), hit).when(a["factor"] == one, a).otherwise(other)

    mean = F.aggregate(_pieces(F.col(text)), start, step, lambda a: F.try_divide(a["s"], a["n"]))
    return df.withColumn("sentiment", F.coalesce(mean, none))


def _known(lexicon: DataFrame) -> DataFrame:
    return lexicon.where("word <> '' AND polarity IS NOT NULL")


def _table(lexicon: DataFrame, n: int):
    """Polarity of a word, by an array of small maps that a hash of the word chooses from."""
    size = max(1, n)
    rows = lexicon.select(F.pmod(F.xxhash64("word"), F.lit(size)).alias("slot"), "word", "polarity").collect()
    slots: list[dict[str, float]] = [{} for _ in range(size)]
    for slot, word, value in rows:
        slots[slot][word] = value
    table = F.from_json(F.lit(json.dumps(slots)), "array<map<string,double>>")
    return lambda w: F.element_at(F.get(table, F.pmod(F.xxhash64(w), F.lit(size)).cast("int")), w)


def _each(text: Column, value: Callable[[Column, Column], Column]) -> Column:
    """``value`` of each word and the one before it; the words are split once a row."""
    return F.flatten(F.transform(F.array(words(text)), lambda each: F.transform(each, lambda w, i: value(w, F.get(each, i - 1)))))


def _value(found: Column, before: Column, negations: list[str]) -> Column:
    return F.when(before.isin(negations), found * -0.5).otherwise(found) if negations else found


def _joined(df: DataFrame, lexicon: DataFrame, text: str, key: str, negations: list[str]) -> DataFrame:
    pairs = _each(F.col(text), lambda w, before: F.struct(w.alias("word"), before.alias("before")))
    found = df.select(key, F.inline(pairs)).join(lexicon, "word")
    hits = found.groupBy(key).agg(F.avg(_value(F.col("polarity"), F.col("before"), negations)).alias("sentiment"))
    return df.join(hits, key, "left").withColumn("sentiment", F.coalesce("sentiment", F.lit(0.0)))
