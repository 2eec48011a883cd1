"""Row filters and routing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.parsing import contains_folded

#: A set of no more elements is a constant of the plan.
SMALL_SET = 1000
#: Words of 64 bits in a Bloom filter at most.
BLOOM_WORDS = 1 << 20


def in_range(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Rows with ``low <= column <= high``."""
    return df.where(F.col(column).between(low, high))


def has_keyword(df: DataFrame, column: str, keyword: str) -> DataFrame:
    return df.where(contains_folded(F.col(column), keyword))


def has_element(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose array has exactly this element."""
    return df.where(F.array_contains(column, value))


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns))


def overlaps(df: DataFrame, column: str, wanted: DataFrame, id_col: str) -> DataFrame:
    """Rows of which an array element is among ``wanted`` (one column); nulls match nothing.

    Up to SMALL_SET wanted elements are a constant of the plan, and rows are filtered where they are. Beyond that it is a
    semi join of the elements, of which those that a Bloom filter of the wanted ones doesn't hold go before the shuffle, then
    one of the ids.
    """
    element = wanted.columns[0]
    known = wanted.where(F.col(element).isNotNull())
    few = known.limit(SMALL_SET + 1).collect()
    if len(few) <= SMALL_SET:
        return df.where(F.arrays_overlap(column, F.lit([r[0] for r in few]))) if few else df.where(F.lit(False))
    each = df.select(F.col(id_col).alias("id"), F.explode(column).alias("element"))
    may = bloom(known)
    hits = each.where(may(F.col("element"))).join(known.select(F.col(element).alias("element")), "element", "left_semi")
    return df.join(hits.select(F.col("id").alias(id_col)), id_col, "left_semi")


def bloom(wanted: DataFrame) -> Callable[[Column], Column]:
    """A test for a Bloom filter of ``wanted`` (one column of any type but maps): false for no value that it has.

    Each value sets four bits of one word of 64; there is a word for every four values, up to BLOOM_WORDS of them (8 MB),
    beyond which more values pass and none is lost. The words are an aggregate that runs once, as a scalar subquery of the plan that
    uses the test, outside of lambda functions.
    """
    words = min(BLOOM_WORDS, wanted.count() // 4 + 1)

    def bits(hashed: Column) -> Column:
        one = F.lit(1).cast("bigint")
        at = [F.shiftrightunsigned(hashed, 32 + 6 * k).bitwiseAND(63).cast("int") for k in range(4)]
        return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", one, x) for x in at])

    def word(hashed: Column) -> Column:
        return F.pmod(hashed, F.lit(words)).cast("int")

    hashed = wanted.select(F.xxhash64(wanted.columns[0]).alias("h")).select(word(F.col("h")).alias("word"), bits(F.col("h")).alias("bits"))
    every = hashed.union(wanted.sparkSession.range(words).select(F.col("id").cast("int"), F.lit(0).cast("bigint")))
    each = every.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = each.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words")).select(F.col("words.bits").alias("words")).scalar()

    def may(value: Column) -> Column:
        mine = F.xxhash64(value)
        return F.get(table, word(mine)).bitwiseAND(bits(mine)) == bits(mine)

    return may


def route(tags: Column, order: list[int]) -> Column:
    """The first tag of ``order`` that the array has; null if it has none."""
    return F.coalesce(*[F.when(F.array_contains(tags, t), F.lit(t)) for t in order])
