"""Grouped aggregates, rankings and set operations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.scratch import written

#: Keys that a task merges at once before it passes them on.
PARTIAL_KEYS = 100_000
#: First rows that each task may pass on to one; more are cut among ranges.
FEW_ROWS = 10_000


def exploded(df: DataFrame, column: str, alias: str, *others: str) -> DataFrame:
    """A row for each non-empty element of an array."""
    return df.select(*others, F.explode(column).alias(alias)).where(F.col(alias) != "")


def distinct_per_key(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("n_distinct"))


def total(value: Column, scale: int | None = None) -> Column:
    """Sum of doubles; with a scale, of values of so many decimals, exactly and in whatever order they come."""
    return F.sum(value) if scale is None else F.sum(value.cast(f"decimal({18 + scale},{scale})")).cast("double")


def sum_count(df: DataFrame, value: str, *keys: str, scale: int | None = None) -> DataFrame:
    """``total`` and ``n``, the number of values; a null is none, and a key with nulls alone has total null and n 0."""
    return df.groupBy(*keys).agg(total(F.col(value), scale).alias("total"), F.count(value).alias("n"))


def average(df: DataFrame, value: str, *keys: str, scale: int | None = None) -> DataFrame:
    """``average`` and ``n``, over the values that aren't null."""
    return sum_count(df, value, *keys, scale=scale).select(*keys, F.try_divide("total", "n").alias("average"), "n")


def at_least(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.where(F.col(column) >= n)


def merged(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values of one key added up."""
    return df.groupBy(key).agg(F.sum(value).alias(value))


def merged_by(df: DataFrame, key: str, value: str, function: Callable[[Any, Any], Any], order: str | None = None) -> DataFrame:
    """``key, value``: the values of each key merged by an associative function; with an ``order``, in that order.

    Each task merges its own rows first, so that a key comes to the final step once a task, however many rows it has; with an
    order, rows are dealt in ranges of key and order for it. Without an order the function has to be commutative. Nulls are passed over.
    """
    named = df.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value"), (F.col(order) if order else F.lit(0)).alias("at"))
    if order:
        named = named.repartitionByRange("key", "at").sortWithinPartitions("key", "at")
    parts = named.withColumn("part", F.spark_partition_id()).select("key", "value", "part")
    schema = parts.schema

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[Any, list] = {}
        for batch in batches:
            for k, v, part in batch.itertuples(index=False, name=None):
                k = None if k != k else k  # noqa: PLR0124
                if k in held:
                    held[k][0] = function(held[k][0], v)
                else:
                    held[k] = [v, part]
            if len(held) > PARTIAL_KEYS and not order:
                yield _merged_frame(held)
                held = {}
            elif len(held) > PARTIAL_KEYS:  # sorted by key: only the last one may go on
                last = held.pop(k)
                yield _merged_frame(held)
                held = {k: last}
        yield _merged_frame(held)

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: list[tuple] = []  # the key that may go on in the next batch
        for batch in batches:
            keys, values = [k for k, _ in last], [v for _, v in last]
            for k, v in batch[["key", "value"]].itertuples(index=False, name=None):
                k = None if k != k else k  # noqa: PLR0124
                if keys and keys[-1] == k:
                    values[-1] = function(values[-1], v)
                else:
                    keys.append(k)
                    values.append(v)
            last = list(zip(keys[-1:], values[-1:], strict=True))
            yield _values_frame(keys[:-1], values[:-1])
        yield _values_frame([k for k, _ in last], [v for _, v in last])

    # a key's parts come to one task one after the other: a step a part, none a key
    dealt = parts.mapInPandas(fold, schema).repartition("key").sortWithinPartitions("key", "part")
    merged = dealt.mapInPandas(final, parts.select("key", "value").schema)
    return merged.select(F.col("key").alias(key), F.col("value").alias(value))


def _values_frame(keys: list, values: list) -> pd.DataFrame:
    return pd.DataFrame({"key": pd.Series(keys, dtype=object), "value": pd.Series(values, dtype=object)})


def _merged_frame(held: dict[Any, list]) -> pd.DataFrame:
    return _values_frame(list(held), [v for v, _ in held.values()]).assign(part=[p for _, p in held.values()])


def row_counts(results: dict[str, DataFrame]) -> DataFrame:
    """``query, n``: how many rows each result has; results without rows count 0."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("query"), "n") for name, df in results.items()]
    every = counts[0]
    for one in counts[1:]:
        every = every.unionByName(one)
    return every


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in an order. Up to FEW_ROWS each task passes on its first ones; more are cut among ranges of the order."""
    if n <= FEW_ROWS:
        return df.orderBy(*order).limit(n)
    return _first_rows(df, (), [(c, False) for c in order], lambda _: F.lit(n))


def top_n(df: DataFrame, value: str, key: str, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The n rows with the highest value, of each group of ``by`` if there are any; ties by key."""
    if not by and n <= FEW_ROWS:
        return df.orderBy(F.desc(value), key).limit(n)
    if not by:
        return _first_rows(df, (), [(value, True), (key, False)], lambda _: F.lit(n))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), key))
    # the caller's columns in one struct: no name of theirs meets ours
    return df.select(F.struct(*df.columns).alias("row"), place.alias("place")).where(F.col("place") <= n).select("row.*")


def top_fraction(df: DataFrame, value: str, key: str, quantile: int = 90, compat: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows above a quantile, of each group of ``by`` if there are any; rows without a value take no part.

    They are ``floor(n * (100 - quantile) / 100)`` of n, ties by key; with ``compat`` it is ``floor(n / (100 - quantile))``,
    which is the same at 90.
    """
    share = (lambda n: F.floor(n / (100 - quantile))) if compat else (lambda n: F.floor(n * (100 - quantile) / 100))
    return _first_rows(df.where(F.col(value).isNotNull()), by, [(value, True), (key, False)], share)


def _first_rows(df: DataFrame, by: tuple[str, ...], order: list[tuple[str, bool]], places: Callable[[Column], Column]) -> DataFrame:
    """The first rows of each group of ``by`` in an order of columns (true: the greatest first); ``places`` says how many of n.

    Rows are dealt in ranges of the order and written once; ranges are counted, and only the one in which a group's cut falls
    is ranked, so outliers and ties bring no more than a range into a task.
    """
    ranges = df.repartitionByRange(*by, *[F.desc(c) if down else F.asc(c) for c, down in order])
    # the caller's columns in one struct: no name of theirs meets ours
    groups = [F.col(c).alias(f"g{i}") for i, c in enumerate(by)]
    values = [F.col(c).alias(f"v{i}") for i, (c, _) in enumerate(order)]
    dealt = written(ranges.select(F.struct(*df.columns).alias("row"), *groups, *values, F.spark_partition_id().alias("part")))
    keys = [f"g{i}" for i in range(len(by))]
    group = Window.partitionBy(*keys) if by else Window.partitionBy(F.lit(0))
    n = F.sum("count").over(group)
    cuts = (
        dealt.groupBy(*keys, "part")
        .count()
        .withColumn("room", places(n) - F.sum("count").over(group.orderBy("part")) + F.col("count"))
        .where("room > 0")
        .withColumn("whole", F.col("room") >= F.col("count"))
        .drop("count")
    )
    keys = [*keys, "part"]
    # null-safe, as a group may be null
    near = dealt.alias("d").join(cuts.alias("c"), [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in keys]).select("d.*", "room", "whole")
    inside = [F.desc(f"v{i}") if down else F.asc(f"v{i}") for i, (_, down) in enumerate(order)]
    edge = near.where("NOT whole").withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*inside))).where("place <= room")
    return near.where("whole").select("row.*").unionByName(edge.select("row.*"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, as often as it lacks them: ``+`` for left, ``-`` for right."""
    return left.exceptAll(right).withColumn("side", F.lit("+")).unionByName(right.exceptAll(left).withColumn("side", F.lit("-")))
