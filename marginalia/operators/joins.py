"""Joins of items with their reviews, and deduplication of the item side."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of a hot key for each partition its rows would fill; more of them spread more evenly.
SALTS = 16
#: Counters of the sketch for each shuffle partition: a key's count is wrong by 3.5 / (COUNTERS * partitions) of all rows at most.
COUNTERS = 32
#: Rows of a partition up to which a hash table of them is asked for.
HASH_ROWS = 1_000_000


def with_items(reviews: DataFrame, items: DataFrame, *keys: str) -> DataFrame:
    """Inner join on the keys; Spark broadcasts the items if they turn out small, else both sides are shuffled."""
    return reviews.join(items, list(keys))


def keep_last(df: DataFrame, row_id: str, *keys: str) -> DataFrame:
    """One row for each value of the keys: the one with the greatest row id. Row ids are unique; rows without one go."""
    # ids alone are aggregated, by hash, and each task passes on one a key; the join's keys are the ids, so none is hot
    return df.join(df.groupBy(*keys).agg(F.max(row_id).alias(row_id)).select(row_id), row_id, "left_semi")


def keep_first(df: DataFrame, order: tuple[str, ...], *keys: str) -> DataFrame:
    """One row for each value of the keys: the first in the order. A single column of the order is a unique row id, as for the last."""
    if len(order) == 1:
        return df.join(df.groupBy(*keys).agg(F.min(order[0]).alias(order[0])).select(order[0]), order[0], "left_semi")
    # an aggregate, not a window: each task passes on one row a key, however many rows a key has
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def with_item_groups(reviews: DataFrame, groups: dict[str, DataFrame], key: str) -> DataFrame:
    """Reviews joined once with the items of several queries, each row tagged with its ``query_group``."""
    tagged = [items.withColumn("query_group", F.lit(name)) for name, items in groups.items()]
    every = tagged[0]
    for items in tagged[1:]:
        every = every.unionByName(items)
    return reviews.join(every, key)


def semi(df: DataFrame, keys: DataFrame, *names: str) -> DataFrame:
    return df.join(keys, list(names), "left_semi")


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """``key_hash, parts``: the keys that hold more rows than a partition's fair share, with the parts to split them into.

    A sketch of heavy hitters counts them: each task passes on a bounded number of counters, and the result has fewer rows
    than there are partitions. Rows with a null key meet nothing and aren't counted.
    """
    partitions = partitions or partitions_of(df)
    counted = df.where(_known(keys)).select(F.xxhash64(*keys).alias("key_hash"))
    top = F.call_function("approx_top_k", F.col("key_hash"), F.lit(partitions), F.lit(max(1000, COUNTERS * partitions)))
    found = counted.agg(F.count("*").alias("n"), top.alias("top")).select("n", F.explode("top").alias("one"))
    share = F.col("one.count") / F.col("n")
    return found.where(share > 1 / partitions).select(F.col("one.item").alias("key_hash"), F.ceil(share * partitions * SALTS).cast("int").alias("parts"))


def with_items_split(reviews: DataFrame, items: DataFrame, *keys: str, spread: tuple[str, ...] | None = None, hot: DataFrame | None = None, hint: str | None = None) -> DataFrame:
    """Inner join on the keys whose hot keys are split by plan: their reviews are dealt to parts, their items copied to each part.

    ``spread`` names columns that tell a hot key's reviews apart (all of them if not given; equal reviews stay together).
    ``hot`` takes the keys from ``hot_keys`` of other rows: a stream can't be counted before it runs, its history can.
    ``hint`` fixes the join's kind, such as ``shuffle_hash``, which Spark itself neither splits nor spills.
    Rows with a null key meet nothing. The copies are fewer than SALTS for a partition and a hot key's item, so they don't
    grow with the rows; the parts follow from the rows' values, so that a task that runs again deals them alike.
    """
    if hot is None:
        hot = hot_keys(reviews, *keys)
    hashed, part, parts = _unused("key_hash", reviews, items), _unused("part", reviews, items), _unused("parts", reviews, items)
    # fewer rows than partitions: they may go to every task
    known = F.broadcast(hot.select(F.col("key_hash").alias(hashed), F.col("parts").alias(parts)))
    most = F.coalesce(F.col(parts), F.lit(1))
    each = F.xxhash64(*(spread or reviews.columns))
    left = reviews.where(_known(keys)).withColumn(hashed, F.xxhash64(*keys)).join(known, hashed, "left")
    left = left.select(*reviews.columns, F.pmod(each, most).cast("int").alias(part))
    right = items.where(_known(keys)).withColumn(hashed, F.xxhash64(*keys)).join(known, hashed, "left")
    right = right.select(*items.columns, F.explode(F.sequence(F.lit(0), most - 1)).alias(part))
    return left.join(right.hint(hint) if hint else right, [*keys, part]).drop(part)


def _known(keys: tuple[str, ...]):
    every = F.col(keys[0]).isNotNull()
    for key in keys[1:]:
        every = every & F.col(key).isNotNull()
    return every


def _unused(name: str, *tables: DataFrame) -> str:
    """The name, with underscores before it until no table has such a column."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name in taken:
        name = "_" + name
    return name


def shuffled(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Join with both sides dealt by the key, in hash tables a partition where a count of the right side lets them fit."""
    fits = ceil(right.count() / partitions_of(right)) <= HASH_ROWS
    return left.join(right.hint("shuffle_hash" if fits else "shuffle_merge"), key)
