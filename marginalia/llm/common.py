"""Shared plumbing of the corpus operators: scratch tables, bounded broadcasts, grouped streams, components."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

from marginalia.scratch import written

#: A side is broadcast only after its rows were counted and are no more than this,
BROADCAST_ROWS = 1_000_000
#: and after the bytes of its values were summed and are no more than this.
BROADCAST_BYTES = 128 << 20

#: Words as all operators see them: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its rows and bytes were counted to be few, else as it is (then the join shuffles).

    ``rows`` is a count that the caller has; values of fixed widths then need no further pass.
    """
    if rows is not None and rows > BROADCAST_ROWS:
        return df
    if rows is None or any(fixed_width(f.dataType) is None for f in df.schema):
        counted = df.agg(F.count("*").alias("n"), F.sum(value_bytes(F.struct(*df.columns), df.schema)).alias("bytes")).first()
        rows, size = max(rows or 0, counted["n"]), counted["bytes"] or 0
    else:
        size = rows * fixed_width(df.schema)
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def fixed_width(kind: DataType) -> int | None:
    """Bytes that any value of a type takes in a row of Spark's, about; None where values differ."""
    if isinstance(kind, StructType):
        each = [fixed_width(f.dataType) for f in kind]
        return None if None in each else 8 + sum(each)
    return None if isinstance(kind, StringType | BinaryType | ArrayType | MapType) else 8


def value_bytes(value: Column, kind: DataType) -> Column:
    """Bytes that a value takes in a row of Spark's, about, as a long; 8 of a null."""
    width = fixed_width(kind)
    if width is not None:
        return F.lit(width).cast("bigint")
    if isinstance(kind, StructType):
        inner = sum((value_bytes(value[f.name], f.dataType) for f in kind), F.lit(0).cast("bigint"))
    elif isinstance(kind, ArrayType):
        width = fixed_width(kind.elementType)
        if width is not None:
            inner = F.array_size(value).cast("bigint") * width
        else:
            inner = F.aggregate(value, F.lit(0).cast("bigint"), lambda total, x: total + value_bytes(x, kind.elementType))
    elif isinstance(kind, MapType):
        inner = value_bytes(F.map_keys(value), ArrayType(kind.keyType)) + value_bytes(F.map_values(value), ArrayType(kind.valueType))
    else:
        inner = F.octet_length(value).cast("bigint")
    return F.coalesce(inner, F.lit(0).cast("bigint")) + 8


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch of whole texts can hold."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups, one after another, from the batches of a partition that is sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        changed = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy()
        changed[0] = bool(held) and (batch[keys].iloc[0] != held[-1][keys].iloc[-1]).any()
        begin = 0
        for at in changed.nonzero()[0]:
            if at > begin:
                held.append(batch.iloc[begin:at])
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
            held, begin = [], at
        held.append(batch.iloc[begin:])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows ``node, component`` (the smallest node reachable) for every node of ``edges`` (``a``, ``b`` long).

    Each round takes the least label among neighbours and then the label of that label, so chains halve;
    labels live in written tables, and whether a row changed is all that comes to the driver. A node with very many
    edges, or a label that very many nodes have, is a hot key of one side of a join: Spark splits it at run time.
    """
    both = written(
        edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct()
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("seen"))
        )
        met = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("next"))
        # the label of a label: it is a node itself, so the join loses nothing
        new = written(met.join(jump, "now").select("node", "was", F.least("now", "next").alias("component")))
        if new.where("was <> component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
