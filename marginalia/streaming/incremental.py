"""Incremental versions of the aggregates, exactly-once delivery, and checks of a stream's completeness."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from marginalia.operators.aggregates import total
from marginalia.scratch import new_folder
from marginalia.streaming import stateful


def folder(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of a table that is a file of ``sf_dir`` or a folder there."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{sf_dir}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_appending(stream: DataFrame, top: str) -> DataFrame:
    """Run to the end of what is there; every row is written once. Run again, it goes on where it stopped."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start(f"{top}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{top}/rows")


def run_complete(stream: DataFrame, top: str) -> DataFrame:
    """As ``run_appending`` for aggregates: the result after the last batch."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/rows")

    query = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{top}/rows")


def delivered_once(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rows without repeated deliveries; with an event time, state is kept only as long as a repeat may come late."""
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def distinct_per_key(stream: DataFrame, key: str, value) -> DataFrame:
    return stream.groupBy(key).agg(F.size(F.collect_set(value)).cast("bigint").alias("n_distinct"))


def sums_per_key(stream: DataFrame, key: str, value: str, scale: int | None = None) -> DataFrame:
    """``total`` and ``n`` of the values that aren't null, as the batch aggregate gives them."""
    return stream.groupBy(key).agg(total(F.col(value), scale).alias("total"), F.count(value).alias("n"))


#: Timestamps keep their microseconds in the bodies of waiting rows.
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def in_order(stream: DataFrame, sender: str, number: str, patience: str | None = None) -> DataFrame:
    """``stream`` with each sender's rows released in the order of their numbers, from 1 on, and each number once.

    A row whose number is above the next one waits in the state until the gap closes; a number that was released
    already is a repeat and goes. With ``patience`` (such as ``10 minutes``, processing time) a sender that was not
    heard of for so long has its waiting rows released past the gap. ``place`` long counts a sender's released rows;
    rows without a sender or a number, or numbered below 1, go. Append mode. Senders are dealt to buckets, each of which is one
    group of a batch; with ``patience`` each sender is a group of its own, as its time is its own.
    """
    others = [c for c in stream.columns if c not in (sender, number)]
    bodies = stream.where(F.col(sender).isNotNull() & (F.col(number) >= 1)).select(
        F.col(sender).cast("string").alias("sender"),
        F.col(number).cast("bigint").alias("number"),
        F.to_json(F.struct(sender, *others), _TIMES).alias("body"),
        (F.col(sender).cast("string") if patience else stateful.sender_bucket(F.col(sender))).alias("bucket"),
    )
    waits = GroupStateTimeout.ProcessingTimeTimeout if patience else GroupStateTimeout.NoTimeout
    millis = int(pd.Timedelta(patience).total_seconds() * 1000) if patience else 0

    def release(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        senders, afters, places, owners, numbers, texts = map(list, state.get) if state.exists else ([], [], [], [], [], [])
        known = {one: at for at, one in enumerate(senders)}
        held: dict[int, dict[int, str]] = {}
        for at, n, body in zip(owners, numbers, texts, strict=True):
            held.setdefault(at, {})[n] = body
        if not state.hasTimedOut:
            for batch in batches:
                for one, n, body in zip(batch["sender"].tolist(), batch["number"].tolist(), batch["body"].tolist(), strict=True):
                    at = known.setdefault(one, len(known))
                    if at == len(afters):
                        afters.append(1)
                        places.append(0)
                    if n >= afters[at]:
                        held.setdefault(at, {}).setdefault(n, body)
        out = []
        for at, mine in held.items():
            for n in sorted(mine):
                if n > afters[at] and not state.hasTimedOut:
                    break
                places[at] += 1
                out.append((n, places[at], mine.pop(n)))
                afters[at] = n + 1
        left = [(at, n, body) for at, mine in held.items() for n, body in mine.items()]
        state.update((list(known), afters, places, *([one[k] for one in left] for k in range(3))))
        if patience and left:
            state.setTimeoutDuration(millis)
        for at in range(0, len(out), stateful.ROWS):
            yield pd.DataFrame(out[at : at + stateful.ROWS], columns=["number", "place", "body"])

    waiting = "senders array<string>, afters array<bigint>, places array<bigint>, owners array<int>, numbers array<bigint>, bodies array<string>"
    released = bodies.groupBy("bucket").applyInPandasWithState(release, "number bigint, place bigint, body string", waiting, "append", waits)
    kept = stream.select(sender, *others).schema
    fields = F.from_json("body", kept, _TIMES)
    return released.select(*[F.col("number").alias(c) if c == number else fields[c].alias(c) for c in stream.columns], "place")


def sequence_gaps(df: DataFrame, sender: str, number: str) -> DataFrame:
    """``sender, after, missing``: places where numbers were skipped."""
    before = F.lag(number).over(Window.partitionBy(sender).orderBy(number))
    found = df.withColumn("after", before).where(F.col(number) - F.col("after") > 1)
    return found.select(sender, "after", (F.col(number) - F.col("after") - 1).alias("missing"))


def all_ended(df: DataFrame, keys: list[str], worker: str, ended, n: int) -> DataFrame:
    """Keys for which ``n`` different workers or more have said that they are at the end."""
    return df.where(ended).groupBy(*keys).agg(F.countDistinct(worker).alias("n_ended")).where(F.col("n_ended") >= n)


def silent(roster: DataFrame, seen: DataFrame, key: str, at: str, now, limit_seconds: int) -> DataFrame:
    """Members of the roster that were never seen or not for ``limit_seconds``."""
    last = seen.groupBy(key).agg(F.max(at).alias("last_seen"))
    gone = F.col("last_seen").isNull() | (F.unix_micros(now) - F.unix_micros(F.col("last_seen").cast("timestamp")) >= limit_seconds * 1_000_000)
    return roster.join(last, key, "left").where(gone)


def per_batch(stream: DataFrame, top: str, step: Callable[[DataFrame], None]) -> None:
    """Apply a batch function to each micro-batch."""
    stream.writeStream.foreachBatch(lambda df, _: step(df)).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
