"""Streams with state of their own: delivery by senders' numbers, sessions that answer when their inputs end, joins whose
build side is still arriving, silence, and values merged by any function.

State is kept for a session and a bucket of its keys, so that one session's rows are dealt to many tasks; what says that an
input has ended goes to all buckets of its session. The stateful processors need Spark's RocksDB state store, which
``use_rocksdb`` chooses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Buckets of a session's keys; numbers of a sender that are one entry of state, as a power of two; rows emitted at once.
BUCKETS, NUMBER_BITS, ROWS = 32, 20, 4096
#: Buckets of senders: each is one group of a batch, however many senders there are.
SENDER_BUCKETS = 2048
#: Keys whose values a task holds before it passes them on to the state.
HELD_KEYS = 100_000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB; queries of the session that start from now on do."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


# --- delivery


def _merge(begins: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the ascending numbers the intervals (ends excluded) lack, and the intervals with them."""
    at = np.searchsorted(begins, numbers, side="right") - 1
    new = numbers[(at < 0) | (numbers >= np.append(ends, 0)[at])]
    all_begins, all_ends = np.concatenate([begins, new]), np.concatenate([ends, new + 1])
    order = np.argsort(all_begins, kind="stable")
    all_begins, all_ends = all_begins[order], all_ends[order]
    first = np.ones(len(order), bool)
    first[1:] = all_begins[1:] > all_ends[:-1]
    last = np.append(first[1:], True) if len(first) else first
    return new, all_begins[first], all_ends[last]


def sender_bucket(sender: Column) -> Column:
    return F.pmod(F.xxhash64(sender.cast("string")), F.lit(SENDER_BUCKETS)).cast("int")


def once_by_sender(stream: DataFrame, sender: str, number: str) -> DataFrame:
    """Rows of ``stream`` without those whose sender sent their number before. Append mode.

    State is the numbers seen as intervals, so senders whose numbers come about in order leave one interval for each 2^20
    numbers, and each gap that is still open adds one. Senders are dealt to buckets, whose intervals are merged at once, as a
    step of Python a sender and batch would take longer than its rows. Rows without a sender or a number go, as nothing tells whether they
    are repeats; numbers may be any, in any order, and come again at any time. Of rows with one number any one is kept.
    """
    columns = stream.columns
    keyed = stream.where(F.col(sender).isNotNull() & F.col(number).isNotNull()).select(
        F.struct(*columns).alias("row"), F.col(sender).cast("string").alias("sender"), sender_bucket(F.col(sender)).alias("bucket"),
        F.shiftright(F.col(number).cast("bigint"), NUMBER_BITS).alias("block"), F.col(number).cast("bigint").alias("number"),
    )
    width = 1 << NUMBER_BITS

    def new_ones(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        senders, begins, ends = state.get if state.exists else ([], [], [])
        places = {one: at for at, one in enumerate(senders)}
        begins, ends = np.array(begins, np.int64), np.array(ends, np.int64)
        for batch in batches:
            # a sender's numbers in the block lie 2 * width after those of the sender before, so that no two intervals touch
            codes, found = pd.factorize(batch["sender"])
            known = np.array([places.setdefault(one, len(places)) for one in found], np.int64)
            numbers, first = np.unique(known[codes] * (2 * width) + (batch["number"].to_numpy(np.int64) & (width - 1)), return_index=True)
            new, begins, ends = _merge(begins, ends, numbers)
            yield batch.iloc[np.sort(first[np.isin(numbers, new)])][["row"]]
        state.update((list(places), begins.tolist(), ends.tolist()))

    once = keyed.groupBy("bucket", "block").applyInPandasWithState(
        new_ones, keyed.select("row").schema, "senders array<string>, begins array<bigint>, ends array<bigint>", "append", GroupStateTimeout.NoTimeout
    )
    return once.select("row.*")


# --- sessions


def _dealt(messages: DataFrame, key: Column, ended: Column) -> DataFrame:
    """``messages`` with a ``bucket`` by the key; those that say that an input has ended are in all buckets."""
    every = F.sequence(F.lit(0), F.lit(BUCKETS - 1))
    mine = F.array(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    return messages.withColumn("bucket", F.explode(F.when(ended, every).otherwise(mine)))


class _Sums(StatefulProcessor):
    """Sums and counts by title until all workers have ended; then they are given out and forgotten."""

    def __init__(self, workers: int) -> None:
        self.workers = workers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getMapState("sums", "title string", "total double, n bigint, seen bigint")
        self.ended = handle.getMapState("ended", "worker string", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ends: set[str] = set()
        held: dict[str, tuple] = {}
        for batch in rows:
            said = batch["ended"].fillna(False).astype(bool)
            ends.update(batch.loc[said, "worker"].dropna().tolist())
            here = batch[~said & batch["title"].notna()].groupby("title", sort=False)["score"].agg(["sum", "count", "size"])
            for title, total, n, seen in here.itertuples():
                old = held.get(title, (0.0, 0, 0))
                held[title] = (old[0] + float(total), old[1] + int(n), old[2] + int(seen))
            if len(held) > HELD_KEYS:
                self._add(held)
                held = {}
        self._add(held)
        for worker in ends:
            self.ended.updateValue((worker,), (1,))
        if ends and sum(1 for _ in self.ended.keys()) >= self.workers:
            out = []
            for (title,), (total, n, _) in self.sums.iterator():
                out.append((key[0], title, total if n else None, n))
                if len(out) == ROWS:
                    yield _frame(out, ["session", "title", "total", "n"])
                    out = []
            yield _frame(out, ["session", "title", "total", "n"])
            self.sums.clear()
            self.ended.clear()

    def _add(self, held: dict[str, tuple]) -> None:
        """One access of the state a title, however many batches of rows a title comes in."""
        for title, (total, n, seen) in held.items():
            old = self.sums.getValue((title,)) or (0.0, 0, 0)
            self.sums.updateValue((title,), (old[0] + total, old[1] + n, old[2] + seen))

    def close(self) -> None:
        pass


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def sums_of_ended_sessions(messages: DataFrame, workers: int) -> DataFrame:
    """``session, title, total, n`` of the scores of each title, once ``workers`` different workers of its session have ended.

    ``messages`` are ``session, worker, ended, title, score``; one with ``ended`` carries no title. A session's rows come in
    the batch in which its last worker ends, all at once, and its state is gone then. Ends may come in any order, more than
    once, and in the middle of other workers' rows; the rows of a batch count before its ends. A row that comes after its
    session's end begins the session anew, so repeated deliveries belong into ``once_by_sender`` first. Null scores count
    in no sum, null titles not at all. Append mode.
    """
    use_rocksdb(messages.sparkSession)
    plain = messages.select(
        F.col("session").cast("string").alias("session"), F.col("worker").cast("string").alias("worker"), F.coalesce("ended", F.lit(False)).alias("ended"),
        "title", F.col("score").cast("double").alias("score"),
    )
    dealt = _dealt(plain, F.col("title"), F.col("ended"))
    return dealt.groupBy("session", "bucket").transformWithStateInPandas(_Sums(workers), "session string, title string, total double, n bigint", "Append", "None")


_WAITING = pa.schema([("key", pa.string()), ("body", pa.string())])


def _packed(reviews: pd.DataFrame) -> bytes:
    """Rows as one value of the state, in Arrow's format."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _WAITING, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_pandas(reviews, _WAITING, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(pa.py_buffer(bytes(rows))) as found:
        return found.read_pandas()


class _Join(StatefulProcessor):
    """Reviews wait until the items are complete, then meet the last item of their key. They wait in chunks of up to ROWS, each
    an entry of its own: the state is asked for chunks, not for rows, and none grows with a session."""

    def __init__(self, item_ends: int, review_ends: int) -> None:
        self.needed = (item_ends, review_ends)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "key string", "place bigint, body string")
        self.waiting = handle.getMapState("waiting", "chunk bigint", "rows binary")
        self.chunks = handle.getValueState("chunks", "n bigint")
        self.ended = handle.getMapState("ended", "side int, sender string", "at bigint")

    def _ends(self) -> list[bool]:
        seen = [0, 0]
        for side, _ in self.ended.keys():
            seen[side] += 1
        return [n >= need for n, need in zip(seen, self.needed, strict=True)]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        built_before = self._ends()[0]
        known: dict[str, str | None] = {}
        newest: dict[str, tuple] = {}
        chunks = first = self.chunks.get()[0] if self.chunks.exists() else 0
        for batch in rows:
            said = batch["ended"].astype(bool)
            for side, sender in set(batch.loc[said, ["side", "sender"]].dropna().itertuples(index=False, name=None)):
                self.ended.updateValue((int(side), sender), (1,))
            data = batch[~said & batch["key"].notna()]
            items = data[data["side"] == 0].sort_values("place").drop_duplicates("key", keep="last")
            for k, place, body in items[["key", "place", "body"]].itertuples(index=False, name=None):
                if k not in newest or newest[k][0] <= place:
                    newest[k] = (int(place), body)
            reviews = data.loc[data["side"] == 1, ["key", "body"]]
            if len(newest) > HELD_KEYS or (built_before and len(reviews)):
                self._put(newest)
                newest = {}
            if built_before:
                yield self._meet(key, reviews, known)
                continue
            for at in range(0, len(reviews), ROWS):
                self.waiting.updateValue((chunks,), (_packed(reviews[at : at + ROWS]),))
                chunks += 1
        self._put(newest)
        built, over = self._ends()
        if built and not built_before:
            for chunk in range(chunks):
                yield self._meet(key, _unpacked(self.waiting.getValue((chunk,))[0]), known)
            self.waiting.clear()
            self.chunks.clear()
        elif chunks > first:
            self.chunks.update((chunks,))
        if built and over:
            self.items.clear()
            self.ended.clear()

    def _put(self, newest: dict[str, tuple]) -> None:
        for k, (place, body) in newest.items():
            old = self.items.getValue((k,))
            if old is None or old[0] <= place:
                self.items.updateValue((k,), (place, body))

    def _meet(self, key: Any, reviews: pd.DataFrame, known: dict[str, str | None]) -> pd.DataFrame:
        for k in reviews["key"].unique():
            if k not in known:
                item = self.items.getValue((k,))
                known[k] = item[1] if item else None
        met = reviews[reviews["key"].isin([k for k, item in known.items() if item is not None])]
        items = [known[k] for k in met["key"]]
        return pd.DataFrame({"session": [key[0]] * len(met), "key": met["key"].tolist(), "item": items, "review": met["body"].tolist()}, dtype=object)

    def close(self) -> None:
        pass


def joined_when_built(items: DataFrame, reviews: DataFrame, key: str, place: str, item_ends: int, review_ends: int = 1) -> DataFrame:
    """Reviews with the last item (by ``place``) of their ``key``, in streams that both are still arriving.

    Both have ``session, sender, ended`` and ``key``; a row with ``ended`` carries nothing else. A session's reviews wait
    until ``item_ends`` senders of items have ended, then all meet the items, those that come later at once; when
    ``review_ends`` senders of reviews have ended too, the session's state goes. So any interleaving gives the batch's inner
    join with the items' last rows. Rows without a key have no partner. A column that both sides have under one name, but for
    session and key, is the review's. Append mode.
    """
    use_rocksdb(items.sparkSession)
    common = ("session", "sender", "ended", key)
    of_review = [c for c in reviews.columns if c not in common]
    of_item = [c for c in items.columns if c not in common and c not in of_review]

    def envelope(df: DataFrame, side: int, order: Column, fields: list[str]) -> DataFrame:
        return df.select(
            F.lit(side).alias("side"), F.col("session").cast("string").alias("session"), F.col("sender").cast("string").alias("sender"),
            F.coalesce("ended", F.lit(False)).alias("ended"), F.col(key).cast("string").alias("key"), order.cast("bigint").alias("place"),
            F.to_json(F.struct(*fields) if fields else F.struct(F.lit(1).alias("none"))).alias("body"),
        )

    both = envelope(items, 0, F.col(place), of_item).unionByName(envelope(reviews, 1, F.lit(0), of_review))
    dealt = _dealt(both, F.col("key"), F.col("ended"))
    met = dealt.groupBy("session", "bucket").transformWithStateInPandas(
        _Join(item_ends, review_ends), "session string, key string, item string, review string", "Append", "None"
    )
    fields = [
        F.from_json(body, df.select(*names).schema)[c].alias(c) for body, df, names in (("item", items, of_item), ("review", reviews, of_review)) if names for c in names
    ]
    return met.select("session", F.col("key").cast(items.schema[key].dataType).alias(key), *fields)


# --- silence


class _Silence(StatefulProcessor):
    def __init__(self, limit_ms: int) -> None:
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, silent boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, silent = self.last.get() if self.last.exists() else (None, False)
        out = []
        for batch in rows:
            for at in sorted(set(batch["at"].tolist())):
                if last is not None and at <= last:
                    continue
                if last is not None and not silent and at - last >= self.limit:
                    out.append((key[0], last, True))
                    silent = True
                if silent:
                    out.append((key[0], at, False))
                last, silent = int(at), False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((last, silent))
        if not silent:
            self.handle.registerTimer(last + self.limit)
        yield _frame(out, ["member", "at", "silent"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last, _ = self.last.get()
        self.last.update((last, True))
        yield _frame([(key[0], last, True)], ["member", "at", "silent"])

    def close(self) -> None:
        pass


def silence_alarms(signs: DataFrame, member: str, at: str, limit_seconds: float, delay: str = "0 seconds") -> DataFrame:
    """``member, at, silent``: once when nothing was heard of a member for the limit (``at`` is its last sign), and once, with
    ``silent`` false, when it is heard of again (``at`` is that sign).

    Time is that of the signs: an alarm comes when the watermark passes ``limit_seconds`` beyond a member's last sign, or with
    the next sign if that is sooner. A batch's signs are taken in order of time; one that is not newer than its member's last
    changes nothing; rows without a member or a time go. Append mode.
    """
    use_rocksdb(signs.sparkSession)
    timed = signs.where(F.col(member).isNotNull() & F.col(at).isNotNull()).select(F.col(member).cast("string").alias("member"), F.col(at).cast("timestamp").alias("ts"))
    timed = timed.withWatermark("ts", delay).withColumn("at", F.unix_millis("ts"))
    alarms = timed.groupBy("member").transformWithStateInPandas(_Silence(int(limit_seconds * 1000)), "member string, at bigint, silent boolean", "Append", "eventTime")
    return alarms.select("member", F.timestamp_millis("at").alias("at"), "silent")


# --- merging


def merged_so_far(stream: DataFrame, key: str, value: str, function: Callable[[Any, Any], Any]) -> DataFrame:
    """``key, value``: the values of each key so far, merged by an associative and commutative function. Update mode.

    A key comes out again in each batch that has values of it. Nulls are passed over.
    """
    schema = stream.select(value).schema
    present = stream.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.col(value).alias("value"))

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        so_far = state.get[0] if state.exists else None
        for batch in batches:
            for one in batch["value"].tolist():
                so_far = one if so_far is None else function(so_far, one)
        state.update((so_far,))
        yield pd.DataFrame({"key": [keys[0]], "value": [so_far]})

    out = present.select("key", "value").schema
    merged = present.groupBy("key").applyInPandasWithState(fold, out, schema, "update", GroupStateTimeout.NoTimeout)
    return merged.select(F.col("key").alias(key), F.col("value").alias(value))
