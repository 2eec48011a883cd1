"""Streams with state equal their batch versions, whatever the order, repeats and restarts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.sources import files
from marginalia.streaming import incremental, stateful

MESSAGES = "session string, worker string, ended boolean, title string, score double"


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"file://{folder}")


def appended(spark, folder, top, schema, make):
    stream = files.incremental(spark, f"file://{folder}", schema)
    return incremental.run_appending(make(stream), f"file://{top}").collect()


def state_rows(spark, top, variable):
    return spark.read.format("statestore").option("path", f"file://{top}/state").option("stateVarName", variable).load().count()


@pytest.fixture
def few_buckets(monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 3)


def test_intervals():
    rnd = random.Random(1)
    for _ in range(200):
        seen, begins, ends = set(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _ in range(6):
            numbers = np.unique([rnd.randint(-5, 30) for _ in range(rnd.randint(1, 9))])
            new, begins, ends = stateful._merge(begins, ends, numbers)
            assert set(new.tolist()) == set(numbers.tolist()) - seen
            seen |= set(numbers.tolist())
            assert [x for a, b in zip(begins, ends, strict=True) for x in range(a, b)] == sorted(seen)
            assert all(begins[1:] > ends[:-1])


def test_once_by_sender_over_disorder_repeats_and_restarts(spark, tmp_path):
    rnd = random.Random(3)
    sent = [(s, n, f"{s}{n}") for s in ("a", "b", "c") for n in range(-3, 60)]
    parts = [rnd.sample(sent, 120) for _ in range(3)] + [sent]
    got = []
    for part in parts:
        put(spark, tmp_path / "in", [*part, *part[:20], (None, 1, "x"), ("a", None, "y")], "s string, n long, v string")
        got = appended(spark, tmp_path / "in", tmp_path / "run", "s string, n long, v string", lambda d: stateful.once_by_sender(d, "s", "n"))
    assert sorted(map(tuple, got)) == sorted(sent)


def test_a_million_ordered_messages_leave_one_interval(spark, tmp_path):
    for k in range(2):
        spark.range(k * 500_000, (k + 1) * 500_000).select(F.lit("a").alias("s"), F.col("id").alias("n")).coalesce(2).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = files.incremental(spark, f"file://{tmp_path}/in", "s string, n long", "parquet", 2)
    assert incremental.run_appending(stateful.once_by_sender(stream, "s", "n"), f"file://{tmp_path}/run").count() == 1_000_000
    state = spark.read.format("statestore").load(f"file://{tmp_path}/run/state").select("value.*").collect()
    assert len(state) == 1 and "999999" not in str(state) and "[1000000]" in str(state[0]).replace("List", "")


def batch_sums(rows):
    out = {}
    for s, _, ended, title, score in rows:
        if not ended and title is not None:
            total, n = out.get((s, title), (None, 0))
            out[s, title] = ((total or 0.0) + score, n + 1) if score is not None else (total, n)
    return sorted((s, t, total, n) for (s, t), (total, n) in out.items())


def test_sessions_answer_when_their_workers_have_ended(spark, tmp_path, few_buckets):
    rnd = random.Random(4)
    rows = [(s, w, False, rnd.choice([*"pqrstu", None]), rnd.choice([1.5, 2.0, None])) for s in ("x", "y") for w in ("1", "2", "3") for _ in range(20)]
    ends = [(s, w, True, None, None) for s in ("x", "y") for w in ("1", "2", "3")]
    run = lambda: sorted(map(tuple, appended(spark, tmp_path / "in", tmp_path / "run", MESSAGES, lambda d: stateful.sums_of_ended_sessions(d, 3))))
    put(spark, tmp_path / "in", rows[:70] + ends[:2], MESSAGES)
    assert run() == []
    put(spark, tmp_path / "in", [*rows[70:110], ends[0], ends[1], ends[3]], MESSAGES)  # repeated ends, and another session's
    assert run() == []
    put(spark, tmp_path / "in", [ends[2], *rows[110:], ("z", "1", True, None, None)], MESSAGES)  # the end stands before rows of its batch
    assert run() == [r for r in batch_sums(rows) if r[0] == "x"]
    put(spark, tmp_path / "in", [ends[5], ends[4]], MESSAGES)
    assert run() == batch_sums(rows)
    assert state_rows(spark, tmp_path / "run", "sums") == 0
    assert state_rows(spark, tmp_path / "run", "ended") == 3  # session z has not ended, in each bucket


ITEMS = "session string, sender string, ended boolean, title string, row_id long, name string"
REVIEWS = "session string, sender string, ended boolean, title string, score double"


@pytest.mark.parametrize("seed", [1, 2])
def test_join_while_items_arrive(spark, tmp_path, few_buckets, seed):
    rnd = random.Random(seed)
    items = [(s, rnd.choice("ab"), False, rnd.choice("pqrst"), k, f"{s}{k}") for s in ("x", "y") for k in range(14)]
    items += [("x", "a", False, None, 99, "no title")]
    reviews = [(s, "r", False, rnd.choice([*"pqrstuv", None]), float(k)) for s in ("x", "y") for k in range(40)]
    last = {}
    for s, _, _, t, k, name in items:
        if t is not None and last.get((s, t), (-1,))[0] <= k:
            last[s, t] = (k, name)
    want = sorted((s, t, *last[s, t], score) for s, _, _, t, score in reviews if (s, t) in last)
    rnd.shuffle(items)
    rnd.shuffle(reviews)
    parts = [(items[:9], reviews[:30]), (items[9:20], []), ([*items[20:], ("x", "a", True, None, None, None)], reviews[30:50])]
    parts += [([(s, w, True, None, None, None) for s in ("x", "y") for w in ("a", "b")], reviews[50:60]), ([], [*reviews[60:], ("x", "r", True, None, None)]), ([], [("y", "r", True, None, None)])]
    got = []
    for mine, theirs in parts:
        put(spark, tmp_path / "items", mine, ITEMS)
        put(spark, tmp_path / "reviews", theirs, REVIEWS)
        streams = [files.incremental(spark, f"file://{tmp_path}/{n}", s) for n, s in (("items", ITEMS), ("reviews", REVIEWS))]
        got = incremental.run_appending(stateful.joined_when_built(*streams, "title", "row_id", 2), f"file://{tmp_path}/run").collect()
    assert sorted((r["session"], r["title"], r["row_id"], r["name"], r["score"]) for r in got) == want
    assert [state_rows(spark, tmp_path / "run", v) for v in ("items", "waiting", "ended")] == [0, 0, 0]


def test_silence_equals_a_replay(spark, tmp_path):
    parts = [[("a", 0), ("b", 0)], [("b", 25), ("a", 20), ("a", 10)], [("a", 60), ("b", 27), ("a", 60)], [("c", 90)], [("b", 93), ("c", 300), (None, 5)], [("d", 301)]]
    got = []
    for part in parts:
        put(spark, tmp_path / "in", [(m, t + 1000) for m, t in part], "m string, t long")
        got = appended(spark, tmp_path / "in", tmp_path / "run", "m string, t long", lambda d: stateful.silence_alarms(d.select("m", F.timestamp_seconds("t").alias("at")), "m", "at", 15))
    want = []
    for member in "abcd":
        signs = sorted({t for part in parts for m, t in part if m == member})
        for t, after in zip(signs, [*signs[1:], None], strict=True):
            if (after or 301) - t >= 15:
                want += [(member, t, True)] + ([(member, after, False)] if after else [])
    assert sorted((r["member"], int(r["at"].timestamp()) - 1000, r["silent"]) for r in got) == sorted(want)


@pytest.mark.parametrize(("function", "want"), [(max, {"a": 9, "b": 4}), (lambda x, y: x + y, {"a": 15, "b": 4})])
def test_values_merged_so_far(spark, tmp_path, function, want):
    for rows in ([("a", 5), ("b", 4), ("a", None)], [("a", 9)], [("a", 1)]):
        put(spark, tmp_path / "in", rows, "k string, v long")
    stream = files.incremental(spark, f"file://{tmp_path}/in", "k string, v long")
    seen = {}
    merged = stateful.merged_so_far(stream, "k", "v", function)
    query = merged.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({r["k"]: r["v"] for r in df.collect()}))
    query.option("checkpointLocation", f"file://{tmp_path}/run").trigger(availableNow=True).start().awaitTermination()
    assert seen == want
