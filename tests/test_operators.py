"""Nulls, ties, hot values, jobs over files, and streams whose messages come late, twice or out of order."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia import scratch
from marginalia.operators import aggregates, filters, joins, text
from marginalia.plans import jobs
from marginalia.sources import files
from marginalia.streaming import incremental


def test_averages_count_values_and_round_nothing(spark):
    rows = [("a", 4.0), ("a", None), ("b", 0.004), ("b", 0.004), ("b", 4.333), ("c", None), ("d", 1e17), ("e", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["average"], r["n"]) for r in aggregates.average(df, "v", "k").collect()}
    assert got["a"] == (4.0, 1) and got["c"] == (None, 0) and got["d"] == (1e17, 1)
    assert got["b"][0] == pytest.approx(1.447, abs=1e-12) and got["e"][0] != got["e"][0]
    exact = {r["k"]: r["average"] for r in aggregates.average(df.where("k IN ('a', 'b', 'c')"), "v", "k", scale=3).collect()}
    assert exact == {"a": 4.0, "b": pytest.approx(1.447, abs=1e-15), "c": None}


@pytest.mark.parametrize("values", [lambda k: 1e12 if k == 77 else float(k % 50), lambda k: 1.0, lambda k: None if k % 2 else float(k)])
def test_top_fraction_ranks_a_range_alone(spark, values, monkeypatch):
    rows = [(k, values(k)) for k in range(4000)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(5)
    with_values = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[0]))
    dealt = []
    monkeypatch.setattr(aggregates, "written", lambda rows: dealt.append(scratch.written(rows)) or dealt[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = aggregates.top_fraction(df, "v", "id", 90)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got.collect())) == sorted(with_values[: len(with_values) // 10])
    # a window ranks one range at most
    assert dealt[0].groupBy("part").count().agg(F.max("count")).first()[0] < 0.6 * len(with_values)


def test_many_first_rows_go_through_no_single_task(spark, monkeypatch):
    rows = [(k, None if k % 9 == 0 else (k * 37) % 500, k % 5) for k in range(4000)]
    df = spark.createDataFrame(rows, "id long, v long, part long").repartition(5)
    first = lambda r: (r[1] is not None, r[1] or 0, r[0])
    best = lambda r: (r[1] is None, -(r[1] or 0), r[0])
    monkeypatch.setattr(aggregates, "FEW_ROWS", 100)
    for n in (100, 101, 1500, 3999, 4000, 9000):
        assert sorted(aggregates.head(df, n, "v", "id").collect(), key=first) == sorted(rows, key=first)[:n]
        assert sorted(aggregates.top_n(df, "v", "id", n).collect(), key=best) == sorted(rows, key=best)[:n]
    assert aggregates.head(df.limit(0), 200, "id").count() == 0
    found = aggregates.head(df, 1500, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == df.columns and "Limit" not in plan and "TakeOrdered" not in plan


def test_one_row_a_key(spark):
    rows = [(k, "" if k % 3 else f"t{k % 7}", [str(k)]) for k in range(300)] + [(400, None, ["x"])]
    df = spark.createDataFrame(rows, "row_id long, title string, authors array<string>").repartition(4)
    want = {t: r for r, t, _ in sorted(rows, key=lambda r: r[0])}
    last = joins.keep_last(df, "row_id", "title")
    assert {r["title"]: r["row_id"] for r in last.collect()} == want and last.columns == df.columns
    first = {r["title"]: r["row_id"] for r in joins.keep_first(df, ("row_id",), "title").collect()}
    assert first == {t: r for r, t, _ in sorted(rows, key=lambda r: -r[0])}
    assert "Window" not in last._jdf.queryExecution().executedPlan().toString()


def plain_polarity(line, lexicon, negations=()):
    import re

    each = [w for w in re.split("[^a-z]+", (line or "").lower()) if w]
    hits = [lexicon[w] * (-0.5 if i and each[i - 1] in negations else 1) for i, w in enumerate(each) if w in lexicon]
    return sum(hits) / len(hits) if hits else 0.0


def test_polarity_by_table_and_by_join(spark, monkeypatch):
    rnd = random.Random(2)
    lexicon = {f"w{chr(97 + k % 26)}{chr(97 + k // 26)}": rnd.randint(-8, 8) / 8 for k in range(400)}
    known = [*lexicon, "not", "other", "Never"]
    rows = [(k, " ".join(rnd.choice(known) for _ in range(rnd.randint(0, 60)))) for k in range(200)] + [(500, None), (501, ""), (502, "!?"), (503, " not waa, never not wba!"), (504, "?waa not")]
    df = spark.createDataFrame(rows, "id long, t string")
    words = spark.createDataFrame([*lexicon.items(), (None, 1.0), ("none", None), ("", 1.0)], "word string, polarity double")
    for negations in ([], ["not", "never"], ["", "not", "never"]):
        want = {k: plain_polarity(t, lexicon, negations) for k, t in rows}
        for most in (50_000, 10):
            monkeypatch.setattr(text, "TABLE_WORDS", most)
            got = {r["id"]: r["sentiment"] for r in text.polarity(df, words, "t", "id", negations).collect()}
            assert got == pytest.approx(want)
    monkeypatch.setattr(text, "TABLE_WORDS", 50_000)
    assert {r["sentiment"] for r in text.polarity(df, words.limit(0), "t", "id").collect()} == {0.0}


def test_jobs_over_files(spark, tmp_path):
    books = ["Title,authors,publishedDate,categories"]
    books += [f"Distributed {k},\"['Ann', 'B{k}']\",{1900 + 10 * k},['Computers & Fiction']" for k in range(12)] + ["Odd,['X'],long ago,['Poetry']"]
    reviews = ["Title,review/score,review/text"] + [f"Distributed {k},{'bad' if j == 0 else k % 5},{'good' if k > 6 else 'poor'} book" for k in range(12) for j in range(6)]
    for k, lines in enumerate((books[:7], [books[0], *books[7:]])):
        (tmp_path / "books").mkdir(exist_ok=True)
        (tmp_path / "books" / f"{k}.csv").write_text("\n".join(lines))
    (tmp_path / "reviews.csv").write_text("\n".join(reviews))
    top = f"file://{tmp_path}"
    assert jobs.ingest(spark, f"{top}/books", f"{top}/reviews.csv", f"{top}/in") == {"books": 13, "bad_year": 1, "reviews": 72, "bad_score": 12}
    found, _ = jobs.tables(spark, f"{top}/in")
    assert found.select("row_id").distinct().count() == 13 and {r["publisher"] for r in found.collect()} == {""}
    lexicon = spark.createDataFrame([("good", 1.0), ("poor", -1.0)], "word string, polarity double")
    counts = {r["query"]: r["n"] for r in jobs.run(spark, f"{top}/in", f"{top}/out", lexicon, min_reviews=5).collect()}
    assert counts == {"q1": 2, "q2": 1, "q3": 1, "q4": 1, "q5": 1}
    assert [r["title"] for r in files.golden_titles(spark, f"{top}/out/query=3").collect()] == ["Distributed 9"]
    assert {r["title"] for r in jobs.expected_titles(spark, f"{top}/out/query=1", f"{top}/out/query=3").collect()} == {"Distributed 9"} | {f"Distributed {k}" for k in (10, 11)}
    assert jobs.check(spark, f"{top}/out/query=4", f"{top}/out/query=4").count() == 0
    (tmp_path / "golden.txt").write_text('"Ann"\n"Bob ""B"""\n')
    assert [r["author"] for r in files.golden_names(spark, f"{top}/golden.txt").collect()] == ["Ann", 'Bob ""B']
    assert sorted(r["side"] for r in jobs.check(spark, f"{top}/out/query=2", f"{top}/golden.txt").collect()) == ["+", "-", "-"]


def sent(spark, folder, rows):
    spark.createDataFrame(rows, "s string, n long, v double").coalesce(1).write.mode("append").json(f"file://{folder}")


def test_release_in_order_over_restarts(spark, tmp_path):
    source, top = f"{tmp_path}/in", f"file://{tmp_path}/run"

    def released():
        stream = files.incremental(spark, f"file://{source}", "s string, n long, v double")
        got = {}
        for r in incremental.run_appending(incremental.in_order(stream, "s", "n"), top).orderBy("place").collect():
            got.setdefault(r["s"], []).append((r["n"], r["place"], r["v"]))
        return got

    sent(spark, source, [("a", 3, 0.5), ("a", 1, 1.5), ("b", 2, 9.0), ("a", 1, 7.0), (None, 1, 0.0), ("a", None, 0.0), ("a", 0, 0.0)])
    assert released() == {"a": [(1, 1, 1.5)]}
    sent(spark, source, [("a", 5, 2.5), ("a", 2, None), ("a", 3, 8.0)])  # closes the gap, repeats 3
    assert released() == {"a": [(1, 1, 1.5), (2, 2, None), (3, 3, 0.5)]}
    sent(spark, source, [("b", 1, 3.0), ("a", 4, 4.0), ("a", 2, 6.0)])  # a repeat after its release
    assert released() == {"a": [(1, 1, 1.5), (2, 2, None), (3, 3, 0.5), (4, 4, 4.0), (5, 5, 2.5)], "b": [(1, 1, 3.0), (2, 2, 9.0)]}


def test_repeats_after_a_restart(spark, tmp_path):
    source, top = f"{tmp_path}/in", f"file://{tmp_path}/run"

    def rows():
        stream = files.incremental(spark, f"file://{source}", "s string, n long, v double")
        return sorted((r["s"], r["n"]) for r in incremental.run_appending(incremental.delivered_once(stream, ["s", "n"]), top).collect())

    sent(spark, source, [("a", 1, 1.0), ("a", 2, 1.0), ("a", 1, 1.0)])
    assert rows() == [("a", 1), ("a", 2)]
    sent(spark, source, [("a", 2, 1.0), ("b", 1, 1.0), ("a", 3, 1.0)])
    assert rows() == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_each_batch_and_late_workers(spark, tmp_path):
    source, seen = f"{tmp_path}/in", []
    sent(spark, source, [("a", 1, 1.0)])
    sent(spark, source, [("b", 1, 1.0), ("b", 2, 1.0)])
    stream = files.incremental(spark, f"file://{source}", "s string, n long, v double")
    incremental.per_batch(stream, f"file://{tmp_path}/run", lambda df: seen.append(df.count()))
    assert sorted(seen) == [1, 2]
    ends = spark.createDataFrame([("q", w) for w in "abc"] + [("r", "a")], "k string, w string")
    assert [tuple(r) for r in incremental.all_ended(ends, ["k"], "w", F.lit(True), 2).collect()] == [("q", 3)]


def test_a_cluster_must_name_the_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app-1"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session())


def test_last_rows_by_id_take_no_sort(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("title"), F.array(F.col("id").cast("string")).alias("authors"))
    for one in (joins.keep_last(df, "row_id", "title"), joins.keep_first(df, ("row_id",), "title")):
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and one.count() == 7


def test_overlap_with_small_and_large_sets(spark, monkeypatch):
    rows = [(1, ["a", "b"]), (2, ["c"]), (3, []), (4, None), (5, [None, "a"]), (6, ["z", "z"])]
    df = spark.createDataFrame(rows, "id long, words array<string>")
    wanted = spark.createDataFrame([("a",), ("z",), ("z",), (None,)], "w string")
    for most, shuffles in ((1000, 0), (1, 1)):
        monkeypatch.setattr(filters, "SMALL_SET", most)
        found = filters.overlaps(df, "words", wanted, "id")
        assert sorted(r["id"] for r in found.collect()) == [1, 5, 6]
        assert ("Join" in found._jdf.queryExecution().executedPlan().toString()) == bool(shuffles)
    assert filters.overlaps(df, "words", wanted.limit(0), "id").count() == 0


def test_bloom_filter_loses_nothing_and_lets_little_through(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("id", "array(concat('a', id % 700), concat('b', id), NULL) AS words")
    wanted = spark.range(0, 200_000, 37).selectExpr("concat('b', id) AS w").union(spark.createDataFrame([(None,)], "w string"))
    each = df.select(F.explode("words").alias("e"))
    passed = each.where(filters.bloom(wanted.where("w IS NOT NULL"))(F.col("e")))
    assert 541 <= passed.count() < 1000  # of 40,000, of which 541 are wanted
    found = filters.overlaps(df, "words", wanted, "id")
    assert {r["id"] for r in found.collect()} == set(range(0, 20_000, 37))
    assert "subquery#" in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(filters, "BLOOM_WORDS", 3)  # far too few: more rows pass, the result is the same
    assert filters.overlaps(df, "words", wanted, "id").count() == 541


def _hot_reviews(spark):
    title = "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 97 = 0 THEN NULL ELSE concat('t', id % 900) END AS title"
    return spark.range(100_000).selectExpr("id", title, "id % 5 AS part", "id % 3 AS key_hash", "id % 7 AS parts")


def _hot_items(spark):
    return spark.range(1000).selectExpr("concat('t', id) AS title", "id AS item").union(spark.createDataFrame([("hot", -1), ("hot", -2), (None, -3)], "title string, item long"))


@pytest.mark.parametrize("hint", [None, "shuffle_hash"])
def test_a_hot_title_is_split(spark, hint):
    reviews, items = _hot_reviews(spark), _hot_items(spark)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = joins.with_items_split(reviews, items, "title", spread=("id",), hint=hint)
        want = reviews.join(items, "title")
        assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).count() == 0
        sizes, plain = (sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()) for df in (got, want))
        assert sizes[-1] < 2 * sizes[len(sizes) // 2] and plain[-1] > 10 * plain[len(plain) // 2]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hot_keys_of_a_history_split_a_stream(spark, tmp_path):
    reviews, items = _hot_reviews(spark), _hot_items(spark)
    hot = scratch.written(joins.hot_keys(reviews, "title"))
    assert hot.count() == 1 and hot.first()["parts"] > 1
    reviews.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(reviews.schema).parquet(f"{tmp_path}/in")
    out = joins.with_items_split(stream, items, "title", hot=hot)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    want = reviews.join(items, "title")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == want.count() and got.select(want.columns).exceptAll(want).count() == 0


def test_split_join_of_odd_tables(spark):
    reviews, items = _hot_reviews(spark), _hot_items(spark)
    for a, b in ((reviews.limit(0), items), (reviews, items.limit(0)), (reviews.where("title IS NULL"), items)):
        assert joins.with_items_split(a, b, "title").count() == 0
    same = reviews.select(F.lit("hot").alias("title"))  # equal rows stay together, and none is lost
    assert joins.with_items_split(same, items, "title").count() == 200_000


def test_hash_tables_only_where_they_fit(spark, monkeypatch):
    reviews, items = _hot_reviews(spark), _hot_items(spark)
    for most, kind in ((1_000_000, "ShuffledHashJoin"), (10, "SortMergeJoin")):
        monkeypatch.setattr(joins, "HASH_ROWS", most)
        assert kind in joins.shuffled(reviews, items, "title")._jdf.queryExecution().executedPlan().toString()


def test_names_of_the_caller_are_left_alone(spark):
    df = spark.createDataFrame([(k, float(k), k * 10, k % 2) for k in range(40)], "id long, v double, _range long, place long").withColumns({"row": F.col("id"), "part": F.lit("p")})
    top = aggregates.top_fraction(df, "v", "id", 90, by=("place",))
    assert top.columns == df.columns and {(r["id"], r["_range"]) for r in top.collect()} == {(k, 10 * k) for k in (36, 37, 38, 39)}
    best = aggregates.top_n(df, "v", "id", 1, by=("place",))
    assert best.columns == df.columns and {r["id"] for r in best.collect()} == {38, 39}


def test_merging_by_any_function(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "PARTIAL_KEYS", 3)
    rnd = random.Random(6)
    rows = [(rnd.choice("abcdefgh"), rnd.choice([None, *"xyz"]), k) for k in range(500)] + [(None, "n", 600)]
    df = spark.createDataFrame(rows, "k string, v string, at long").repartition(6)
    want = {}
    for k, v, _ in rows:
        if v is not None:
            want[k] = want.get(k, "") + v
    assert {r["k"]: r["v"] for r in aggregates.merged_by(df, "k", "v", lambda a, b: a + b, order="at").collect()} == want
    assert {r["k"]: r["v"] for r in aggregates.merged_by(df, "k", "v", max).collect()} == {k: max(v) for k, v in want.items()}


def test_modifiers_compose(spark):
    rows = [("very good", 0.65), ("not very good", -0.325), ("not good", -0.25), ("very blue good", 0.5), ("good very", 0.5), ("very very good bad", 0.0725), ("extremely good", 1.0), ("", 0.0), (None, 0.0)]
    df = spark.createDataFrame([(t, w) for t, w in rows], "t string, want double")
    lexicon = spark.createDataFrame([("good", 0.5), ("bad", -0.7), ("very", 0.2)], "word string, polarity double")
    got = text.with_intensity(df, lexicon, "t", {"very": 1.3, "extremely": 4.0}, ["not"]).collect()
    assert [r["sentiment"] for r in got] == pytest.approx([r["want"] for r in got])


def test_result_batches_survive_a_crash_between_write_and_commit(spark, tmp_path):
    import shutil

    source, out, state = f"{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    schema = "s string, n long, v double"
    run = lambda: files.write_result_batches(files.incremental(spark, f"file://{source}", schema), out, 3, state)
    sent(spark, source, [("a", 1, 1.0), ("a", 2, 1.0)])
    run()
    sent(spark, source, [("b", 1, 1.0)])
    run()
    # the second batch was written, but a crash came before it was noted as done; and a third was being made
    for name in ("1", ".1.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    shutil.copytree(tmp_path / "out" / "query=3" / "batch=1", tmp_path / "out" / "query=3" / "_making-2")
    run()
    found = files.read_result_batches(spark, out, 3, schema).select("s", "n").collect()
    assert sorted(map(tuple, found)) == [("a", 1), ("a", 2), ("b", 1)]


def test_merging_many_keys_takes_no_step_a_key(spark):
    n = 20_000
    df = spark.range(2 * n).selectExpr("id % 20000 AS k", "CAST(id AS STRING) AS v", "-id AS at").where("k <> 7 OR id > 100")
    merged = aggregates.merged_by(df, "k", "v", lambda a, b: f"{a},{b}", order="at")
    plan = merged._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan
    got = {r["k"]: r["v"] for r in merged.collect()}
    assert got == {k: f"{k + n},{k}" if k != 7 else f"{k + n}" for k in range(n)}


def test_merged_parts_go_on_over_batches_and_tasks(spark):
    rows = [("hot", str(k), k) for k in range(3000)] + [(None, str(k), k) for k in range(3000)] + [("z", "1", 5)]
    df = spark.createDataFrame(rows, "k string, v string, at long").repartition(7)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = {r["k"]: r["v"] for r in aggregates.merged_by(df, "k", "v", lambda a, b: f"{a},{b}", order="at").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    every = ",".join(map(str, range(3000)))
    assert got == {"hot": every, None: every, "z": "1"}
