import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import near_dedup
from marginalia.llm.common import connected_components
from tests.llm.helpers import components, shingles


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    links = [
        (a, b)
        for x, (a, s) in enumerate(sets)
        for b, t in sets[x + 1 :]
        if s and t and 100 * len(s & t) >= percent * len(s | t)
    ]
    top = components({i for i, _ in rows}, links)
    return sorted((i, len(s), top[i], top[i] == i) for i, s in sets)


def near_copies(n=160, seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, base = [], []
    for i in range(n):
        if i % 8 == 0 or not base:
            base = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 150))]
        text = [w if rnd.random() > rnd.choice([0, 0.02, 0.05, 0.1]) else rnd.choice(vocabulary) for w in base]
        rows.append((i * 3, (" " if i % 5 else "\n").join(text).upper() if i % 7 == 0 else " ".join(text)))
    return rows


def as_rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_equals_all_pairs(spark):
    rows = near_copies()
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "ONE"), (1005, "É"), (1006, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(near_dedup.near_duplicates(df, words=2)) == brute(rows, 2)


def test_real_documents_equal_all_pairs(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert as_rows(near_dedup.near_duplicates(df, words=2)) == brute(rows, 2)


@pytest.mark.parametrize("block, leaders", [(7, 8), (3, 0), (2, 1)])
def test_large_component_in_blocks(spark, monkeypatch, block, leaders):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    monkeypatch.setattr(near_dedup, "LEADERS", leaders)
    met = []
    real = near_dedup._met
    monkeypatch.setattr(near_dedup, "_met", lambda *args: met.append(1) or real(*args))
    # a chain of texts, each near the next one alone, beside groups of copies
    chain = [f"c{k}" for k in range(140)]
    rows = near_copies(60, seed=9) + [(900 + k, " ".join(chain[4 * k : 4 * k + 80])) for k in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert as_rows(near_dedup.near_duplicates(df, words=3)) == brute(rows, 3)
    assert len(met) == 2


def test_rows_of_one_id_have_the_links_of_each(spark):
    a, b = ("one two three four five six seven", "eins zwei drei vier fuenf sechs sieben")
    rows = [(3, a), (7, a), (7, b), (9, b), (20, "else altogether")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(df, words=2).collect())
    assert got == [(3, 3), (7, 3), (7, 3), (9, 3), (20, 20)]
    assert sorted(r["doc_id"] for r in near_dedup.without_near_duplicates(df, words=2).collect()) == [3, 20]


def test_odd_rows(spark):
    text = "a b c d e f g h"
    rows = [(7, text), (7, text), (None, text), (None, "x y"), (3, "q " * 30_000), (2, "q " * 30_001), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS node", "3 AS component")
    got = [tuple(r) for r in near_dedup.near_duplicates(df, words=2).collect()]
    assert sorted(map(str, got)) == sorted(
        map(str, [(7, 7, 7, True), (7, 7, 7, True), (None, 7, 7, False), (None, 1, None, True), (3, 1, 2, False), (2, 1, 2, True), (5, 0, 5, True)])
    )
    assert near_dedup.near_duplicates(df.limit(0), words=2).count() == 0


def test_hashes_are_stable_and_word_exact():
    a = near_dedup.word_hashes("The  the\tTHE éa Éa a b ab")
    assert a[0] == a[1] == a[2] and len(set(a.tolist())) == 6
    assert (near_dedup.word_hashes("zz " * 50_000 + "ab")[-1] == a[-1]).all()


def test_signature_keeps_both_ends():
    x = np.array([3, 5, 9], np.uint64)
    s = near_dedup.signature(x)
    v = near_dedup._MULTIPLY[:, None] * x[None, :] + near_dedup._ADD[:, None]
    assert (s[:, 0] == v.min(1)).all() and (s[:, 1] == v.max(1)).all()


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 20)] + [(k, k + 1) for k in range(100, 140)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    nodes = {x for p in links for x in p} - {20}
    assert {r["node"]: r["component"] for r in got} == components(nodes, [p for p in links if p[0] != 20])


def test_star_edges_keep_components(spark):
    draw = random.Random(5)
    links = sorted({(min(p), max(p)) for p in ((draw.randrange(300), draw.randrange(300)) for _ in range(220))})
    links += [(hub, node) for node in range(500, 560) for hub in (400, 401, 402)]
    df = spark.createDataFrame(links, "hub bigint, node bigint")
    whole = connected_components(df.select(F.col("hub").alias("a"), F.col("node").alias("b")))
    assert sorted(map(tuple, connected_components(near_dedup.star_edges(df)).collect())) == sorted(map(tuple, whole.collect()))
    assert near_dedup.star_edges(df).where("a >= 400").distinct().count() == 62
