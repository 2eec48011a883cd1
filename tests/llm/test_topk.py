import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marginalia.llm import topk


def brute(rows, k=10, asks=lambda i: i % 100 == 0):
    good = [
        (i, [math.floor(1024 * float(x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, x in good:
        if asks(q):
            scored = sorted((-min(max(sum(a * b for a, b in zip(x, y)), -(1 << 63)), (1 << 63) - 1), c) for c, y in good if c != q and len(x) == len(y))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def as_rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_real_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert as_rows(topk.top_k(df, df.where("vec_id % 100 = 0"))) == brute(rows)


def test_odd_vectors_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rnd = random.Random(1)
    rows = [(i * 50, [rnd.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(6)]) for i in range(40)]
    rows += [(5000, None), (5001, [1.0, None]), (5100, [float("nan")] * 6), (5200, [float("inf")] * 6), (None, [1.0] * 6), (5300, []), (5400, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("uid", F.lit(1)).withColumn("v", F.lit(2)).withColumn("block", F.lit(3))
    assert as_rows(topk.top_k(df, df.where("vec_id % 100 = 0"))) == brute(rows)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_bounds_are_never_below_the_product():
    rnd = np.random.default_rng(0)
    q, c = (rnd.integers(-900, 900, (n, 37)).astype(float) for n in (20, 50))
    bounds = [a @ b.T for a, b in zip(topk.levels(q), topk.levels(c), strict=True)]
    assert len(bounds) == len(topk.RESOLUTIONS) and all((b >= q @ c.T - 1e-6).all() for b in bounds)


def test_most_pairs_are_pruned():
    frame = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    v = np.floor(np.array(frame["embedding"].tolist(), float) * 1024)
    ids = frame["vec_id"].to_numpy()
    asked = ids % 100 == 0
    search = topk.Search(ids[asked], ids[asked], v[asked], 10)
    for at in range(0, len(v), topk.CANDIDATE_BLOCK):
        search.search(ids[at : at + topk.CANDIDATE_BLOCK], v[at : at + topk.CANDIDATE_BLOCK])
    assert search.pairs == asked.sum() * len(v) and search.exact < 0.25 * search.pairs, search.exact / search.pairs


def test_many_queries_are_dealt(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(topk, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "OPEN_BLOCKS", 1)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert as_rows(topk.top_k(df, df.where("vec_id % 100 = 0"))) == brute(rows)


def test_equal_and_huge_vectors(spark):
    rows = [(i, [0.25, 0.5]) for i in range(400)] + [(1000, [1e9, -1e9]), (1001, [3e9, 2e7]), (1100, [1e30, 1.0]), (1200, [-1e300, 1e300]), (1201, [7e17, 7e17])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert as_rows(topk.top_k(df, df.where("vec_id % 100 = 0"))) == brute(rows)
