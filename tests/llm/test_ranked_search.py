import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import ranked_search as rs


def plain_terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, k=50):
    bags = [(d, Counter(plain_terms(t))) for d, t in docs if plain_terms(t)]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(plain_terms(text))
    out = []
    for i, words in wanted.items():
        scored = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in words if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def messy(seed, n=500):
    rnd = random.Random(seed)
    known = [f"w{int(rnd.paretovariate(0.7)) % 300}" for _ in range(3000)]
    docs = [(k, " ".join(rnd.choice(known) for _ in range(rnd.randint(0, 60)))) for k in range(n)]
    docs += docs[:40]  # rows twice: ties under one id
    docs += [(n + k, docs[7][1]) for k in range(30)] + [(None, docs[7][1]), (None, "w1 w2"), (2000, None), (2001, ""), (2002, "!?\x00"), (2003, "É É-é x" * 3)]
    items = [(k, " ".join(rnd.choice(known) for _ in range(12))) for k in range(12)]
    return docs, [*items, (12, docs[7][1]), (13, None), (14, "nowhere"), (None, "W1, é"), (3, "w5 w5 extra")]


@pytest.mark.parametrize(("seed", "block"), [(1, 8192), (2, 150)])
def test_equals_plain_search(spark, monkeypatch, seed, block):
    docs, items = messy(seed)
    monkeypatch.setattr(rs, "STRETCH", 8)
    monkeypatch.setattr(rs, "BLOCK", block)
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert rows_of(rs.search(table, asked, 10)) == sorted(plain_search(docs, items, 10), key=str)


def test_items_in_several_passes(spark, monkeypatch):
    docs, items = messy(3, 60)
    monkeypatch.setattr(rs, "ITEMS", 4)
    got = rs.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert rows_of(got) == sorted(plain_search(docs, items, 5), key=str)


def test_empty_tables_and_a_very_long_text(spark):
    none_d, none_i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    docs, items = [(1, "long " * 400_000 + "rare"), (2, "rare bird"), (3, "other words")], [(1, "Rare")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(rs.search(none_d, i)) == [] == rows_of(rs.search(d, none_i))
    assert rows_of(rs.search(d, i)) == plain_search(docs, items)


def test_terms_by_bytes():
    for text in ("Été 2X—naïve_é", "a\x00B\x7fC", "İI日本 x", "{~}", ""):
        assert [t.decode() for t in rs.terms(text)] == plain_terms(text)


def test_long_lists_are_skipped():
    """Of a block with two common terms and one rare one, few postings of the common lists are looked up."""
    rnd = np.random.default_rng(4)
    n = 8000
    owner = np.concatenate([np.arange(n), np.arange(n), np.sort(rnd.choice(n, 90, replace=False))])
    term = np.repeat([0, 1, 2], [n, n, 90])
    tf = np.ones(len(owner), np.int64)
    block = rs._Block(np.arange(n), np.full(n, 50), owner, term, tf, rs.Weights(n, 50 * n, np.array([3, 2, 5000])))
    best = rs._Best(50)
    looked = rs.search_block(block, np.array([0, 1, 2]), best, {})
    assert len(best.ids) == 50 and looked < 0.1 * 2 * n
