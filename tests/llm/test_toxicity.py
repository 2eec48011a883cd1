import random
import zlib

import pytest
from pyspark.sql import functions as F

from marginalia.llm import toxicity as tx


def plain_segments(scores):
    """Maximal scoring segments by their definition: the best segment, then those left and right of it."""
    best = max(((sum(scores[a:b]), a - b, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 1e-12:
        return []
    _, _, a, b = best
    # the shortest of equal ones
    left, right = plain_segments(scores[:a]), plain_segments(scores[b:])
    return [*left, (a, b, best[0]), *[(x + b, y + b, s) for x, y, s in right]]


def test_segments_equal_their_definition():
    rnd = random.Random(3)
    for _ in range(300):
        each = [rnd.choice([-0.5, -0.31, -0.17, 1.13, 2.7, 0.71]) + rnd.random() / 100 for _ in range(rnd.randint(0, 18))]
        names = [f"w{k}" for k in range(len(each))]
        got = tx.segments(names, tx._Scores(dict(zip(names, each, strict=True)), {}, -0.5))
        want = plain_segments(each)
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_repeats_add_once_and_time_is_linear():
    scores = tx._Scores({"bad": 3.0}, {"vile": 2.0}, -0.5)
    assert tx.segments(["bad"] * 500, scores) == [(0, 1, 3.0)]
    assert tx.segments(["x", "bad", "x", "vilest", "x"], scores) == [(1, 4, 4.5)]
    assert tx.segments([], scores) == [] == tx.segments(["x"] * 9, scores)
    many = [f"vile{k}" if k % 12 == 0 else "x" for k in range(600_000)]
    assert len(tx.segments(many, scores)) == 50_000


def labelled(spark, n=1500, seed=5):
    rnd = random.Random(seed)
    common = [f"{a}{b}" for a in ("ba", "lo", "mi", "ru", "te") for b in ("na", "ri", "so", "tu", "ven", "kal")]
    foul = [f"grum{x}" for x in ("a", "ek", "ost", "il", "un", "or", "ist")]
    docs, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        w = [rnd.choice(common) for _ in range(rnd.randint(30, 120))]
        if toxic:
            for _ in range(rnd.randint(2, 5)):
                w.insert(rnd.randrange(len(w)), rnd.choice(foul))
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = labelled(spark)
    # a toxic passage that 40 documents copy makes its ordinary words no more toxic
    copy = "grumost " + " ".join(f"plain{k}" for k in range(30))
    docs += [(5000 + k, copy) for k in range(40)] + [(6000, " ".join(f"plain{k}" for k in range(30))), (6001, "milna " * 2000)]
    labels += [(5000 + k, 1) for k in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r for r in tx.find_toxic(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(out[k]["predicted"] == y for k, y in held) >= 0.99 * len(held)
    assert out[6000]["predicted"] == 0 == out[6001]["predicted"]
    for k, text in docs[:1500:5]:
        for p in out[k]["passages"]:
            assert "grum" in text[p["start"] : p["start"] + p["length"]]


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels = labelled(spark, 300)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    other = [(k, 1 - y) if zlib.crc32(str(k).encode()) % 3 == 1 else (k, y) for k, y in labels]
    one, two = (sorted(map(tuple, tx.find_toxic(d, spark.createDataFrame(x, "doc_id long, toxic int")).select("doc_id", "score").collect())) for x in (labels, other))
    assert one == two


def test_nulls_repeats_clashes_and_nothing_to_learn(spark):
    docs, labels = labelled(spark, 400)
    rows = [(None, "grumek grumost"), (9000, None), (9001, ""), (9002, "İ GRUMEK grumost"), (9003, "tuna " * 200_000), (9003, "tuna " * 200_000)]
    d = spark.createDataFrame([*docs, *rows], "doc_id long, text string").withColumns({"score": F.lit("old"), "row": F.lit(1), "judged": F.lit(2)})
    known = spark.createDataFrame([*labels, (None, 1), (9001, None), (0, 0)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    out = tx.find_toxic(d, known)
    assert out.columns == ["doc_id", "text", "row", "judged", "score", "predicted", "passages"]
    got = out.collect()
    assert len(got) == len(docs) + len(rows) and all(0 <= r["score"] <= 1 for r in got)
    low = {r["score"] for r in got if r["doc_id"] in (9000, 9001)}
    assert len(low) == 1 and low.pop() == min(r["score"] for r in got)
    assert {r["predicted"] for r in got if r["doc_id"] in (None, 9002)} == {1}
    assert len({r["score"] for r in got if r["doc_id"] == 9003}) == 1
    none = tx.find_toxic(d, known.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0} and len(none) == len(got)
    assert tx.find_toxic(d.limit(0), known).collect() == []
