"""Each stage of the pipeline against a plain version over the stage's own input, and all of them together."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import language_id
from tests.llm.helpers import components, shingles, words
from tests.llm.test_line_dedup import without_earlier_runs
from tests.llm.test_mixing import targets
from tests.llm.test_packing import reference_ids, verify

STAGE = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, _key string, n int, copies string, node long"


def frame(spark, rows):
    """Documents with further columns, of names that operators might use themselves."""
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else None, k, "x", k, "y", -k) for k, (i, t, lang, s) in enumerate(rows)], SCHEMA).repartition(3)


def odd_rows():
    rnd = random.Random(7)
    vocabulary = {lang: [f"{lang}{rnd.choice('aeiou')}{rnd.choice('bcdfg')}{k}" for k in range(60)] for lang in ("de", "en")}
    rows = []
    for k in range(90):
        lang = ("de", "en")[k % 2]
        lines = [" ".join(rnd.choice(vocabulary[lang]) for _ in range(12)) for _ in range(rnd.randint(1, 6))]
        if k % 5 == 0:
            lines += ["a line that many share", "and one after it", f"its third line {k % 2}"]
        rows.append((k, "\n".join(lines), lang, rnd.choice(["a", "b", "c"])))
    rows += [(200 + k, rows[k][1] + " more", rows[k][2], "a") for k in range(0, 30, 3)]  # near copies
    rows += [(300 + k, rows[k][1], rows[k][2], "b") for k in range(0, 20, 4)]  # exact copies
    return rows + [
        (400, None, "en", "a"), (401, "", "de", None), (402, "12 34 !!", "en", "b"), (403, rows[3][1], None, None), (None, rows[5][1], "en", "c"),
        (None, rows[5][1], "en", "c"), (7, rows[8][1], "de", "c"), (8, rows[8][1], "de", "c"), (404, " \n ", "en", "tiny"), (405, "word " * 30_000, "en", "a"),
    ]


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_language_stage(spark):
    docs = frame(spark, odd_rows())
    out = STAGE["language_id"](spark, docs, "")
    assert out.columns == docs.columns
    # what has a letter is judged; labels play no part in that
    assert texts(out) == sorted(((i, t) for i, t, _, _ in odd_rows() if t and any(c.isalpha() for c in t)), key=str)
    truth = {t: lang for _, t, lang, _ in odd_rows()[:90]}
    assert all(truth.get(r["text"], r["lang"]) == r["lang"] for r in out.collect())
    assert STAGE["language_id"](spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == 0


def test_line_stage(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())  # ids of their own, for the plain version
    docs = frame(spark, rows)
    out = STAGE["line_dedup"](spark, docs, "")
    want = [(i, t) for i, t, _, gone in without_earlier_runs([(i, t) for i, t, _, _ in rows]) if gone == 0 or words(t)]
    assert texts(out) == sorted(want, key=str) and out.columns == docs.columns
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
    # equal rows leave one whole text, and rows without an id lose nothing else
    text = "one line\nand another\nand a third"
    again = STAGE["line_dedup"](spark, frame(spark, [(None, text, "en", "a")] * 3 + [(None, "own\nlines", "en", "a")]), "")
    assert texts(again) == [(None, text), (None, "own\nlines")] or texts(again) == [(None, "own\nlines"), (None, text)]


def test_near_duplicate_stage(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    out = STAGE["minhash_dedup"](spark, docs, "")
    sets = [shingles(t, 5) for _, t, _, _ in rows]
    links = [
        (a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ] + [(a, b) for a in range(len(rows)) for b in range(a) if rows[a][0] is not None and rows[a][0] == rows[b][0] and sets[a] and sets[b]]
    top = components(range(len(rows)), links)
    groups = {}
    for k, root in top.items():
        groups.setdefault(root, []).append(k)
    got = texts(out)
    assert out.columns == docs.columns and len(got) == len(groups)
    for members in groups.values():
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        allowed = {(min(ids) if ids else None, rows[k][1]) for k in members}
        assert sum((i, t) in allowed for i, t in got) >= 1
    assert sum(t is None or not words(t) for _, t in got) == sum(not words(t) for _, t, _, _ in rows)


def test_mixing_stage(spark):
    rows = odd_rows()
    out = STAGE["source_mixing"](spark, frame(spark, rows), "")
    sizes, taken = {}, {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    times = {}
    for r in out.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
        times[r["row"]] = times.get(r["row"], 0) + 1
    want = targets(sizes)
    largest = {s: max(len(words(t)) for _, t, _, u in rows if u == s) for s in sizes}
    assert all(abs(taken.get(s, 0) - want[s]) <= max(2, 0.5 * largest[s]) for s in sizes)
    assert max(times.values()) <= 3 and out.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_packing_stage(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    out = STAGE["packing"](spark, frame(spark, rows), "")
    assert verify(out.collect(), {i: t for i, t, _, _ in rows}) > 0.9


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, name):
    empty = frame(spark, odd_rows()).limit(0)
    assert STAGE[name](spark, empty, "").count() == 0


def test_end_to_end(spark, tmp_path):
    rows = odd_rows()
    frame(spark, rows).drop("lang").withColumn("lang", F.lit("en")).withColumn("lang", F.when(F.col("text").startswith("de"), "de").otherwise("en")).write.parquet(
        f"file://{tmp_path}/documents.parquet"
    )
    pieces = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, "").write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
    kept = {}
    for r in docs.collect():
        kept.setdefault(r["doc_id"], []).append(r["text"])
    ids = {}
    for p in pieces:
        ids[p["doc_id"]] = ids.get(p["doc_id"], 0) + p["length"]
    assert ids == {i: sum(len(reference_ids(t)) + 1 for t in ts) for i, ts in kept.items()}
    assert public_tokenizers.path("byte_bpe_50k.json") and all(p["offset"] + p["length"] <= 2048 for p in pieces)
    judged = {r["doc_id"] for r in language_id.identify(spark.read.parquet(f"file://{tmp_path}/documents.parquet")).where("lang_pred <> 'und'").collect()}
    assert set(kept) <= judged
