import random
import zlib

import pytest
from pyspark.sql import functions as F

from marginalia.llm import language_id as L
from tests.llm.helpers import docs_frame


def test_automaton_accepts_exactly_the_substrings():
    s = "abracadabra abba"
    codes = [ord(c) for c in s]
    step = L.suffix_automaton(codes)

    def accepted(t):
        at = 0
        for c in t:
            at = step[at].get(ord(c))
            if at is None:
                return False
        return True

    pieces = {s[i:j] for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    assert all(map(accepted, pieces))
    assert not any(accepted(p + c) for p in pieces for c in "abrcdz" if p + c not in pieces)


def plain_phrases(codes, trained):
    """Greedy longest matches of a text (as symbols) in a trained one, piece by piece; strange letters match nothing."""
    total = 0
    for at in range(0, len(codes), L.PIECE):
        piece = list(codes[at : at + L.PIECE])
        while piece:
            n = 1
            while n < len(piece) and any(trained[k : k + n + 1] == piece[: n + 1] for k in range(len(trained))):
                n += 1
            total += 1
            piece = piece[n:]
    return total


@pytest.mark.parametrize("table", [16_000_000, 600, 1])
def test_phrases_equal_a_plain_parse(monkeypatch, table):
    monkeypatch.setattr(L, "TABLE", table)
    samples = {"x": ["the cat sat on the mat", "a mat"], "y": ["le chat est là"]}
    model = L.fit(samples)
    assert table > 1 or model.width == 4 and len(model.rare_keys)
    for text in ["the chat sat", "", "zzz qqq", "là là là the", "A CAT!!! 123 on-a-mat", "the cat " * 300]:
        codes = L._symbols(text, model.known, model.symbol)
        got = L.phrases([codes], model)[0]
        for k, lang in enumerate(model.langs):
            trained = [1] + [c for t in samples[lang] for c in L._symbols(t, model.known, model.symbol).tolist()]
            assert got[k] == plain_phrases(codes.tolist(), trained), (text, lang)


def test_large_scripts_and_many_languages(spark):
    rnd = random.Random(4)
    chinese, japanese = ([chr(0x4E00 + k) for k in range(at, at + 3000)] for at in (0, 1500))
    draw = lambda letters: "".join(rnd.choice(letters) for _ in range(40))
    # pairs of letters that are common in one language alone, as words are
    words = {"zh": [draw(chinese)[:3] for _ in range(400)], "ja": [draw(japanese)[:3] for _ in range(400)]}
    rows = [(k, " ".join(rnd.choice(words[lang]) for _ in range(60)), lang, "s", 1) for k, lang in enumerate(["zh", "ja"] * 150)]
    rows += [(1000 + 9 * k + j, f"{draw('abcdefgh')} w{k}" * 3, f"l{k:03d}", "s", 1) for k in range(300) for j in range(3)]
    got = L.identify(docs_frame(spark, rows)).select("doc_id", "lang", "lang_pred", L.held_out(F.col("doc_id")).alias("h")).collect()
    held = [r for r in got if r["h"] and r["lang"] in ("zh", "ja")]
    assert len(held) > 60 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    model = L.train(docs_frame(spark, rows))
    assert len(model.langs) > 280 and len(model.table) <= max(L.TABLE, 4 * len(model.start_of))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs).select("*", L.held_out(F.col("doc_id")).alias("h")).collect()
    held = [r for r in got if r["h"]]
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got) and len(held) > 200
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.99
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    one, two = (sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in L.identify(d).collect()) for d in (docs, spoiled))
    assert one == two


def test_odd_rows(spark):
    rows = [(k, "der hund und die katze schlafen im haus", "de", "s", 1) for k in range(6)]
    rows += [(k, "the dog and the cat sleep in the house", "en", "s", 1) for k in range(6, 12)]
    rows += [(100, None, "en", "s", 1), (101, "", "de", "s", 1), (102, "123 --- !!", None, "s", 1), (None, "the cat", None, None, None)]
    rows += [(103, "the dog sleeps " * 30_000, None, "s", 1), (103, "the dog sleeps " * 30_000, None, "s", 1), (104, "漢字", None, "s", 1)]
    df = docs_frame(spark, rows).withColumn("score", F.lit("old")).withColumn("_judged", F.lit(1)).withColumn("judged", F.lit(2))
    got = [(r["doc_id"], r["lang_pred"]) for r in L.identify(df).collect()]
    assert len(got) == len(rows)
    assert {p for i, p in got if i in (100, 101, 102)} == {"und"}
    assert {p for i, p in got if i in (103, None)} == {"en"} and dict(got)[104] in ("de", "en")
    assert L.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in L.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
