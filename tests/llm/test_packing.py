import json
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from marginalia.llm import packing
from marginalia.llm.packing import encoded, pack, pack_histogram

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def reference_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_whole_texts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(packing, "UNITS", 500)
    rnd = random.Random(2)
    bits = [" ", "  ", "\n", "\t", " \n", " ", "　", "'s", "'", "don't", "é", "Ünder", "12", "3.4", "!!", "漢字", "\U0001f600", "a", "<|endoftext|>", "\x1c", "\x85", ",", ".", "it's.", "x,y", " , ", "I'll!"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(6000)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for text, ids in zip(texts, encoded(texts, PATH), strict=True):
        assert ids.tolist() == reference_ids(text), repr(text)
    assert next(encoded(["a <|endoftext|> b"], PATH)).tolist() == [64, 220, 50256, 275]


def test_other_files_give_the_ids_of_whole_texts(tmp_path):
    spec = json.loads(Path(PATH).read_text())
    odd = {
        "prefix": {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}},
        "lower": {"normalizer": {"type": "Lowercase"}},
        "strips": {"added_tokens": [{**t, "rstrip": True} for t in spec["added_tokens"]]},
        "spaced": {"added_tokens": [{**spec["added_tokens"][0], "id": 50257, "content": "two words"}, *spec["added_tokens"]]},
    }
    paths = [public_tokenizers.path("word_bpe_49k.json")]
    for name, change in odd.items():
        (tmp_path / name).write_text(json.dumps(spec | change))
        paths.append(str(tmp_path / name))
    texts = ["Hello two words, the World. It's  3.4 é!!", "a <|endoftext|>  b", "", " x"]
    assert packing.Units(PATH).by_units
    for path in paths:
        plain = Tokenizer.from_file(path)
        assert not packing.Units(path).by_units
        assert [x.tolist() for x in encoded(texts, path)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_runs_of_white_space(spark):
    rows = [(1, "before"), (2, "x" + " " * 1_200_000 + "y"), (3, "after"), (4, "x" + " \t\xa0" * 400_000 + "y"), (5, "\n" * 1_200_000)]
    verify(pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect(), dict(rows))


def test_histogram_packing_keeps_counts_and_fits():
    rnd = random.Random(4)
    lengths = {k: rnd.randint(1, 9) for k in rnd.sample(range(1, 129), 70)}
    patterns = pack_histogram(lengths, 128)
    placed = {}
    for pattern, n in patterns:
        assert sum(pattern) <= 128 and n > 0
        for x in pattern:
            placed[x] = placed.get(x, 0) + n
    assert placed == lengths
    packs = sum(n for _, n in patterns)
    assert sum(k * n for k, n in lengths.items()) / (packs * 128) > 0.97


def verify(rows, texts, capacity=2048):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.array([*reference_ids(texts[i]), 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and zlib.crc32(part.tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return sum(r["length"] for r in rows) / (capacity * len(by_sequence))


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert verify(pack(docs, PATH).collect(), texts) > 0.98


def test_many_parts_of_a_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 7)
    rows = [(k, "word " * (k % 3) + "x" * (k % 2)) for k in range(300)] + [(900, "word " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert verify(pack(df, PATH).collect(), dict(rows)) > 0.9
    same = spark.createDataFrame([(None, "a b c")] * 200, "doc_id long, text string")
    got = pack(same, PATH).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 200


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "x"), (5, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS length")
    verify(pack(df, PATH).collect(), dict(rows))
    twice = pack(df.union(df), PATH).collect()
    assert len(twice) == 2 * len(pack(df, PATH).collect())
    assert len({(r["sequence_id"], r["offset"]) for r in twice}) == len(twice)
    assert pack(spark.createDataFrame([(None, "no id")], "doc_id long, text string"), PATH).collect()[0]["doc_id"] is None
    assert pack(df.limit(0), PATH).count() == 0
    ids = pack(df, PATH, with_ids=True).where("doc_id = 4").collect()[0]["ids"]
    assert ids == [*reference_ids("x"), 1]
