import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """All nodes from the rebuilt texts themselves."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(turns)] for c, turns in own.items()}
    rebuilt, members, children = {}, defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = (*own.get(base, [])[:h], *turns[h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        if p:
            children[p[:-1]].append(p)
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if rebuilt[c] == p)))
        above = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), above, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie(spark, rows):
    return sorted(map(tuple, pt.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()))


def messy(seed, n=160):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-40, 400), n):
        for t in range(rnd.randint(1, 14)):
            turn = rnd.choice([t, t, t, None, 3])  # ties and nulls
            rows.append((c, turn, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b", "", None, "é" * 3])))
    rows += rows[:25] + [(None, 1, "user", "no id"), (400, None, None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_all_nodes_of_messy_conversations(spark, seed):
    rows = messy(seed)
    assert trie(spark, rows) == plain_trie(rows)


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = pt.prefix_trie(df.withColumns({"depth": F.lit(1), "first": F.lit("x"), "f0": F.lit(2)}))
    assert sorted(map(tuple, got.collect())) == plain_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_no_conversations_and_none_with_turns(spark):
    assert trie(spark, []) == [] == trie(spark, [(None, 1, "user", "x")])
    # conversation 6 takes more turns from conversation 5 than it has itself, and there is no conversation 5
    alone = [(6, 1, "user", "x")]
    assert zlib.crc32(b"6") % 9 >= 1
    assert trie(spark, alone) == plain_trie(alone) == [(6, 0, None, 1, 0, 1, 0, hashlib.sha256(b"6").hexdigest())]


def test_long_conversation_of_many_ranges_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK_BITS", 4)
    rows = [(10, t, "user", f"t{t % 7}") for t in range(900)] + [(11, t, "user", f"t{t % 7}") for t in range(870)]
    rows += [(12, 0, "user", "x" * 300_000), (15, 0, "user", "x" * 300_000)]
    spark.conf.set("spark.sql.adaptive.enabled", False)  # so that ranges aren't put together
    try:
        assert trie(spark, rows) == plain_trie(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_ids_of_a_node_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK_BITS", 3)
    rows = [(c, 0, "user", "same") for c in range(-60, 240)]
    assert trie(spark, rows) == plain_trie(rows)


def test_shared_fingerprints_and_references_are_noticed(spark, monkeypatch):
    rows = messy(5, 40)
    tried, residues, references = [], pt._residues, pt.turn_references

    def weak_residues(salt):  # all turns alike at first
        tried.append(salt)
        return [F.lit(5).cast("bigint") for _ in pt.LANES] if salt == 0 else residues(salt)

    def weak_references(salt):  # then two texts under one reference
        return (F.length("text").cast("bigint"), F.lit(1).cast("bigint")) if salt == 1 else references(salt)

    monkeypatch.setattr(pt, "_residues", weak_residues)
    monkeypatch.setattr(pt, "turn_references", weak_references)
    assert trie(spark, rows) == plain_trie(rows) and tried == [0, 1, 2]


def test_composition_equals_one_pass(spark):
    """Fingerprints of rebuilt prefixes are those of the rebuilt turns taken one after another."""
    rows = [(c, t, "user", f"{c % 3} {t}") for c in (20, 21, 22, 23, 24) for t in range(12)]
    turns = spark.createDataFrame(rows, SCHEMA)
    ordered = pt.turns_in_order(turns, 0)
    h = {(r["conv_id"], r["pos"]): r["h"] for r in ordered.select("conv_id", "pos", pt._residues(0)[0].alias("h")).collect()}
    _, prefixes = pt.rebuilt_prefixes(ordered)
    for r in prefixes.collect():
        c, taken = r["conv_id"], zlib.crc32(str(r["conv_id"]).encode()) % 9
        own = [h[(c - c % 5 if k <= taken else c), k] for k in range(1, r["depth"] + 1)]
        assert r["f0"] == sum(x * pow(pt.BASES[0], k, pt.PRIME) for k, x in enumerate(own, 1)) % pt.PRIME
        assert r["b0"] == sum(x * pow(pt.BASES[0], k, pt.PRIME) for k, x in enumerate(own[:-1], 1)) % pt.PRIME
