import hashlib
import random

import numpy as np
import pytest

from marginalia.llm import edit_fingerprint as E


def plain_fingerprint(text):
    """Steps one at a time, as the method is told."""
    moves = np.random.Generator(np.random.PCG64(78)).random((E.PERIOD, E.CLASSES)) < 0.5
    moves[E.PERIOD - 1] |= ~moves.any(axis=0)
    cls = [((ord(c) * 0x9E3779B1) >> 16) % E.CLASSES for c in text]
    under, i, step = [], 0, 0
    while i < len(text):
        under.append(i)
        i += bool(moves[step % E.PERIOD, cls[i]])
        step += 1
    cp = [ord(c) for c in text] + [0, 0, 0]
    out = f"{len(text).bit_length():02x}"
    for s in (len(text).bit_length(), len(text).bit_length() + 1):
        for u in E._PLACES:
            p = int(u * (2 << s))
            if p >= len(under):
                out += E.PAD
                continue
            g = sum(cp[under[p] + k] * int(E._ODD[k]) for k in range(4)) % (1 << 64)
            out += "0123456789abcdef"[((g ^ (g >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)) >> 60]
    return out


TEXTS = ["", "a", "ab" * 3, "Éàü \U0001f600 x", "the quick brown fox " * 40]


@pytest.mark.parametrize("text", TEXTS)
def test_equals_a_step_by_step_walk(text):
    assert E.fingerprint(text) == plain_fingerprint(text)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 3] + after[: n // 3]
        f, e, x = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(after)
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), f, e, E.likeness(f, e), E.likeness(f, x)))
    return sorted(out, key=str)


def as_rows(df):
    cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BUCKET_DOCS", 5)
    rnd = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    rows = [(i * 7 % 101, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(45)]
    rows += [(500, None), (501, ""), (None, "no id at all"), (502, "é" * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS bucket").repartition(6)
    assert as_rows(E.edited_fingerprints(df)) == brute(rows)


def test_one_row_repeated_rows_empty(spark):
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert as_rows(E.edited_fingerprints(one)) == brute([(1, "abcdef")])
    assert E.edited_fingerprints(one.union(one)).count() == 2
    assert E.edited_fingerprints(one.limit(0)).count() == 0


def test_edits_keep_likeness():
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    near = text[:1000] + "zz" + text[1003:]
    other = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    a, b, c = map(E.fingerprint, (text, near, other))
    assert E.likeness(a, b) > 0.9 > 0.2 > E.likeness(a, c) and E.likeness(a, a) == 1
    assert set(E.band_names(a)) & set(E.band_names(b))


def test_groups(spark):
    rnd = random.Random(1)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(900)) for _ in range(3)]
    rows = [(i, base[i % 3][:300] + "x" * (i // 3) + base[i % 3][300:]) for i in range(12)] + [(50, base[0]), (60, None), (61, "")]
    got = {r["doc_id"]: r["group_id"] for r in E.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 3 for i in range(12)} | {50: 0, 60: 60, 61: 60}


def test_links_beside_the_smallest_of_a_band(spark, monkeypatch):
    from marginalia.llm import edit_fingerprint as e

    rest = e.SAMPLES // e.BAND - 1

    def made(lead, last, next_scale):
        return "0a" + ("0" + lead * rest) * 3 + "0" + last * rest + next_scale * e.SAMPLES

    # one band is shared by all; 2 and 3 are alike, but have no other band in common and aren't like the smallest
    fps = {1: made("1", "2", "1"), 2: made("3", "4", "3"), 3: made("3", "5", "8"), 4: made("6", "7", "6")}
    alike = {(a, b) for a in fps for b in fps if a < b and e.likeness(fps[a], fps[b]) >= 0.3}
    assert alike == {(2, 3)} and len(set(e.band_names(fps[2])) & set(e.band_names(fps[3]))) == 1
    monkeypatch.setattr(e, "fingerprints", lambda docs: spark.createDataFrame(list(fps.items()), "doc_id long, fingerprint string"))
    assert {r[0]: r[1] for r in e.similar_groups(None, 0.3).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}


def test_recall_of_groups_over_all_pairs(spark, sf_dir):
    from itertools import combinations

    from tests.llm.helpers import components

    rnd = random.Random(3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    # edited copies, from light to heavy
    for k, (i, t) in enumerate(rows[:60]):
        t = list(t or "")
        for _ in range(1 + k % 6):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randint(0, 8)] = "xy"
        rows.append((10_000 + i, "".join(t)))
    fps = {i: E.fingerprint(t) for i, t in rows}
    alike = [(a, b) for a, b in combinations(sorted(fps), 2) if E.likeness(fps[a], fps[b]) >= 0.5]
    got = {r["doc_id"]: r["group_id"] for r in E.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = sum(got[a] == got[b] for a, b in alike) / len(alike)
    assert len(alike) > 60 and recall >= 0.9, recall
    # and nothing else comes together
    top = components(fps, alike)
    assert all(top[i] == top[group] for i, group in got.items())
