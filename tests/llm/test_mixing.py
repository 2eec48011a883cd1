import hashlib
import math
import random

from marginalia.llm import mixing
from marginalia.llm.mixing import mix, mixed_documents
from tests.llm.helpers import words


def targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def check(df):
    rows = [r.asDict() for r in mix(df).collect()]
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        assert r["size"] == len(words(r["text"])) and r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        s = r["source"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        largest[s] = max(largest.get(s, 0), r["size"])
    want = targets(sizes)
    for r in rows:
        s = r["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
    return rows, sizes, taken, want, largest


def test_targets_and_takes(spark):
    rnd = random.Random(3)
    names = ["b", "a", None, "é", "Z", "tiny"]
    rows = [(k, rnd.choice(names[:5]) if k % 3 else "a", "w " * int(rnd.paretovariate(1.1) * 5)) for k in range(900)]
    rows += [(5000, "tiny", "one"), (5001, "a", None), (5002, "empty", ""), (None, "b", "x y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS s", "2 AS row", "3 AS rank", "4 AS more")
    got, sizes, taken, want, largest = check(df)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 0.02 * want[s], 0.5 * largest[s])
    again = sorted(str(r.asDict()) for r in mix(df.repartition(5)).collect())
    assert again == sorted(map(str, got))


def test_real_documents_come_near(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    _, sizes, taken, want, _ = check(df)
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in sizes)


def test_many_bins(spark, monkeypatch):
    from marginalia.llm import mixing

    monkeypatch.setattr(mixing, "BIN_DOCS", 10)
    rows = [(k, "s" + str(min(2, k % 5)), "w " * (1 + k * 7919 % 40)) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    _, sizes, taken, want, _ = check(df)
    assert all(abs(taken[s] - want[s]) <= 40 for s in sizes)


def test_repeated_rows_extra_columns_empty(spark):
    rows = [(1, "a", "x y z", 9), (1, "a", "x y z", 9), (2, "a", "q", 9), (3, "b", "q r", 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, rows long")
    got, *_ = check(df)
    assert len(got) == 4 and got[0]["rows"] == 9
    copies = sum(r["copies"] for r in got)
    assert mixed_documents(df).count() == copies and mixed_documents(df).columns == df.columns
    assert mix(df.limit(0)).count() == 0


def plain_copies(rows):
    """Copies of each (id, source, size): whole ones, and one more in the order of odds over inclusion odds."""
    units = {}
    for i, s, t in rows:
        key = (i, s, len(words(t)))
        units[key] = units.get(key, 0) + 1
    sizes = {}
    for (_, s, size), n in units.items():
        sizes[s] = sizes.get(s, 0) + size * n
    want, copies = targets(sizes), {}
    for s, total in sizes.items():
        mine = {u: n for u, n in units.items() if u[1] == s}
        docs = sum(mine.values())
        whole = math.floor(want[s] / total) if total else 1
        goal = want[s] - whole * total
        share = min(goal / max(total, 1), 0.999999)
        bins = min(math.ceil(docs / mixing.BIN_DOCS), math.ceil(math.sqrt(docs)))
        ranked = []
        for (i, _, size), n in mine.items():
            copies[i, s, size] = whole
            if size and share > 0:
                u = (int(hashlib.md5(f"{'' if i is None else i}:mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                rank = u / (1 - u) / (math.sqrt(size * docs / max(total, 1)) * share / (1 - share))
                x = rank * share / (1 - share)
                ranked.append((rank, -1 if i is None else i, size, size * n, math.floor(x / (1 + x) * bins), i))
        ranked.sort()
        below, taken = 0, set()
        for b in sorted({r[4] for r in ranked}):
            inside = [r for r in ranked if r[4] == b]
            if below + sum(r[3] for r in inside) <= goal:
                taken |= set(inside)
                below += sum(r[3] for r in inside)
                continue
            left, more = goal - below, set()
            for k in range(3):
                run, open_ = 0, [r for r in inside if not k or (r not in more and r[3] <= left)]
                new = set()
                for r in open_:
                    run += r[3]
                    if run <= left:
                        new.add(r)
                more |= new
                left = goal - below - sum(r[3] for r in more)
            rest = [(abs(r[3] - left), r) for r in inside if r not in more]
            if rest and min(rest)[0] < left:
                more.add(min(rest)[1])
            taken |= more
            break
        for r in taken:
            copies[r[5], s, r[2]] += 1
    return copies


def test_chosen_documents_equal_a_plain_version(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(k, rnd.choice(["a", "b", "c", None]) if k % 4 else "a", "w " * int(rnd.paretovariate(1.2) * 4)) for k in range(700)]
    rows += [(800, "empty", ""), (801, "a", None), (5, "a", "w w w"), (5, "a", "w w w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    for size in (1000, 20):
        monkeypatch.setattr(mixing, "BIN_DOCS", size)
        got = {(r["doc_id"], r["source"], r["size"]): r["copies"] for r in mix(df).collect()}
        assert got == plain_copies(rows)
