import hashlib
import random

from pyspark.sql import functions as F

from marginalia.llm import line_dedup
from marginalia.llm.line_dedup import MODULUS, MULTIPLIER, dedup_passages
from tests.llm.helpers import words


def chunked(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    r = [((h[i - 1] if i else 0) * MULTIPLIER + h[i]) % MODULUS for i in range(len(h))]
    out, begin = [], 0
    for i in range(len(r)):
        if i == len(r) - 1 or (i and r[i] < r[i - 1] and r[i] <= r[i + 1]):
            out.append(lines[begin : i + 1])
            begin = i + 1
    return out


def chunks_and_neighbours(rows):
    """Repeated chunks and the lines of the chunks beside them that are repeated too: ``(id, line)`` of all."""
    first, out = {}, set()
    cut = {i: chunked(t) for i, t in sorted(rows)}
    for i, chunks in cut.items():
        at = 0
        for k, c in enumerate(chunks):
            if len(c) > 1:
                j, m = first.setdefault(tuple(c), (i, k))
                if (j, m) != (i, k):
                    out |= {(i, x) for x in range(at, at + len(c))}
                    theirs = cut[j]
                    for step, mine, other in ((-1, chunks[k - 1][::-1] if k else [], theirs[m - 1][::-1] if m else []), (1, (chunks[k + 1 : k + 2] or [[]])[0], (theirs[m + 1 : m + 2] or [[]])[0])):
                        for n, (x, y) in enumerate(zip(mine, other, strict=False)):
                            if x != y:
                                break
                            out.add((i, at - 1 - n if step < 0 else at + len(c) + n))
            at += len(c)
    return out


def anchored(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string").repartition(3).withColumn("key", F.encode(F.col("id").cast("string"), "UTF-8"))
    found = line_dedup.repeated_chunks(df, F.split("text", "\n", -1)).collect()
    return {(int(bytes(r["key"])), k) for r in found for k in range(r["begin"], r["end"])}


def test_anchors_and_extension(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", "text").collect()]
    found = anchored(spark, rows)
    assert found == chunks_and_neighbours(rows) and found


def test_boundaries_resist_shifts(spark):
    """A passage of some lines is found by its own chunks wherever it stands, and to its first and last line."""
    rnd = random.Random(1)
    passage = [f"shared line number {k}" for k in range(20)]
    rows = [(0, "\n".join(passage))]
    for i in range(1, 40):
        own = [f"own {rnd.random()}" for _ in range(rnd.randint(1, 9))]
        at = rnd.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + passage + own[at:])))
    found = anchored(spark, rows)
    assert found == chunks_and_neighbours(rows)
    assert sum(len([x for x in found if x[0] == i]) == 20 for i in range(1, 40)) >= 30 and not any(i == 0 for i, _ in found)


def test_hashes_that_collide_are_told_apart_by_bytes(spark, monkeypatch):
    rows = [(k, "\n".join(f"{w} {k // 2} and some more words in this line" for w in "abcdefg")) for k in range(12)]
    monkeypatch.setattr(line_dedup.F, "xxhash64", lambda *_: F.lit(7).cast("bigint"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert passages(df) == without_earlier_runs(rows)


def test_short_runs_of_structure_stay(spark):
    intro = ["intro", "", "", "body {}", "}}", "", "end {}"]
    rows = [(k, "\n".join(intro).format(k, k)) for k in range(1, 6)]
    assert passages(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(((k, t, 7, 0) for k, t in rows), key=str)


def test_odd_texts(spark):
    long = "w " * 200_000
    rows = [(1, None), (2, ""), (3, "\n\n\n\n"), (4, "a\nb\nc\nd"), (5, "a\nb\nc\nd"), (6, "x\n" * 20_000), (7, "a\r\nb\n"), (8, "\n\n\n\n"), (9, f"{long}\n{long}b\nc"), (10, f"z\n{long}\n{long}b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert passages(df) == without_earlier_runs(rows)
    empty = dedup_passages(spark.createDataFrame([], "doc_id long, text string, n_lines string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "n_lines", "n_lines_removed"]


def test_clashing_columns_repeated_rows_and_null_ids(spark):
    text = "\n".join(f"line {k} of it" for k in range(9))
    df = spark.createDataFrame([(1, text, "p"), (1, text, "q"), (None, text, "r")], "doc_id long, text string, _at string")
    df = df.selectExpr("*", "_at AS gone", "1 AS key", "2 AS first", "3 AS at", "4 AS begin")
    got = {r["_at"]: r for r in dedup_passages(df).collect()}
    assert got["r"]["text"] == text and got["p"]["n_lines_removed"] == got["q"]["n_lines_removed"] == 9
    assert got["p"]["key"] == 1 and got["p"]["first"] == 2 and got["q"]["gone"] == "q"


def without_earlier_runs(rows, least=line_dedup.LEAST_WORDS):
    """Every run of two lines or more that stands at an earlier place and has so many words, whatever is around it; rows with ids of their own."""
    seen, out = set(), []
    for i, t in sorted(rows):
        lines = [] if t is None else t.split("\n")
        drop = set()
        for k in range(len(lines) - 1):
            if (lines[k], lines[k + 1]) in seen:
                drop |= {k, k + 1}
            seen.add((lines[k], lines[k + 1]))
        for k in sorted(drop):
            if k - 1 not in drop:
                end = k
                while end in drop:
                    end += 1
                if len(words("\n".join(lines[k:end]))) < least:
                    drop -= set(range(k, end))
        out.append((i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in drop), len(lines), len(drop)))
    return sorted(out, key=str)


def passages(df):
    return sorted((tuple(r) for r in dedup_passages(df).collect()), key=str)


def test_passages_of_any_length_go_whole(spark):
    rnd = random.Random(3)
    rows = []
    for n in range(2, 8):
        passage = [f"shared {n} {k} with more words" for k in range(n)]
        for j in range(6):
            rows.append((10 * n + j, "\n".join([f"own {rnd.random()}", *passage, f"own {rnd.random()}"])))
    rows += [(1, None), (2, ""), (3, "\n\n\n\n"), (4, "a\nb\nc\nd"), (5, "a\nb\nc\nd"), (6, "x\n" * 20_000), (7, "a\r\nb\n"), (8, "b\nx\na\nb")]
    got = passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got == without_earlier_runs(rows)
    assert all(r[3] == (r[0] // 10 if r[0] % 10 else 0) for r in got if r[0] >= 20)
    assert {r[1] for r in got if r[0] in (4, 5)} == {"a\nb\nc\nd"}


def test_passages_of_real_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert passages(df) == without_earlier_runs([tuple(r) for r in df.collect()])
    plan = dedup_passages(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_rows_without_an_id_lose_their_own_repeats_only(spark):
    shared = [f"shared {k}" for k in range(12)]
    clean = "\n".join(f"clean {k}" for k in range(40))
    rows = [(None, "\n".join([f"own {j} {k}" for k in range(3)] + shared)) for j in range(2)] + [(None, clean), (None, clean), (7, "a\nb"), (7, "c\nd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r["text"] for r in dedup_passages(df).collect()]
    assert got.count(clean) == 1 and {"a\nb", "c\nd"} <= set(got)
    assert got.count("") == 1 and sum("shared" in x for x in got) == 1 and sum("own" in x for x in got) == 2
