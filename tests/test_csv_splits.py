"""CSV in splits equals the one-task reader, wherever the edges of splits fall."""

import random

import pytest

from marginalia.plans import registry
from marginalia.sources import csv_splits, files

HEADER = "Title,publishedDate,authors,publisher,categories"
BITS = ["a", 'say ""so""', ", ", "\n", "\r\n", '""', "é", "\n\n", "日本", "x" * 40, "\r", "  "]


def csv_text(rnd, n, end):
    def field():
        text = "".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 4)))
        # quotes around whatever needs them, and around some that don't
        return f'"{text}"' if rnd.random() < 0.3 or any(c in text for c in ',"\r\n') else text

    lines = [HEADER] + [",".join([f"t{k}", *[field() for _ in range(4)]]) for k in range(n)]
    for at in sorted(rnd.sample(range(1, len(lines)), min(3, n)), reverse=True):
        lines.insert(at, "")  # empty lines are no records
    return end.join(lines) + rnd.choice(["", end])


def one_task(spark, path):
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False).collect()
    return [tuple(r) for r in rows]


@pytest.mark.parametrize(("seed", "end", "width", "chunk"), [(1, "\n", 7, 5), (2, "\r\n", 13, 4096), (3, "\n", 64, 64), (4, "\r\n", 100_000, 11), (5, "\r\n", 5, 2)])
def test_equals_the_one_task_reader(spark, tmp_path, seed, end, width, chunk):
    rnd = random.Random(seed)
    want = []
    for k in range(2):
        (tmp_path / f"{k} x.csv").write_text(csv_text(rnd, 8 if width < 20 else 60, end), newline="")
        want += one_task(spark, f"file://{tmp_path}/{k} x.csv")
    (tmp_path / "2 header alone.csv").write_text(HEADER)
    df = csv_splits.read(spark, f"file://{tmp_path}", split_bytes=width, chunk_bytes=chunk)
    got = sorted(map(tuple, df.collect()))
    assert [r[0] for r in got] == list(range(len(want)))
    assert [r[1:] for r in got] == want


def test_one_file_in_many_tasks(spark, tmp_path):
    rnd = random.Random(9)
    (tmp_path / "b.csv").write_text(csv_text(rnd, 20_000, "\n"), newline="")
    df = csv_splits.read(spark, f"file://{tmp_path}/b.csv", split_bytes=40_000)
    assert df.rdd.getNumPartitions() > 10
    rows = files.books(spark, f"file://{tmp_path}/b.csv").orderBy("row_id").collect()
    assert [r["title"] for r in rows] == [r[0] for r in one_task(spark, f"file://{tmp_path}/b.csv")]


def test_an_open_quote_and_files_that_cannot_be_split(spark, tmp_path):
    import gzip

    (tmp_path / "bad.csv").write_text(HEADER + '\na,"b\n')
    with pytest.raises(ValueError, match="quote is open"):
        csv_splits.read(spark, f"file://{tmp_path}/bad.csv")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write(HEADER + '\nt,2001,"[\'A\nB\']",p,c\n')
    assert csv_splits.read(spark, f"file://{tmp_path}/c.csv.gz") is None
    assert not csv_splits.splittable([("viewfs://store/in/x.csv", 5)])
    (row,) = files.books(spark, f"file://{tmp_path}/c.csv.gz").collect()
    assert (row["title"], row["authors"], row["year"]) == ("t", ["A\nB"], 2001)


@pytest.mark.parametrize(("name", "folder", "width"), [("source_reviews_csv", "reviews", 40_000), ("source_books_csv", "books", 2_000)])
def test_written_files_grow_in_number_alone(spark, sf_dir, tmp_path, monkeypatch, name, folder, width):
    want = sorted(map(tuple, registry.QUERIES[name](spark, sf_dir).collect()))
    monkeypatch.setattr(files, "FILE_BYTES", width)
    monkeypatch.setattr(registry.incremental, "folder", lambda _: f"file://{tmp_path}")
    assert sorted(map(tuple, registry.QUERIES[name](spark, sf_dir).collect())) == want
    sizes = [f.stat().st_size for f in (tmp_path / folder).glob("part-*.csv")]
    assert len(sizes) >= sum(sizes) / width / 2 > 3 and max(sizes) < 5 * width
