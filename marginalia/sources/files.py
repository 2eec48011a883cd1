"""Sources and sinks: catalogue and review files, incremental reading, result lines."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import parsing
from marginalia.sources import csv_splits

BOOK_FIELDS = {"Title": "title", "publishedDate": "published", "authors": "authors", "publisher": "publisher", "categories": "categories"}
REVIEW_FIELDS = {"Title": "title", "review/score": "score", "review/text": "text"}

#: Rows of a file that is dealt for a stream, and bytes of a CSV file's values, about.
FILE_ROWS, FILE_BYTES = 500_000, 64 << 20


def _csv(spark: SparkSession, path: str, fields: dict[str, str], row_id: str) -> DataFrame:
    """A row id and text fields by header name; empty fields, and all of a name that the header lacks, are "".

    Quotes are doubled inside quotes, lines may break there: files are read in splits all the same (``csv_splits``), but for
    compressed ones and those in stores that only Spark opens, which take one task each.
    """
    raw = csv_splits.read(spark, path)
    if raw is None:
        whole = spark.read.csv(path, header=True, inferSchema=False, **csv_splits.DIALECT)
        raw = whole.select(F.monotonically_increasing_id().alias("row_id"), "*")
    found = [F.col(f"`{a}`") if a in raw.columns else F.lit(None).cast("string") for a in fields]
    return raw.select(F.col("row_id").alias(row_id), *[c.alias(b) for c, b in zip(found, fields.values(), strict=True)]).fillna("")


def books(spark: SparkSession, path: str) -> DataFrame:
    """``row_id, title, year, authors, publisher, categories``. ``row_id`` follows the order of the file."""
    return _csv(spark, path, BOOK_FIELDS, "row_id").select(
        "row_id",
        "title",
        parsing.parse_year(F.col("published")).alias("year"),
        parsing.parse_list(F.col("authors")).alias("authors"),
        "publisher",
        parsing.parse_categories(F.col("categories")).alias("categories"),
    )


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """``review_id, title, score, text``."""
    return _csv(spark, path, REVIEW_FIELDS, "review_id").select("review_id", "title", parsing.score(F.col("score")).alias("score"), "text")


def incremental(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int = 1) -> DataFrame:
    """A stream of the files of a folder, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def write_waves(df: DataFrame, path: str, wave: str, waves: int, by: str, rows: int) -> int:
    """Deal rows to JSON files for a stream, by the wave (a column from 0 to ``waves`` - 1) and a hash of ``by``; neither column is written.

    Returns the files of a wave, for ``incremental`` to take in a batch: there are as many as ``rows`` (of all waves) ask for,
    so neither a writing task nor a file grows with the table, and the number of batches doesn't either.
    """
    each = max(1, ceil(rows / (waves * FILE_ROWS)))
    place = F.col(wave) * each + F.pmod(F.hash(by), F.lit(each))
    df.repartitionById(waves * each, place.cast("int")).drop(wave, by).write.mode("append").json(path)
    return each


def write_result_lines(df: DataFrame, folder: str, query: int) -> None:
    """A query's rows as JSON lines in its own folder; what was there goes."""
    df.write.mode("overwrite").json(f"{folder}/query={query}")


def write_result_batches(stream: DataFrame, folder: str, query: int, state: str) -> None:
    """Append a stream's rows to a query's folder as JSON lines, each batch in a folder of its own; run again, it goes on.

    A batch is written beside its place and moved there whole. One that is run again after a crash, because it was written but
    not yet noted as done, takes its own earlier place: so each row is there once.
    """
    spark, top = stream.sparkSession, f"{folder}/query={query}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path

    def write(batch: DataFrame, number: int) -> None:
        made, place = fs_path(f"{top}/_making-{number}"), fs_path(f"{top}/batch={number}")
        batch.write.mode("overwrite").json(made.toString())
        fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(place, True)
        if not fs.rename(made, place):
            raise OSError(f"could not move {made.toString()}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def read_result_batches(spark: SparkSession, folder: str, query: int, schema) -> DataFrame:
    """What ``write_result_batches`` finished; batches that are being made aren't seen."""
    return spark.read.schema(schema).json(f"{folder}/query={query}/batch=*")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_csv_in_order(df: DataFrame, path: str, order: str, least: int = 3) -> None:
    """``df`` in ranges of ``order``, which isn't written: its rows are in that order within the files and by the files' names.

    There are as many files as the bytes of the values ask for, and at least ``least``, so none grows with the table.
    """
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("bigint") for c in df.columns]
    held = df.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0] or 0
    write_csv(df.repartitionByRange(max(least, ceil(held / FILE_BYTES)), order).sortWithinPartitions(order).drop(order), path)


def golden_titles(spark: SparkSession, path: str) -> DataFrame:
    """Titles of expected result lines ``{"title": ...}``."""
    return spark.read.text(path).select(F.get_json_object("value", "$.title").alias("title")).where("title IS NOT NULL")


def golden_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of expected result lines that are one quoted string each."""
    return spark.read.text(path).select(F.regexp_replace(F.trim("value"), '^"+|"+$', "").alias("author"))
