"""Jobs over files: ingest once, answer the five queries into result folders, hold results against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import aggregates
from marginalia.plans import catalogue
from marginalia.scratch import written
from marginalia.sources import files


def ingest(spark: SparkSession, books_csv: str, reviews_csv: str, folder: str) -> dict[str, int]:
    """Write both files as parquet, once, with row ids that stay; returns ``books, reviews, bad_year, bad_score``.

    All later reads are of parquet.
    """
    files.books(spark, books_csv).write.mode("overwrite").parquet(f"{folder}/books")
    files.reviews(spark, reviews_csv).write.mode("overwrite").parquet(f"{folder}/reviews")
    books, reviews = tables(spark, folder)
    counts = books.agg(F.count("*").alias("books"), F.count_if(F.col("year").isNull()).alias("bad_year")).first().asDict()
    return counts | reviews.agg(F.count("*").alias("reviews"), F.count_if(F.col("score").isNull()).alias("bad_score")).first().asDict()


def tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Books and reviews as ``ingest`` wrote them."""
    return spark.read.parquet(f"{folder}/books"), spark.read.parquet(f"{folder}/reviews")


def five_results(books: DataFrame, reviews: DataFrame, lexicon: DataFrame, min_reviews: int = 500, by: tuple[str, ...] = ()) -> dict[int, DataFrame]:
    """The rows of each query, by its number."""
    popular = written(catalogue.popular(books, reviews, min_reviews, by=by))  # both the third and the fourth query's
    return {
        1: catalogue.recent_by_keyword(books, by=by),
        2: catalogue.authors_by_decades(books, by=by),
        3: popular.select(*by, "title", "authors"),
        4: catalogue.best_of(popular, by=by),
        5: catalogue.best_sentiment(books, reviews, lexicon, by=by),
    }


def run(spark: SparkSession, folder: str, results: str, lexicon: DataFrame, min_reviews: int = 500) -> DataFrame:
    """Answer the five queries from an ingested folder into JSON lines; returns ``query, n`` as they were written."""
    answers = five_results(*tables(spark, folder), lexicon, min_reviews)
    for number, df in answers.items():
        files.write_result_lines(df, results, number)
    return aggregates.row_counts({f"q{number}": spark.read.text(f"{results}/query={number}") for number in answers})


def expected_titles(spark: SparkSession, *paths: str) -> DataFrame:
    """The set of titles that the expected results of several queries name."""
    every = files.golden_titles(spark, paths[0])
    for path in paths[1:]:
        every = every.unionByName(files.golden_titles(spark, path))
    return every.distinct()


def check(spark: SparkSession, result: str, expected: str) -> DataFrame:
    """``value, side``: lines that only the result (``+``) or only the expected file (``-``) has, in whatever order."""
    return aggregates.differences(spark.read.text(result), spark.read.text(expected))
