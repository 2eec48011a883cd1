"""The five end-to-end queries over books and reviews, the reduction of a data set, and the check of a result.

``by`` names columns that both tables have, such as ``session_id``: each of their values then gets an answer of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.parsing import decade
from marginalia.operators import aggregates, filters, joins, text
from marginalia.scratch import written

Keys = tuple[str, ...]


def columns_for_queries(books: DataFrame) -> dict[str, DataFrame]:
    """What each query needs of the books: by title and year (1, 3, 4), by decade (2), by category (5)."""
    return {
        "by_year": books.drop("row_id"),
        "by_decade": books.select(decade(F.col("year")).alias("decade"), "authors"),
        "by_category": books.select("title", "categories"),
    }


def recent_by_keyword(books: DataFrame, category: str = "Computers", keyword: str = "distributed", low: int = 2000, high: int = 2023, by: Keys = ()) -> DataFrame:
    """Q1: ``title, publisher`` of a category's books of some years with a keyword in the title."""
    found = filters.in_range(books, "year", low, high)
    return filters.has_element(filters.has_keyword(found, "title", keyword), "categories", category).select(*by, "title", "publisher")


def authors_by_decades(books: DataFrame, n: int = 10, drop_unknown: bool = False, by: Keys = ()) -> DataFrame:
    """Q2: authors with books in at least n decades. An unknown year is decade 0, which counts unless dropped."""
    dated = books.withColumn("decade", decade(F.col("year")))
    if drop_unknown:
        dated = dated.where("year <> 0")
    each = aggregates.exploded(dated, "authors", "author", *by, "decade")
    return aggregates.at_least(aggregates.distinct_per_key(each, F.col("decade"), *by, "author"), "n_distinct", n).select(*by, "author")


def popular(
    books: DataFrame, reviews: DataFrame, min_reviews: int = 500, low: int = 1990, high: int = 1999, by: Keys = (), scale: int | None = None
) -> DataFrame:
    """Q3: ``title, authors, average, n`` of some years' books with enough scores (a review without one doesn't count)."""
    keys = (*by, "title")
    # used twice: the books are scanned and deduplicated once
    items = written(joins.keep_last(filters.in_range(books, "year", low, high), "row_id", *keys).select(*keys, "authors"))
    rated = aggregates.average(joins.with_items(reviews.select(*keys, "score"), items.select(*keys), *keys), "score", *keys, scale=scale)
    return joins.with_items(aggregates.at_least(rated, "n", min_reviews), items, *keys).select(*keys, "authors", "average", "n")


def best(books: DataFrame, reviews: DataFrame, n: int = 10, by: Keys = (), **params) -> DataFrame:
    """Q4: ``title, average`` of the best rated among the popular ones."""
    return best_of(popular(books, reviews, by=by, **params), n, by)


def best_of(found: DataFrame, n: int = 10, by: Keys = ()) -> DataFrame:
    """Q4 from the rows of Q3."""
    return aggregates.top_n(found, "average", "title", n, by).select(*by, "title", "average")


def best_sentiment(
    books: DataFrame,
    reviews: DataFrame,
    lexicon: DataFrame,
    category: str = "Fiction",
    quantile: int = 90,
    by: Keys = (),
    scale: int | None = None,
    review_id: str = "review_id",
) -> DataFrame:
    """Q5: ``title, average`` of a category's books above a quantile of mean review sentiment."""
    keys = (*by, "title")
    items = joins.keep_last(filters.has_element(books, "categories", category), "row_id", *keys).select(*keys)
    mine = joins.with_items(reviews.select(*keys, review_id, "text"), items, *keys)
    scored = text.with_polarity(mine, lexicon, "text", review_id)
    means = aggregates.average(scored, "sentiment", *keys, scale=scale).select(*keys, "average")
    return aggregates.top_fraction(means, "average", "title", quantile, by=by)


def reduced(books: DataFrame, reviews: DataFrame, titles: DataFrame, authors: DataFrame, extra: int) -> tuple[DataFrame, DataFrame]:
    """The books that expected results name, and ``extra`` more by the expected authors at most; and their reviews.

    A title that several books have counts once, and frees the others' places for more books by the authors.
    """
    known = filters.drop_missing(books, "authors")
    by_title = joins.semi(known, titles.distinct(), "title")
    first = joins.keep_first(by_title, ("row_id",), "title")
    by_author = joins.keep_first(filters.overlaps(known, "authors", authors.distinct(), "row_id"), ("row_id",), "title")
    others = by_author.join(first.select("title"), "title", "left_anti").select(*first.columns)
    places = by_title.count() - first.count() + extra
    kept = first.unionByName(aggregates.head(others, places, "row_id"))
    return kept, joins.semi(reviews, kept.select("title"), "title")
