"""All registered queries of the library over the driver's tables, and their SQL.

``part`` plays the catalogue (its words are authors and categories), ``lineitem`` and ``documents`` the reviews,
``orders`` dated works of an author and ``events`` the stream. The five queries and the reduction read ``part`` and
``lineitem`` or ``documents`` through views that are shaped as books and reviews.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import parsing
from marginalia.operators import aggregates, filters, joins, text
from marginalia.plans import catalogue
from marginalia.sources import files
from marginalia.streaming import incremental, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Words and polarities of the registered sentiment queries.
LEXICON = (("the", 0.5), ("of", -0.25), ("and", 0.25))
_LEXICON_SQL = "(VALUES ('the', 0.5), ('of', -0.25), ('and', 0.25)) AS lex(word, polarity)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(spark, d) -> DataFrame:
    return _t(spark, d, "part").withColumn("words", F.split("p_name", " "))


def _lexicon(spark) -> DataFrame:
    return spark.createDataFrame(LEXICON, "word string, polarity double")


def _rated(spark, d, low=10, high=19) -> DataFrame:
    items = filters.in_range(_t(spark, d, "part"), "p_size", low, high).select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    return joins.with_items(_t(spark, d, "lineitem"), items, "l_partkey")


# --- books and reviews, by the same expressions in both engines but for their arrays

_YEARS = "CASE p_partkey % 11 WHEN 0 THEN 0 ELSE 1940 + p_size END"
_BOOKS_SQL = f"""books AS (SELECT p_partkey AS row_id, concat('Book ', p_partkey % 1300) AS title, p_partkey % 3 AS session_id, {_YEARS} AS year,
 string_split(p_name, ' ') AS authors, p_brand AS publisher, [p_type, split_part(p_name, ' ', 2)] AS categories FROM part)"""
_SCORE = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity / 8 END"
_REVIEWS_SQL = f"reviews AS (SELECT concat('Book ', l_partkey % 1300) AS title, l_suppkey % 3 AS session_id, {_SCORE} AS score FROM lineitem)"
_TEXTS_SQL = "reviews AS (SELECT doc_id AS review_id, concat('Book ', doc_id % 150) AS title, doc_id % 3 AS session_id, text FROM documents)"


def _books(spark, d) -> DataFrame:
    return _t(spark, d, "part").select(
        F.col("p_partkey").alias("row_id"), F.expr("concat('Book ', p_partkey % 1300)").alias("title"), F.expr("p_partkey % 3").alias("session_id"),
        F.expr(_YEARS).alias("year"), F.split("p_name", " ").alias("authors"), F.col("p_brand").alias("publisher"),
        F.array(F.col("p_type"), F.get(F.split("p_name", " "), F.lit(1))).alias("categories"),
    )


def _reviews(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").selectExpr("concat('Book ', l_partkey % 1300) AS title", "l_suppkey % 3 AS session_id", f"{_SCORE} AS score")


def _texts(spark, d) -> DataFrame:
    return _t(spark, d, "documents").selectExpr("doc_id AS review_id", "concat('Book ', doc_id % 150) AS title", "doc_id % 3 AS session_id", "text")


# --- fields: messy texts are made of the tables' values by the same expression in both engines

_YEAR = """CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN concat(CAST(year(o_orderdate) AS STRING), '*')
 WHEN 2 THEN concat(substr(CAST(year(o_orderdate) AS STRING), 1, 2), '??') WHEN 3 THEN 'undated'
 WHEN 4 THEN concat(CAST(year(o_orderdate) AS STRING), '-01-02') ELSE CAST(year(o_orderdate) AS STRING) END"""
_LIST = """CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('[''', replace(p_name, ' ', ''', '''), ''']')
 WHEN 2 THEN concat('["', p_name, '"]') WHEN 3 THEN concat('[''', p_name, ''', "O''', p_type, '"]') ELSE concat('[''', p_name, ', ', p_brand, ''']') END"""
_CATEGORIES = """CASE p_partkey % 3 WHEN 0 THEN concat('[''', replace(p_name, ' ', ' & '), ''']') WHEN 1 THEN concat('["', p_name, '"]') ELSE '' END"""


@query(f"""SELECT o_orderkey, CASE WHEN t = '' THEN 0 ELSE TRY_CAST(split_part(replace(replace(t, '*', ''), '?', '0'), '-', 1) AS INTEGER) END AS year
 FROM (SELECT o_orderkey, {_YEAR} AS t FROM orders)""")
def scalar_parse_year(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", parsing.parse_year(F.expr(_YEAR)).alias("year"))


@query(f"""SELECT p_partkey, array_to_string(string_split(CASE WHEN contains(b, '"') THEN replace(b, '"', '') ELSE replace(b, '''', '') END, ','), '|') AS names,
 len(string_split(b, ',')) AS n FROM (SELECT p_partkey, replace(replace(replace(replace(replace({_LIST}, '"[', ''), ']"', ''), '[', ''), ']', ''), ', ', ',') AS b FROM part)""")
def scalar_parse_list(spark, d):
    names = _t(spark, d, "part").select("p_partkey", parsing.parse_list(F.expr(_LIST)).alias("a"))
    return names.select("p_partkey", F.array_join("a", "|").alias("names"), F.size("a").cast("bigint").alias("n"))


@query(f"""SELECT p_partkey, array_to_string(string_split(replace(replace({_CATEGORIES}, '[''', ''), ''']', ''), ' & '), '|') AS categories FROM part""")
def scalar_parse_categories(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.array_join(parsing.parse_categories(F.expr(_CATEGORIES)), "|").alias("categories"))


@query("SELECT p_partkey, p_size - p_size % 10 AS decade FROM part")
def scalar_decade_bucket(spark, d):
    return _t(spark, d, "part").select("p_partkey", parsing.decade(F.col("p_size")).alias("decade"))


@query("""SELECT l_orderkey, l_linenumber, TRY_CAST(CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE CAST(l_quantity AS STRING) END AS DOUBLE) AS score FROM lineitem""")
def scalar_score_cast(spark, d):
    raw = F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_quantity").cast("string"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", parsing.score(raw).alias("score"))


@query("SELECT p_partkey, p_name || '|' || 'O''' || p_type AS names FROM part")
def scalar_list_literal(spark, d):
    raw = F.concat(F.lit("['"), F.col("p_name"), F.lit("', \"O'"), F.col("p_type"), F.lit('"]'))
    return _t(spark, d, "part").select("p_partkey", F.array_join(parsing.list_literal(raw), "|").alias("names"))


@query(f"""WITH {_BOOKS_SQL} SELECT 'by_year' AS part, title, year AS n FROM books UNION ALL SELECT 'by_decade', authors[1], year - year % 10 FROM books
 UNION ALL SELECT 'by_category', title, len(categories) FROM books""")
def fanout_projection(spark, d):
    out = catalogue.columns_for_queries(_books(spark, d))
    shown = {"by_year": ("title", "year"), "by_decade": ("authors[0]", "decade"), "by_category": ("title", "size(categories)")}
    one, two, three = (out[k].selectExpr(f"'{k}' AS part", f"{a} AS title", f"CAST({b} AS BIGINT) AS n") for k, (a, b) in shown.items())
    return one.unionByName(two).unionByName(three)


@query()
def map_rows(spark, d):
    return aggregates.average(_rated(spark, d), "l_quantity", "p_name", scale=2).select(F.create_map("p_name", "average").alias("row"))


# --- filters


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 20 AND 43")
def filter_range_recent(spark, d):
    return filters.in_range(_t(spark, d, "part"), "p_size", 20, 43).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 19")
def filter_range_nineties(spark, d):
    return filters.in_range(_t(spark, d, "part"), "p_size", 10, 19).select("p_partkey", "p_size")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%widget%'")
def filter_keyword_ci(spark, d):
    return filters.has_keyword(_t(spark, d, "part"), "p_name", "WidGet").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')")
def filter_array_contains(spark, d):
    return filters.has_element(_words(spark, d), "words", "ring").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'blue')")
def filter_array_contains_2(spark, d):
    return filters.has_element(_words(spark, d), "words", "blue").select("p_partkey", "p_name")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 35")
def having_min_count(spark, d):
    return aggregates.at_least(aggregates.sum_count(_t(spark, d, "lineitem"), "l_quantity", "l_partkey"), "n", 35).select("l_partkey", "n")


@query("SELECT o_custkey, count(DISTINCT year(o_orderdate)) AS n_distinct FROM orders GROUP BY 1 HAVING count(DISTINCT year(o_orderdate)) >= 6")
def having_min_distinct(spark, d):
    return aggregates.at_least(aggregates.distinct_per_key(_t(spark, d, "orders"), F.year("o_orderdate"), "o_custkey"), "n_distinct", 6)


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 OR event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 5 END AS route FROM events")
def route_by_tag(spark, d):
    first = F.when((F.col("user_id") % 2 == 0) | (F.col("event_type") == "click"), 1)
    tags = F.array(F.when(F.col("event_type") == "view", 5), first)
    return _t(spark, d, "events").select("event_id", F.coalesce(filters.route(F.array_compact(tags), [1, 5]), F.lit(None).cast("int")).alias("route"))


@query("SELECT p_partkey, p_name FROM part WHERE p_size >= 10")
def filter_dropna(spark, d):
    return filters.drop_missing(_t(spark, d, "part").withColumn("words", F.when(F.col("p_size") >= 10, F.split("p_name", " "))), "words").select("p_partkey", "p_name")


@query("""SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM (SELECT split_part(p_name, ' ', 2) AS w FROM part WHERE p_partkey IN (3, 5)) x
 WHERE list_contains(string_split(part.p_name, ' '), x.w))""")
def filter_list_overlap(spark, d):
    wanted = _t(spark, d, "part").where("p_partkey IN (3, 5)").select(F.get(F.split("p_name", " "), F.lit(1)).alias("w")).distinct()
    return filters.overlaps(_words(spark, d), "words", wanted, "p_partkey").select("p_partkey", "p_name")


# --- joins and deduplication


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size BETWEEN 10 AND 19")
def join_inner_title(spark, d):
    return _rated(spark, d).select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) r FROM part) WHERE r = 1")
def dedup_keep_last(spark, d):
    return joins.keep_last(_t(spark, d, "part"), "p_partkey", "p_name").select("p_name", "p_partkey", "p_brand")


@query("SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey) r FROM part) WHERE r = 1")
def dedup_keep_first(spark, d):
    return joins.keep_first(_t(spark, d, "part"), ("p_size", "p_partkey"), "p_name").select("p_name", "p_partkey", "p_brand")


@query("""SELECT g AS query_group, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN
 (SELECT 'popular' AS g, p_partkey FROM part WHERE p_size BETWEEN 10 AND 19 UNION ALL SELECT 'fiction', p_partkey FROM part WHERE p_type = 'PROMO') ON l_partkey = p_partkey""")
def join_multi_group(spark, d):
    part = _t(spark, d, "part").withColumn("l_partkey", F.col("p_partkey"))
    groups = {"popular": filters.in_range(part, "p_size", 10, 19).select("l_partkey"), "fiction": part.where("p_type = 'PROMO'").select("l_partkey")}
    return joins.with_item_groups(_t(spark, d, "lineitem"), groups, "l_partkey").select("query_group", "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def join_semi(spark, d):
    return joins.semi(_t(spark, d, "documents").select("doc_id", "lang", "source"), _t(spark, d, "labels").select("doc_id"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_shuffle_hash(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return joins.shuffled(_t(spark, d, "lineitem"), orders, "l_orderkey").select("l_orderkey", "l_linenumber", "o_custkey")


_HOT = "CASE WHEN l_orderkey % 2 = 0 THEN 1 WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_partkey END"


@query(f"SELECT l_orderkey, l_linenumber, k AS p_partkey, p_name FROM (SELECT l_orderkey, l_linenumber, {_HOT} AS k FROM lineitem) JOIN part ON k = p_partkey")
def join_hot_title(spark, d):
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_HOT).alias("p_partkey"))
    return joins.with_items_split(lines, _t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", spread=("l_orderkey", "l_linenumber"))


@query("""SELECT p_brand, p_type, n, count(*) AS n_parts FROM part JOIN (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) USING (p_brand, p_type)
 GROUP BY 1, 2, 3""")
def join_hot_pair(spark, d):
    part = _t(spark, d, "part")
    counts = part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    joined = joins.with_items_split(part.select("p_partkey", "p_brand", "p_type"), counts, "p_brand", "p_type", hint="shuffle_hash")
    return joined.groupBy("p_brand", "p_type", "n").agg(F.count("*").alias("n_parts"))


# --- aggregates


@query("SELECT w AS word, p_partkey FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w <> ''")
def explode_nonempty(spark, d):
    return aggregates.exploded(_words(spark, d), "words", "word", "p_partkey").select("word", "p_partkey")


@query("SELECT w AS word, count(DISTINCT dec) AS n_distinct FROM (SELECT p_size - p_size % 10 AS dec, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def distinct_periods_per_key(spark, d):
    dated = _words(spark, d).withColumn("dec", parsing.decade(F.col("p_size")))
    return aggregates.distinct_per_key(aggregates.exploded(dated, "words", "word", "dec"), F.col("dec"), "word")


# some values are null, and they have four decimals
_REVENUE = "CASE WHEN l_linenumber = 3 OR l_partkey % 50 = 7 THEN NULL ELSE l_extendedprice * l_discount END"


def _revenues(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").withColumn("v", F.expr(_REVENUE))


@query(f"SELECT l_partkey, CAST(sum(CAST(v AS DECIMAL(22,4))) AS DOUBLE) AS total, count(v) AS n FROM (SELECT *, {_REVENUE} AS v FROM lineitem) GROUP BY 1")
def agg_sum_count_by_key(spark, d):
    return aggregates.sum_count(_revenues(spark, d), "v", "l_partkey", scale=4)


@query(f"""SELECT l_partkey, CASE WHEN count(v) > 0 THEN CAST(sum(CAST(v AS DECIMAL(22,4))) AS DOUBLE) / count(v) END AS average, count(v) AS n
 FROM (SELECT *, {_REVENUE} AS v FROM lineitem) GROUP BY 1""")
def agg_avg_by_key(spark, d):
    return aggregates.average(_revenues(spark, d), "v", "l_partkey", scale=4)


@query(f"""SELECT o_custkey % 7 AS session_id, l_partkey, CAST(sum(CAST(v AS DECIMAL(22,4))) AS DOUBLE) AS total, count(v) AS n
 FROM (SELECT *, {_REVENUE} AS v FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def agg_per_session(spark, d):
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7).alias("session_id"))
    return aggregates.sum_count(_revenues(spark, d).join(orders, "l_orderkey"), "v", "session_id", "l_partkey", scale=4)


@query("""SELECT 'q1' AS query, count(*) AS n FROM part WHERE p_size BETWEEN 10 AND 40 UNION ALL SELECT 'q3', count(*) FROM part WHERE p_size BETWEEN 10 AND 19
 UNION ALL SELECT 'none', 0""")
def result_counts(spark, d):
    part = _t(spark, d, "part")
    ranges = {"q1": (10, 40), "q3": (10, 19), "none": (60, 70)}
    return aggregates.row_counts({name: filters.in_range(part, "p_size", low, high) for name, (low, high) in ranges.items()})


@query("SELECT event_type, CAST(sum(user_id) AS BIGINT) AS user_id FROM events GROUP BY 1")
def keyed_merge_sum(spark, d):
    return aggregates.merged(_t(spark, d, "events"), "event_type", "user_id")


@query("SELECT l_partkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average FROM lineitem GROUP BY 1 ORDER BY average DESC, l_partkey LIMIT 10")
def top_n_by_avg(spark, d):
    return aggregates.top_n(aggregates.average(_t(spark, d, "lineitem"), "l_quantity", "l_partkey", scale=2), "average", "l_partkey", 10).select("l_partkey", "average")


_FRACTION = """SELECT l_partkey, average FROM (SELECT *, row_number() OVER (ORDER BY average DESC, l_partkey) r, count(*) OVER () c FROM
 (SELECT l_partkey, CAST(sum(CAST({v} AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS average FROM lineitem {j} GROUP BY 1)) WHERE r <= c // 10"""


@query(_FRACTION.format(v="l_quantity", j=""))
def top_fraction_by_avg(spark, d):
    return aggregates.top_fraction(aggregates.average(_t(spark, d, "lineitem"), "l_quantity", "l_partkey", scale=2).drop("n"), "average", "l_partkey")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 50")
def limit_head(spark, d):
    return aggregates.head(_t(spark, d, "part"), 50, "p_partkey").select("p_partkey", "p_name")


@query("SELECT event_type, max(value) AS value FROM events GROUP BY 1")
def keyed_merge_max(spark, d):
    return aggregates.merged_by(_t(spark, d, "events"), "event_type", "value", max)


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def keyed_merge_in_order(spark, d):
    named = _t(spark, d, "orders").withColumn("orders", F.col("o_orderkey").cast("string"))
    return aggregates.merged_by(named, "o_custkey", "orders", lambda a, b: f"{a},{b}", order="o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE len(list_intersect(string_split(p_name, ' '), (SELECT list(p_name) FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS p_name FROM part WHERE p_partkey % 50 = 3)))) > 0")
def filter_list_overlap_large(spark, d):
    wanted = _t(spark, d, "part").where("p_partkey % 50 = 3").select(F.get(F.split("p_name", " "), F.lit(1)).alias("w"))
    every = wanted.unionByName(_t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("w")))
    return filters.overlaps(_words(spark, d), "words", every, "p_partkey").select("p_partkey", "p_name")


# --- sets


@query("SELECT p_name FROM part WHERE p_size < 20 UNION ALL SELECT p_name FROM part WHERE p_size > 10")
def union_all(spark, d):
    part = _t(spark, d, "part")
    return part.where("p_size < 20").select("p_name").unionByName(part.where("p_size > 10").select("p_name"))


@query("SELECT p_name FROM part WHERE p_size < 20 UNION SELECT p_name FROM part WHERE p_size > 10")
def union_distinct(spark, d):
    return union_all(spark, d).distinct()


@query("""(SELECT p_name, '+' AS side FROM (SELECT p_name FROM part WHERE p_size < 30 EXCEPT ALL SELECT p_name FROM part WHERE p_size > 10)) UNION ALL
 (SELECT p_name, '-' FROM (SELECT p_name FROM part WHERE p_size > 10 EXCEPT ALL SELECT p_name FROM part WHERE p_size < 30))""")
def diff_except_all(spark, d):
    part = _t(spark, d, "part")
    return aggregates.differences(part.where("p_size < 30").select("p_name"), part.where("p_size > 10").select("p_name"))


# --- sentiment

_POLARITY = f"""SELECT d.doc_id, d.source, coalesce(s.v, 0.0) AS sentiment FROM documents d LEFT JOIN
 (SELECT doc_id, sum(polarity) / count(*) AS v FROM
 (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) JOIN {_LEXICON_SQL} USING (word) GROUP BY 1) s USING (doc_id)"""


@query(f"SELECT doc_id, sentiment FROM ({_POLARITY})")
def sentiment_lexicon(spark, d):
    return text.polarity(_t(spark, d, "documents"), _lexicon(spark), "text", "doc_id")


@query(f"SELECT source, CAST(sum(CAST(sentiment AS DECIMAL(27,9))) AS DOUBLE) / count(*) AS average FROM ({_POLARITY}) GROUP BY 1")
def agg_sentiment_by_key(spark, d):
    scored = text.with_polarity(_t(spark, d, "documents").select("doc_id", "source", "text"), _lexicon(spark), "text", "doc_id")
    return aggregates.average(scored, "sentiment", "source", scale=9).select("source", "average")


@query("""SELECT d.doc_id, coalesce(s.v, 0.0) AS sentiment FROM documents d LEFT JOIN (SELECT doc_id,
 sum(CASE WHEN prev IN ('in', 'is') THEN polarity * -0.5 ELSE polarity END) / count(*) AS v FROM
 (SELECT doc_id, word, lag(word) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM
 (SELECT doc_id, string_split_regex(lower(text), '[^a-z]+') AS w FROM documents)) WHERE word <> '') JOIN """ + _LEXICON_SQL + """ USING (word) GROUP BY 1) s USING (doc_id)""")
def sentiment_negation(spark, d):
    return text.polarity(_t(spark, d, "documents"), _lexicon(spark), "text", "doc_id", ["in", "is"])


_WORD_ROWS = """SELECT doc_id, word, pos, CASE word WHEN 'to' THEN 1.5 WHEN 'a' THEN 0.75 WHEN 'in' THEN -0.5 WHEN 'is' THEN -0.5 END::DOUBLE AS factor FROM
 (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, string_split_regex(lower(text), '[^a-z]+') AS w FROM documents)) WHERE word <> ''"""


@query(f"""WITH runs AS (SELECT *, coalesce(sum((factor IS NULL)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM ({_WORD_ROWS})),
 chains AS (SELECT doc_id, run, coalesce(product(factor), 1) AS factor, any_value(word) FILTER (factor IS NULL) AS word FROM runs GROUP BY 1, 2),
 hits AS (SELECT doc_id, sum(greatest(-1, least(1, polarity::DOUBLE * factor))) / count(*) AS v FROM chains JOIN {_LEXICON_SQL} USING (word) GROUP BY 1)
 SELECT doc_id, round(coalesce(v, 0.0), 9) AS sentiment FROM documents LEFT JOIN hits USING (doc_id)""")
def sentiment_intensity(spark, d):
    scored = text.with_intensity(_t(spark, d, "documents").select("doc_id", "text"), _lexicon(spark), "text", {"to": 1.5, "a": 0.75}, ["in", "is"])
    return scored.select("doc_id", F.round("sentiment", 9).alias("sentiment"))


# --- streams


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, d):
    events = incremental.read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    once = incremental.delivered_once(events.unionByName(events), ["event_id"], "ts")
    return incremental.run_appending(once.select("event_id", "user_id", "event_type"), incremental.folder(spark))


@query("""SELECT user_id, CAST(sum(CAST(v AS DECIMAL(22,4))) AS DOUBLE) AS total, count(v) AS n FROM
 (SELECT user_id, CASE WHEN event_type <> 'error' THEN value / 4 END AS v FROM events) GROUP BY 1""")
def stream_agg_by_key(spark, d):
    scored = incremental.read_table(spark, d, "events").withColumn("v", F.expr("CASE WHEN event_type <> 'error' THEN value / 4 END"))
    return incremental.run_complete(incremental.sums_per_key(scored, "user_id", "v", scale=4), incremental.folder(spark))


@query("SELECT user_id, count(DISTINCT event_type) AS n_distinct FROM events GROUP BY 1")
def stream_distinct_per_key(spark, d):
    return incremental.run_complete(incremental.distinct_per_key(incremental.read_table(spark, d, "events"), "user_id", F.col("event_type")), incremental.folder(spark))


@query("SELECT p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def stream_static_join(spark, d):
    items = _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    joined = incremental.read_table(spark, d, "lineitem").join(items, "l_partkey")
    return incremental.run_complete(joined.groupBy("p_type").agg(F.count("*").alias("n")), incremental.folder(spark))


@query("SELECT event_id, event_type, value FROM events WHERE event_type <> 'error'")
def incremental_source(spark, d):
    top = incremental.folder(spark)
    _t(spark, d, "events").select("event_id", "event_type", "value").write.json(f"{top}/in")
    found = files.incremental(spark, f"{top}/in", "event_id bigint, event_type string, value double").where("event_type <> 'error'")
    return incremental.run_appending(found, top)


def _numbered(spark, d) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint")
    return _t(spark, d, "events").select("user_id", number.alias("number"), "event_id", "event_type")


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number, event_id, event_type FROM events")
def stream_once_by_sender(spark, d):
    top = incremental.folder(spark)
    # files out of order, of which the last ones repeat a third of the messages
    sent = _numbered(spark, d).withColumn("file", F.pmod(F.xxhash64("event_id"), F.lit(3)).cast("int"))
    again = sent.where("number % 3 = 0").withColumn("file", F.lit(3))
    every = sent.unionByName(again).withColumn("deal", F.col("event_id"))
    each = files.write_waves(every, f"{top}/in", "file", 4, "deal", _t(spark, d, "events").count() * 4 // 3)
    stream = files.incremental(spark, f"{top}/in", "user_id bigint, number bigint, event_id bigint, event_type string", files_per_batch=each)
    return incremental.run_appending(stateful.once_by_sender(stream, "user_id", "number"), top)


@query(f"""WITH {_REVIEWS_SQL} SELECT session_id::VARCHAR AS session, title, CAST(sum(score) AS DOUBLE) AS total, count(score) AS n FROM reviews WHERE session_id < 2 GROUP BY 1, 2""")
def stream_session_results(spark, d):
    top = incremental.folder(spark)
    sent = _t(spark, d, "lineitem").selectExpr("l_suppkey % 3 AS session", "CAST(l_linenumber % 4 AS STRING) AS worker", "false AS ended", "concat('Book ', l_partkey % 1300) AS title", f"{_SCORE} AS score", "l_orderkey % 3 AS file", "l_orderkey AS deal")
    # the workers of two sessions say that they are at the end, after all rows; those of the third don't
    ends = spark.range(8).selectExpr("id % 2 AS session", "CAST(id div 2 AS STRING) AS worker", "true AS ended", "CAST(NULL AS STRING) AS title", "CAST(NULL AS DOUBLE) AS score").coalesce(1)
    each = files.write_waves(sent, f"{top}/in", "file", 3, "deal", _t(spark, d, "lineitem").count())
    ends.write.mode("append").json(f"{top}/in")
    stream = files.incremental(spark, f"{top}/in", "session bigint, worker string, ended boolean, title string, score double", files_per_batch=each)
    return incremental.run_appending(stateful.sums_of_ended_sessions(stream, 4), top)


@query("""WITH items AS (SELECT p_partkey % 2 AS session, p_name, max(p_partkey) AS p_partkey FROM part GROUP BY 1, 2)
 SELECT session::VARCHAR AS session, p_name, i.p_partkey, count(*) AS n FROM (SELECT l_orderkey % 2 AS session, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) JOIN items i USING (session, p_name) GROUP BY 1, 2, 3""")
def stream_join_when_built(spark, d):
    top = incremental.folder(spark)
    part, names = _t(spark, d, "part"), _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    items = part.selectExpr("p_partkey % 2 AS session", "CAST(p_partkey % 3 AS STRING) AS sender", "false AS ended", "p_name", "p_partkey", "p_partkey % 3 AS file", "p_partkey AS deal")
    item_ends = spark.range(6).selectExpr("id % 2 AS session", "CAST(id % 3 AS STRING) AS sender", "true AS ended", "CAST(NULL AS STRING) AS p_name", "CAST(NULL AS BIGINT) AS p_partkey").coalesce(1)
    reviews = _t(spark, d, "lineitem").join(names, "l_partkey").selectExpr("l_orderkey % 2 AS session", "'r' AS sender", "false AS ended", "p_name", "l_orderkey", "l_orderkey % 5 AS file", "l_orderkey AS deal")
    review_ends = spark.range(2).selectExpr("id AS session", "'r' AS sender", "true AS ended", "CAST(NULL AS STRING) AS p_name", "CAST(NULL AS BIGINT) AS l_orderkey").coalesce(1)
    each = {}
    for rows, ends, n, name, table in ((items, item_ends, 3, "items", "part"), (reviews, review_ends, 5, "reviews", "lineitem")):
        each[name] = files.write_waves(rows, f"{top}/{name}", "file", n, "deal", _t(spark, d, table).count())
        ends.write.mode("append").json(f"{top}/{name}")
    one = files.incremental(spark, f"{top}/items", "session bigint, sender string, ended boolean, p_name string, p_partkey bigint", files_per_batch=each["items"])
    two = files.incremental(spark, f"{top}/reviews", "session bigint, sender string, ended boolean, p_name string, l_orderkey bigint", files_per_batch=each["reviews"])
    met = incremental.run_appending(stateful.joined_when_built(one, two, "p_name", "p_partkey", 3), top)
    return met.groupBy("session", "p_name", "p_partkey").agg(F.count("*").alias("n"))


@query("""WITH signs AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS ms FROM events), ends AS (SELECT max(ms) AS over FROM signs),
 gaps AS (SELECT user_id, ms, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) AS next, over FROM signs, ends)
 SELECT user_id::VARCHAR AS member, ms, true AS silent FROM gaps WHERE coalesce(next, over) - ms >= 172800000 UNION ALL SELECT user_id::VARCHAR, next, false FROM gaps WHERE next - ms >= 172800000""")
def stream_silence_alarms(spark, d):
    signs = incremental.read_table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = incremental.run_appending(stateful.silence_alarms(signs, "user_id", "ts", 172_800), incremental.folder(spark))
    return found.select("member", F.unix_millis("at").alias("ms"), "silent")


@query(f"""WITH {_BOOKS_SQL} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, concat(title, chr(10), ' of "', publisher, '"') AS title, year, array_to_string(authors, '|') AS authors FROM books""")
def source_books_csv(spark, d):
    top = incremental.folder(spark)
    books = _books(spark, d).selectExpr(
        "row_id", "concat(title, '\n of \"', publisher, '\"') AS Title", "if(year = 0, '', concat(year, '-01')) AS publishedDate",
        "concat('[\\'', array_join(authors, '\\', \\''), '\\']') AS authors", "publisher", "concat('[\\'', array_join(categories, ' & '), '\\']') AS categories",
    )
    files.write_csv_in_order(books, f"{top}/books", "row_id")
    return files.books(spark, f"{top}/books").select("row_id", "title", "year", F.array_join("authors", "|").alias("authors"))


@query(f"WITH {_TEXTS_SQL} SELECT row_number() OVER (ORDER BY review_id) - 1 AS review_id, title, review_id % 5 + 0.5::DOUBLE AS score, coalesce(text, '') AS text FROM reviews")
def source_reviews_csv(spark, d):
    top = incremental.folder(spark)
    texts = _texts(spark, d).selectExpr("review_id", "title AS Title", "review_id % 5 + 0.5 AS `review/score`", "text AS `review/text`")
    files.write_csv_in_order(texts, f"{top}/reviews", "review_id")
    return files.reviews(spark, f"{top}/reviews")


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'view'")
def stream_result_batches(spark, d):
    top = incremental.folder(spark)
    found = incremental.read_table(spark, d, "events").where("event_type <> 'view'").select("event_id", "event_type")
    files.write_result_batches(found, f"{top}/results", 1, f"{top}/state")
    return files.read_result_batches(spark, f"{top}/results", 1, found.schema)


@query("SELECT user_id, before AS after, event_id - before - 1 AS missing FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_id - before > 1")
def sequence_gaps(spark, d):
    return incremental.sequence_gaps(_t(spark, d, "events"), "user_id", "event_id")


@query("SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS n_ended FROM events WHERE event_type = 'signup' GROUP BY 1 HAVING count(DISTINCT user_id) >= (SELECT count(*) // 30 // 6 FROM events)")
def eof_barrier(spark, d):
    events = _t(spark, d, "events")
    days = events.withColumn("day", F.to_date("ts"))
    return incremental.all_ended(days, ["day"], "user_id", F.col("event_type") == "signup", events.count() // 30 // 6)


@query("SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events")
def stream_in_order(spark, d):
    top = incremental.folder(spark)
    sent = _t(spark, d, "events").withColumn("number", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint"))
    # four waves of files, one a batch, in which each sender's numbers are out of order; the last ones come twice
    drawn = sent.withColumn("file", F.pmod(F.xxhash64("event_id"), F.lit(4)).cast("int"))
    again = drawn.where("number % 5 = 0").withColumn("file", F.lit(4))
    every = drawn.unionByName(again).select("file", "user_id", "number", "event_id", "event_type", F.col("event_id").alias("deal"))
    each = files.write_waves(every, f"{top}/in", "file", 5, "deal", _t(spark, d, "events").count() * 5 // 4)
    stream = files.incremental(spark, f"{top}/in", "user_id bigint, number bigint, event_id bigint, event_type string", files_per_batch=each)
    return incremental.run_appending(incremental.in_order(stream, "user_id", "number"), top)


@query("""SELECT c_custkey AS user_id FROM customer LEFT JOIN (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1) ON c_custkey = user_id
 WHERE last_seen IS NULL OR epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_seen) >= 86400000000""")
def heartbeat_timeout(spark, d):
    roster = _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return incremental.silent(roster, _t(spark, d, "events"), "user_id", "ts", now, 86_400).select("user_id")


# --- the five queries, for all and for each session

_Q1 = "FROM books WHERE year BETWEEN 1950 AND 1980 AND contains(lower(title), 'ook 1') AND list_contains(categories, 'ECONOMY')"
_Q2 = "FROM (SELECT session_id, year - year % 10 AS decade, unnest(authors) AS author FROM books) WHERE author <> ''"


def _q3(*by: str) -> str:
    b = "".join(f"{k}, " for k in by)
    return f"""items AS (SELECT {b}title, authors FROM (SELECT *, row_number() OVER (PARTITION BY {b}title ORDER BY row_id DESC) AS r FROM books WHERE year BETWEEN 1950 AND 1969) WHERE r = 1),
 rated AS (SELECT {b}title, CAST(sum(CAST(score AS DECIMAL(22,4))) AS DOUBLE) / count(score) AS average, count(score) AS n FROM reviews JOIN items USING ({b}title)
 GROUP BY {b}title HAVING count(score) >= {12 if by else 35})"""


def _q5(*by: str) -> str:
    b = "".join(f"{k}, " for k in by)
    over = f"PARTITION BY {by[0]} " if by else ""
    return f"""items AS (SELECT DISTINCT {b}title FROM books WHERE list_contains(categories, 'widget') OR list_contains(categories, 'PROMO')),
 scored AS (SELECT {b}title, coalesce(s.v, 0.0) AS sentiment FROM reviews JOIN items USING ({b}title) LEFT JOIN
 (SELECT review_id, sum(polarity) / count(*) AS v FROM (SELECT review_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM reviews) JOIN {_LEXICON_SQL} USING (word) GROUP BY 1) s USING (review_id)),
 means AS (SELECT {b}title, CAST(sum(CAST(sentiment AS DECIMAL(27,9))) AS DOUBLE) / count(*) AS average FROM scored GROUP BY {b}title)
 SELECT {b}title, average FROM (SELECT *, row_number() OVER ({over}ORDER BY average DESC, title) AS r, count(*) OVER ({over}) AS c FROM means) WHERE r <= c * 20 // 100"""


_SESSIONS = ("session_id",)


@query(f"WITH {_BOOKS_SQL} SELECT title, publisher {_Q1}")
def q1_range_keyword_category(spark, d):
    return catalogue.recent_by_keyword(_books(spark, d), "ECONOMY", "OOK 1", 1950, 1980)


@query(f"WITH {_BOOKS_SQL} SELECT session_id, title, publisher {_Q1}")
def q1_per_session(spark, d):
    return catalogue.recent_by_keyword(_books(spark, d), "ECONOMY", "OOK 1", 1950, 1980, by=_SESSIONS)


@query(f"WITH {_BOOKS_SQL} SELECT author {_Q2} GROUP BY 1 HAVING count(DISTINCT decade) >= 7")
def q2_distinct_periods(spark, d):
    return catalogue.authors_by_decades(_books(spark, d), 7)


@query(f"WITH {_BOOKS_SQL} SELECT session_id, author {_Q2} AND decade <> 0 GROUP BY 1, 2 HAVING count(DISTINCT decade) >= 6")
def q2_per_session(spark, d):
    return catalogue.authors_by_decades(_books(spark, d), 6, drop_unknown=True, by=_SESSIONS)


@query(f"WITH {_BOOKS_SQL}, {_REVIEWS_SQL}, {_q3()} SELECT title, array_to_string(authors, '|') AS authors, average, n FROM rated JOIN items USING (title)")
def q3_popular_in_range(spark, d):
    found = catalogue.popular(_books(spark, d), _reviews(spark, d), 35, 1950, 1969, scale=4)
    return found.withColumn("authors", F.array_join("authors", "|"))


@query(f"WITH {_BOOKS_SQL}, {_REVIEWS_SQL}, {_q3(*_SESSIONS)} SELECT session_id, title, array_to_string(authors, '|') AS authors, average, n FROM rated JOIN items USING (session_id, title)")
def q3_per_session(spark, d):
    found = catalogue.popular(_books(spark, d), _reviews(spark, d), 12, 1950, 1969, by=_SESSIONS, scale=4)
    return found.withColumn("authors", F.array_join("authors", "|"))


@query("""SELECT p_name, p_brand, n FROM (SELECT p_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size BETWEEN 10 AND 19 GROUP BY 1 HAVING count(*) >= 100)
 JOIN (SELECT p_name, max_by(p_brand, p_partkey) AS p_brand FROM part WHERE p_size BETWEEN 10 AND 19 GROUP BY 1) USING (p_name)""")
def q3_dedup_last(spark, d):
    items = joins.keep_last(filters.in_range(_t(spark, d, "part"), "p_size", 10, 19), "p_partkey", "p_name").select("p_name", "p_brand")
    counted = aggregates.sum_count(_rated(spark, d), "l_quantity", "p_name")
    return aggregates.at_least(counted, "n", 100).join(items, "p_name").select("p_name", "p_brand", "n")


@query(f"WITH {_BOOKS_SQL}, {_REVIEWS_SQL}, {_q3()} SELECT title, average FROM rated ORDER BY average DESC, title LIMIT 10")
def q4_top_n(spark, d):
    return catalogue.best(_books(spark, d), _reviews(spark, d), min_reviews=35, low=1950, high=1969, scale=4)


@query(f"""WITH {_BOOKS_SQL}, {_REVIEWS_SQL}, {_q3(*_SESSIONS)} SELECT session_id, title, average FROM
 (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY average DESC, title) AS r FROM rated) WHERE r <= 10""")
def q4_per_session(spark, d):
    return catalogue.best(_books(spark, d), _reviews(spark, d), by=_SESSIONS, min_reviews=12, low=1950, high=1969, scale=4)


def _fiction(spark, d) -> DataFrame:
    """Books with one category more, which Q5 asks for."""
    fiction = (F.array_contains("categories", "widget") | F.array_contains("categories", "PROMO"))
    return _books(spark, d).withColumn("categories", F.when(fiction, F.concat("categories", F.array(F.lit("Fiction")))).otherwise(F.col("categories")))


@query(f"WITH {_BOOKS_SQL}, {_TEXTS_SQL}, {_q5()}")
def q5_top_fraction(spark, d):
    return catalogue.best_sentiment(_fiction(spark, d), _texts(spark, d), _lexicon(spark), quantile=80, scale=9)


@query(f"WITH {_BOOKS_SQL}, {_TEXTS_SQL}, {_q5(*_SESSIONS)}")
def q5_per_session(spark, d):
    return catalogue.best_sentiment(_fiction(spark, d), _texts(spark, d), _lexicon(spark), quantile=80, by=_SESSIONS, scale=9)


# --- reduction of the data set

_REDUCED_SQL = f"""WITH {_BOOKS_SQL}, known AS (SELECT * FROM books WHERE year <> 0), named AS (SELECT * FROM known WHERE title IN (SELECT title FROM books WHERE row_id <= 60)),
 first AS (SELECT title, min(row_id) AS row_id FROM named GROUP BY 1),
 others AS (SELECT title, min(row_id) AS row_id FROM known WHERE list_contains(authors, (SELECT authors[1] FROM books WHERE row_id = 1)) AND title NOT IN (SELECT title FROM first) GROUP BY 1),
 kept AS (SELECT * FROM first UNION ALL (SELECT * FROM others ORDER BY row_id LIMIT (SELECT (SELECT count(*) FROM named) - (SELECT count(*) FROM first) + 25)))"""


def _reduce(spark, d) -> tuple[DataFrame, DataFrame]:
    books = _books(spark, d)
    titles = books.where("row_id <= 60").select("title")
    authors = books.where("row_id = 1").select(F.get("authors", F.lit(0)).alias("author"))
    # a book without a year has no authors either, as the reduction drops such books
    known = books.withColumn("authors", F.when(F.col("year") != 0, F.col("authors")))
    return catalogue.reduced(known, _reviews(spark, d), titles, authors, extra=25)


@query(f"{_REDUCED_SQL} SELECT row_id, title FROM kept")
def reduce_books(spark, d):
    return _reduce(spark, d)[0].select("row_id", "title")


@query(f"{_REDUCED_SQL}, {_REVIEWS_SQL} SELECT title, count(*) AS n FROM reviews WHERE title IN (SELECT title FROM kept) GROUP BY 1")
def reduce_reviews(spark, d):
    return _reduce(spark, d)[1].groupBy("title").agg(F.count("*").alias("n"))
