"""Line deduplication by content-defined chunks of lines, in DataFrame functions only.

Every line is hashed; a rolling hash over two neighbouring line hashes is taken at every line, and a chunk ends where it has a
local minimum. Where it ends depends on the lines around that place alone, so an inserted or lost line moves no other
boundary. A chunk of two lines or more whose hash occurs again is compared byte by byte, and is an anchor: from it the
repeated passage is followed line by line into the chunks before and after it.

A short passage may hold no whole chunk. What the anchors leave, with the outer lines of what they found, is therefore
completed by all pairs of lines that still follow each other, compared by bytes too. A pair's earliest place is never in a
passage that goes, so its inside needn't be looked at again, and together they cut every run of two lines or more that stands
at an earlier place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import WORD, broadcast_if_small
from marginalia.scratch import written

MULTIPLIER, MODULUS = 1_000_003, 4_294_967_291
#: Words that a repeated passage must have to go.
LEAST_WORDS = 10


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often (and in whatever lambda) it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def rolling(hashes: Column) -> Column:
    """At every line, a hash of it and the line before it."""
    return F.transform(
        hashes, lambda x, i: F.pmod(F.coalesce(F.get(hashes, i - 1), F.lit(0)) * MULTIPLIER + x, F.lit(MODULUS))
    )


def chunk_ends(rolled: Column) -> Column:
    """Indexes of the lines that end a chunk: local minima after the first line, and the last line."""
    last = F.size(rolled) - 1
    return F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (i == last)
        | ((i > 0) & (F.get(rolled, i) < F.get(rolled, i - 1)) & (F.get(rolled, i) <= F.get(rolled, i + 1))),
    )


def chunk_spans(lines: Column, whole: bool = True) -> Column:
    """Array of struct(begin, size, hash) of the chunks of two lines or more; with their text and the lines of the chunks beside them if ``whole``."""

    def cut(ends: Column) -> Column:
        def part(k: Column) -> tuple[Column, Column]:
            begin = F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
            return begin, F.coalesce(F.get(ends, k) - begin + 1, F.lit(0))

        def chunk(_: Column, k: Column) -> Column:
            (begin, size), (before, n_before), (after, n_after) = part(k), part(k - 1), part(k + 1)
            body = F.array_join(F.slice(lines, begin + 1, size), "\n")
            n_before = F.when(k > 0, n_before).otherwise(F.lit(0))
            beside = (F.reverse(F.slice(lines, before + 1, n_before)).alias("before"), F.slice(lines, after + 1, n_after).alias("after")) if whole else ()
            return _span(begin, size, body, whole, *beside)

        return F.filter(F.transform(ends, chunk), lambda x: x["size"] > 1)

    return _let(F.transform(lines, line_hash), lambda hashes: _let(rolling(hashes), lambda rolled: _let(chunk_ends(rolled), cut)))


def pair_spans(numbered: Column, whole: bool = True) -> Column:
    """Array of struct(begin, size, hash) of two lines (struct(at, line)) that follow each other, with their text if ``whole``."""

    def pair(x: Column, i: Column) -> Column:
        return _let(F.get(numbered, i), lambda first: F.when(x["at"] == first["at"] + 1, _span(first["at"], F.lit(2), F.concat(first["line"], F.lit("\n"), x["line"]), whole)))

    return F.filter(F.transform(F.slice(numbered, F.lit(2), F.size(numbered)), pair), lambda x: x.isNotNull())


def _span(begin: Column, size: Column, body: Column, whole: bool, *more: Column) -> Column:
    return F.struct(begin.alias("begin"), size.alias("size"), F.xxhash64(body).alias("hash"), *((body.alias("body"), *more) if whole else ()))


def _alike(a: Column, b: Column) -> Column:
    """How many elements two arrays have alike from their beginning on."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), F.lit(False)).cast("int")
    return F.when(differs > 0, differs - 1).otherwise(n)


def _suspects(rows: DataFrame, lines: Column, spans: Callable[..., Column]) -> DataFrame:
    """``id, key, at, size`` and the rest of the spans whose hash occurs in more than one place."""
    numbers = rows.select(F.explode(_let(lines, lambda x: spans(x, False))).alias("s")).groupBy("s.hash").agg(F.count("*").alias("n"))
    again = written(numbers.where("n > 1").select("hash"))
    # now with their bytes; texts are shuffled only where repeated hashes are too many to be sent to all
    return rows.select("id", "key", F.explode(_let(lines, lambda x: spans(x))).alias("s")).select("id", "key", "s.*").withColumnRenamed("begin", "at").join(broadcast_if_small(again), "hash", "left_semi")


def repeated_chunks(rows: DataFrame, lines: Column) -> DataFrame:
    """``key, begin, end``: chunks that stand at an earlier place, with as many lines before and after as stand there too."""
    suspects = written(_suspects(rows, lines, chunk_spans))
    place = F.struct("id", "key", "at")
    firsts = written(suspects.groupBy("hash", "body").agg(F.min_by(F.struct("key", "at", "before", "after"), place).alias("first")).select("hash", "body", "first.*"))
    first = firsts.select("hash", *[F.col(c).alias(f"first_{c}") for c in ("body", "key", "at", "before", "after")])
    # texts meet by a shuffle at every size; a hash that very many places have is split at run time
    met = suspects.join(first, "hash").where("body = first_body AND NOT (key = first_key AND at = first_at)")
    begin = F.col("at") - _alike(F.col("before"), F.col("first_before"))
    return met.select("key", begin.alias("begin"), (F.col("at") + F.col("size") + _alike(F.col("after"), F.col("first_after"))).alias("end"))


def repeated_pairs(rows: DataFrame, lines: Column) -> DataFrame:
    """``key, begin, end``: two lines each that stand at an earlier place."""
    suspects = written(_suspects(rows, lines, pair_spans))
    # partial minima absorb a pair that is everywhere; then places meet places, so no pair is a hot key
    firsts = suspects.groupBy("hash", "body").agg(F.min(F.struct("id", "key", "at")).alias("first")).select("first.key", "first.at")
    return suspects.select("key", "at").join(firsts, ["key", "at"], "left_anti").select("key", F.col("at").alias("begin"), (F.col("at") + 2).alias("end"))


def _islands(spans: DataFrame) -> DataFrame:
    """``key, gone``: spans of each row that touch or overlap put together, in order."""
    order = Window.partitionBy("key").orderBy("begin", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce((F.col("begin") > reached).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order))
    joined = marked.groupBy("key", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return joined.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", (F.col("end") - F.col("begin")).cast("int").alias("size")))).alias("gone"))


def _kept(lines: Column, gone: Column) -> Column:
    """The elements between the spans that go."""

    def between(k: Column) -> Column:
        before = F.get(gone, k - 1)
        begin = F.coalesce(before["begin"] + before["size"], F.lit(0))
        end = F.coalesce(F.get(gone, k)["begin"], F.size(lines))
        return F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), between))


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without lines in runs of two or more that stand at an earlier place; ``n_lines``, ``n_lines_removed`` long.

    Runs in a row with fewer words than ``least_words`` in all, such as blank lines and braces, stay. Places are ordered by id
    (null first) and place in the text; every different line stays where it comes first. A null text stays null with 0
    lines; an empty one is one empty line; lines and texts may be of any length. A text of which every line went is empty.
    Rows that share an id, or have none, are documents of their own, ordered by a hash of their texts; of rows equal in id and
    text one counts as the first, and the others go whole if they have two lines or more, whatever their words. Other columns
    pass unchanged; an empty table gives an empty result.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_lines_removed")]
    others = [c for c in own if c not in (id_col, text_col)]
    name = F.col(id_col).cast("string")
    # of a row: rows equal in id and text share it, and only one of those is the first
    whole = F.concat(F.coalesce(F.concat(F.length(name), F.lit(":"), name), F.lit("none:")), F.coalesce(F.col(text_col), F.lit("")))
    # the caller's columns in one struct: no name of theirs meets one of ours
    rows = docs.select(F.struct(*own).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.unhex(F.sha2(whole, 256)).alias("key"))
    lines = F.split("text", "\n", -1)

    twin_keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("text").contains("\n")).alias("long")).where("n > 1 AND long").select("key")
    texts = rows.select("id", "key", "text").where(F.col("text").contains("\n"))
    chunks = repeated_chunks(texts, lines)
    found = written(_islands(chunks))
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("at"), line.alias("line")))
    n_found = found.agg(F.sum(F.size("gone"))).first()[0] or 0
    left = texts.join(broadcast_if_small(found, n_found), "key", "left")
    # the outer lines of what goes stay here, as a line beside them may belong to the same passage
    inner = F.transform(F.filter("gone", lambda x: x["size"] > 2), lambda x: F.struct((x["begin"] + 1).alias("begin"), (x["size"] - 2).alias("size")))
    rest = F.when(F.size("gone") > 0, _let(numbered, lambda x: _let(inner, lambda cut: _kept(x, cut)))).otherwise(numbered)
    pairs = repeated_pairs(left, rest)
    gone = written(_islands(pairs.unionByName(found.select("key", F.explode("gone").alias("s")).select("key", F.col("s.begin").alias("begin"), (F.col("s.begin") + F.col("s.size")).alias("end")))))
    n_gone = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    # texts are shuffled only where the spans that go are too many to be sent to all
    gone = broadcast_if_small(gone, n_gone)
    many = written(twin_keys)
    n_many = many.count()
    single = rows
    if n_many:
        single = rows.join(broadcast_if_small(many, n_many), "key", "left_anti")
        twins = rows.join(broadcast_if_small(many, n_many), "key", "left_semi")
        order = F.xxhash64(F.to_json(F.struct(*[F.col("row")[c].alias(c) for c in others]))) if others else F.lit(0)
        twins = written(twins.withColumn("place", F.struct(order.alias("h"), F.monotonically_increasing_id().alias("n"))))
        first = twins.groupBy("key").agg(F.min("place").alias("place")).withColumn("is_first", F.lit(True))
        twins = twins.join(first, ["key", "place"], "left")
    joined = single.join(gone, "key", "left").select("row", "text", "gone", F.lit(False).alias("copy"))
    if n_many:
        # a further copy repeats the first one as a whole
        copy = F.array(F.struct(F.lit(0).alias("begin"), F.size(lines).alias("size")))
        drop = F.when(F.col("is_first"), F.col("gone")).otherwise(copy)
        joined = joined.union(twins.join(gone, "key", "left").select("row", "text", drop.alias("gone"), F.col("is_first").isNull().alias("copy")))

    def large(lines: Column) -> Column:
        return F.filter("gone", lambda x: F.col("copy") | (F.regexp_count(F.array_join(F.slice(lines, x["begin"] + 1, x["size"]), "\n"), F.lit(WORD)) >= least_words))

    edited = _let(
        lines,
        lambda lines: _let(
            _let(large(lines), lambda gone: _kept(lines, gone)),
            lambda kept: F.struct(F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).cast("bigint").alias("removed")),
        ),
    )
    n_lines = F.regexp_count("text", F.lit("\n")) + 1
    zero = F.lit(0).cast("bigint")
    return joined.withColumn("edit", F.when(F.size("gone") > 0, edited)).select(
        *[F.coalesce("edit.text", "text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in own],
        F.coalesce(n_lines.cast("bigint"), zero).alias("n_lines"),
        F.coalesce("edit.removed", zero).alias("n_lines_removed"),
    )
