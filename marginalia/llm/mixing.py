"""Mixing sources to target weights by Pareto order sampling.

A source whose target is m times its size gives every document floor(m) certain whole copies. What is left of
the target is filled by one more copy of some documents: they are ranked by random odds divided by inclusion
odds (Pareto order sampling), and the ranking is cut where the words reach the target. The inclusion odds are
unequal: they grow with the square root of a document's size relative to its source's mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import WORD, broadcast_if_small
from marginalia.scratch import written

#: Weights by place of the source in code point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more than so many times.
MOST_COPIES = 3
#: A source's ranking is cut into bins of BIN_DOCS documents, or of about the root of their number if that is
#: more; only the bin in which the target is reached is ranked document by document.
BIN_DOCS = 1000
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, n, target`` from ``source, source_size, n`` (one row a source).

    All sizes are shared by weight; a source never gets more than ``most`` times its size, and what it can't
    take is shared among the others again. That ends at one level: with the sources in order of size over
    weight, the ones before the first that can take its share are full. One row a source is all this ranks.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(w).cast("bigint") for w in weights]), F.pmod(place, F.lit(len(weights))))
    before = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    up_to = before.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    level = (
        sizes.withColumn("w", weight)
        .withColumn("left_size", F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(up_to), F.lit(0)))
        .withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(up_to), F.lit(0)))
        .withColumn("full", F.col("source_size") * most * F.col("left_w") < F.col("w") * F.col("left_size"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.struct(-F.col("source_size") / F.col("w"), F.col("left_size") / F.col("left_w")))).over(every)["col2"])
    )
    return level.select(
        "source",
        "source_size",
        "n",
        F.when(F.col("full"), F.col("source_size").cast("double") * most).otherwise(F.col("w") * F.col("level")).alias("target"),
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``docs`` (``doc_id, source``, and ``text`` or else its ``size``) and ``size, source_size, target, copies, taken``.

    ``taken = size * copies``; the sum of a source's ``taken`` is its target but for less than one document.
    Null and empty texts have size 0 and are taken like the others, for 0 words. Null sources are one source,
    the last. The random numbers are hashes of the ids, so reruns agree; rows alike in id, source and size
    are taken or left together. Columns named as the new ones are replaced, others pass; tables may be empty.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    size = word_count(F.col("text")) if "text" in docs.columns else F.coalesce("size", F.lit(0)).cast("bigint")
    # the caller's columns in one struct: no name of theirs meets one of ours
    rows = docs.select(F.struct(*own).alias("row"), "doc_id", "source", size.alias("size"))
    units = written(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")).withColumn("words", F.col("size") * F.col("rows")))
    sizes = units.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("n"))
    goals = (
        written(source_targets(sizes, weights, most))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)))
        .withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("bins", F.least(F.ceil(F.col("n") / BIN_DOCS), F.ceil(F.sqrt(F.col("n")))))
        .withColumnRenamed("source", "s")
    )
    n_sources = goals.count()
    random = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{SEED}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    tilt = F.sqrt(F.col("size") * F.col("n") / F.greatest(F.col("source_size"), F.lit(1)))
    share = F.least(F.col("goal") / F.greatest(F.col("source_size"), F.lit(1)), F.lit(0.999999))
    odds = F.when(F.col("size") == 0, F.lit(None)).otherwise(tilt * share / (1 - share))
    ranked = (
        units.join(broadcast_if_small(goals, n_sources), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("u", random)
        .withColumn("rank", F.when((F.col("size") > 0) & (share > 0), F.col("u") / (1 - F.col("u")) / odds))
        # uniform between 0 and 1, about, and in the order of the ranks
        .withColumn("even", F.col("rank") * share / (1 - share) / (1 + F.col("rank") * share / (1 - share)))
        .withColumn("bin", F.floor(F.col("even") * F.col("bins")))
        .select("doc_id", "source", "size", "words", "whole", "goal", "rank", "bin")
    )
    by_bin = ranked.where("rank IS NOT NULL").groupBy("source", "bin").agg(F.sum("words").alias("w"), F.first("goal").alias("goal"))
    up = Window.partitionBy("source").orderBy("bin")
    cut = written(
        by_bin.withColumn("reached", F.sum("w").over(up))
        .where("reached > goal")
        .groupBy(F.col("source").alias("s"))
        .agg(F.min(F.struct("bin", F.col("reached") - F.col("w"))).alias("c"))
        .select("s", F.col("c.bin").alias("cut_bin"), F.col("c.col2").alias("below"))
    )
    marked = ranked.join(broadcast_if_small(cut, n_sources), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    edge = F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    clear = marked.where(~edge).withColumn(
        "more", F.col("rank").isNotNull() & (F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")))
    )
    within = _fill(marked.where(edge).withColumn("gap", F.col("goal") - F.col("below")))
    cols = ["doc_id", "source", "size", (F.col("whole") + F.col("more").cast("bigint")).cast("bigint").alias("copies")]
    copies = written(clear.select(*cols).union(within.select(*cols)))
    joined = rows.alias("r").join(
        copies.alias("c"),
        F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.size") == F.col("c.size")),
    )
    out = joined.select("r.row", "r.source", "r.size", "c.copies").join(
        broadcast_if_small(goals.select("s", "source_size", "target"), n_sources), F.col("source").eqNullSafe(F.col("s"))
    )
    return out.select(
        *[F.col("row")[c].alias(c) for c in own], "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def _fill(edge: DataFrame, rounds: int = 3) -> DataFrame:
    """``edge`` with ``more``: of the documents of each source's last bin, in rank order, those that fill ``gap``.

    The first round takes them up to the one that no longer fits; each later one goes over the rest that would
    fit what is left; the last one takes one that overshoots if that is nearer the target.
    """
    w = Window.partitionBy("source")
    order = ["rank", "doc_id", "size"]
    out = edge.withColumn("more", F.lit(False)).withColumn("left", F.col("gap"))
    for k in range(rounds):
        open_ = (~F.col("more")) & (F.col("words") <= F.col("left")) if k else F.lit(True)
        run = Window.partitionBy("source", "open").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = (
            out.withColumn("open", open_)
            .withColumn("run", F.sum("words").over(run))
            .withColumn("more", F.col("more") | (F.col("open") & (F.col("run") <= F.col("left"))))
            .withColumn("left", F.col("gap") - F.sum(F.when(F.col("more"), F.col("words")).otherwise(0)).over(w))
        )
    # a document that is nearer to filling the rest than nothing is: the one whose size is nearest to it
    miss = F.when(~F.col("more"), F.struct(F.abs(F.col("words") - F.col("left")).alias("miss"), "rank", "doc_id", "size"))
    least = F.min(miss).over(w)
    last = (~F.col("more")) & (least["miss"] < F.col("left")) & F.struct(F.abs(F.col("words") - F.col("left")).alias("miss"), "rank", "doc_id", "size").eqNullSafe(least)
    return out.withColumn("more", F.col("more") | last)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    wanted = mix(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", "text"), weights, most)
    again = wanted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest("copies", F.lit(1).cast("bigint")))))
    return again.where("copies > 0").select("row.*")
