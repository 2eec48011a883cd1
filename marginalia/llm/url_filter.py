"""URL filtering with dated lists: every capture is judged by the entries that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import broadcast_if_small
from marginalia.scratch import written

#: Everything later than any capture.
FOREVER = "9999-12-31 00:00:00"


def host(url: Column) -> Column:
    """Host of a URL in lower case, without user, port, ``www.`` and a dot at the end; empty if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(found), r"\.+$", ""), r"^www\.", "")


def suffixes(name: Column) -> Column:
    """A host and the domains above it, longest first (``a.b.c`` -> ``a.b.c``, ``b.c``, ``c``)."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """``domain, category, valid_from, valid_to`` from dated entries ``domain, category, action, at``.

    ``add`` opens an entry and ``remove`` closes it, until the next dated line for the same domain and
    category. Of lines with the same date the removal counts. Lines with a null field or another action say
    nothing, repeated ones nothing new.
    """
    lines = (
        entries.where("domain IS NOT NULL AND category IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
        .groupBy(F.lower("domain").alias("domain"), "category", "at")
        .agg(F.max("action").alias("action"))
    )
    after = F.lead("at").over(Window.partitionBy("domain", "category").orderBy("at"))
    return (
        lines.withColumn("valid_to", F.coalesce(after, F.lit(FOREVER).cast("timestamp")))
        .where("action = 'add'")
        .select("domain", "category", F.col("at").alias("valid_from"), "valid_to")
    )


def judge_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``captures`` (an id, ``url``, ``fetched_at``) with ``host``, ``categories``, ``matched_domain``, ``blocked``.

    An entry for a domain holds for all hosts below it. ``categories`` are the sorted ones active at
    ``fetched_at`` (from the entry's first instant up to, not including, its last); ``matched_domain`` is the
    longest domain of those. Null or unusable URLs and null times match nothing. Rows alike in id, url and time
    are judged alike. Columns named as the new ones are replaced; tables may be empty.
    """
    own = [c for c in captures.columns if c not in ("host", "categories", "matched_domain", "blocked")]
    # the caller's columns in one struct: no name of theirs meets one of ours
    rows = captures.select(F.struct(*own).alias("row"), "fetched_at", host(F.col("url")).alias("host"))
    # a host's entries are found once for the host, however many captures it has
    hosts = rows.where("host <> ''").select("host").distinct()
    above = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("domain"))
    active = written(above.join(validity(entries), "domain").select(F.col("host").alias("listed"), "domain", "category", "valid_from", "valid_to"))
    # as-of: the changes of a host's standing in time order, so that a capture has one interval, not many
    times = active.select("listed", F.explode(F.array("valid_from", "valid_to")).alias("since")).distinct()
    until = F.lead("since").over(Window.partitionBy("listed").orderBy("since"))
    spans = times.withColumn("until", until).where("until IS NOT NULL")
    standing = written(
        spans.join(active, "listed")
        .where("valid_from <= since AND since < valid_to")
        .groupBy("listed", "since", "until")
        .agg(
            F.array_sort(F.collect_set("category")).alias("categories"),
            F.max(F.struct(F.length("domain"), "domain")).alias("longest"),
        )
    )
    match = (F.col("host") == F.col("listed")) & (F.col("fetched_at") >= F.col("since")) & (F.col("fetched_at") < F.col("until"))
    none = F.array().cast("array<string>")
    return rows.join(broadcast_if_small(standing), match, "left").select(
        *[F.col("row")[c].alias(c) for c in own],
        "host",
        F.coalesce("categories", none).alias("categories"),
        F.col("longest.domain").alias("matched_domain"),
        F.col("categories").isNotNull().alias("blocked"),
    )
