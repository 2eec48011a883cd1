"""Ranked lexical search, term at a time over short lists and document at a time over long ones.

The index holds each document's size and its counts of the terms that are asked for. A part of the documents is searched
block by block. In a block, the short lists of an item are summed up, a term at a time, in accumulators; these are then one
more iterator, with bounds like those of a list. It goes with the long lists through the documents in order: stretches of
documents, and in them single ones, are skipped where the bounds of what isn't looked up yet can't reach the score that
the item's worst result so far has.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import small_batches
from marginalia.scratch import written

#: Documents searched at once, documents of one stretch, and stretches looked up at once.
BLOCK, STRETCH, STEP = 8192, 64, 16
#: Lists of a block with fewer documents than its part of this are summed up term at a time.
SHORT = 1 / 32
#: Items searched by one pass over the index, and their different terms at most, about; more items take more passes.
ITEMS, TERMS = 5000, 200_000
#: Ways that an item's results of all parts are dealt before they are ranked together.
SALTS = 32
#: A term, after A to Z became lower case: the same in Spark's functions and by bytes.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Upper case becomes lower, other letters, digits and all bytes of characters beyond ASCII stay, the rest parts terms.
_FOLD = bytes(c if c in _KEPT or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order: runs of ASCII letters and digits, in lower case, and of whatever isn't ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Queries:
    """Items of one pass: names, and their terms as numbers of ``vocabulary``, in descending weight."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    term_lists: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[int | None, list[str]]]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        lists = [np.array([vocabulary.setdefault(t.encode(), len(vocabulary)) for t in words], np.int64) for _, words in rows]
        return cls([i for i, _ in rows], vocabulary, lists)


@dataclass
class Weights:
    """What the statistics of all documents give: the documents with terms, all terms, and the weight of each term asked for."""

    documents: int
    total: int
    of_term: np.ndarray


class _Block:
    """Lists of some documents, by term, with each posting's part of a score."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: Weights) -> None:
        self.ids = ids
        m = 50 + 50 * sizes * weights.documents // max(weights.total, 1)
        order = np.argsort(term, kind="stable")  # documents of a term stay in order
        term, self.doc, tf = term[order], owner[order], tf[order]
        self.part = weights.of_term[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[self.doc]))
        self.terms, begins = np.unique(term, return_index=True)
        self.span = dict(zip(self.terms.tolist(), zip(begins.tolist(), [*begins[1:].tolist(), len(term)], strict=True), strict=True))
        self.stretches = -(-len(ids) // STRETCH)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.span[term]
        return self.doc[a:b], self.part[a:b]

    def bounds(self, doc: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The most that a list adds to a document of each stretch."""
        out = np.zeros(self.stretches, np.int64)
        np.maximum.at(out, doc // STRETCH, part)
        return out


class _Best:
    """The best documents of an item so far, ties by id; ``floor`` is what a document must reach to be one of them."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.floor = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        worth = scores >= self.floor
        if not worth.any():
            return
        scores, ids = np.concatenate([self.scores, scores[worth]]), np.concatenate([self.ids, ids[worth]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.floor = max(1, int(self.scores[-1]))


def search_block(block: _Block, wanted: np.ndarray, best: _Best, bounds: dict[int, np.ndarray]) -> int:
    """Offer what a block has for one item; returns how many postings of long lists were looked up."""
    present = [t for t in wanted.tolist() if t in block.span]
    lists = sorted(((block.span[t][1] - block.span[t][0], t) for t in present), key=lambda x: x[0])
    limit = max(1, int(len(block.ids) * SHORT))
    short = [block.postings(t) for n, t in lists if n < limit]
    long = [t for n, t in lists if n >= limit]
    if short:
        docs = np.concatenate([d for d, _ in short])
        held, back = np.unique(docs, return_inverse=True)
        sums = np.zeros(len(held), np.int64)
        np.add.at(sums, back.ravel(), np.concatenate([p for _, p in short]))
    else:
        held, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not long:
        best.offer(sums, block.ids[held])
        return 0
    for t in long:
        if t not in bounds:
            bounds[t] = block.bounds(*block.postings(t))
    long.sort(key=lambda t: -int(bounds[t].max()))
    each = np.stack([bounds[t] for t in long])
    rest = np.cumsum(each[::-1], axis=0)[::-1]  # by the lists from here on
    looked = 0
    # a start for the floor: the accumulators that the short lists make largest
    if len(held) > best.k and best.floor == 1:
        largest = np.sort(np.argpartition(-sums, best.k)[: best.k])
        looked += _score(block, held[largest], sums[largest], long, rest, best, offer=False)
    reach = rest[0] + block.bounds(held, sums)
    alive = np.flatnonzero(reach >= best.floor)
    for at in range(0, len(alive), STEP):
        some = alive[at : at + STEP]
        some = some[reach[some] >= best.floor]
        if not len(some):
            continue
        chosen = np.zeros(block.stretches, bool)
        chosen[some] = True
        mine = chosen[held // STRETCH]
        docs, partial = held[mine], sums[mine]
        # documents without an accumulator, where the long lists alone may do
        open_ = some[rest[0][some] >= best.floor]
        if len(open_):
            fresh = np.setdiff1d((open_[:, None] * STRETCH + np.arange(STRETCH)).ravel(), docs, assume_unique=True)
            fresh = fresh[fresh < len(block.ids)]
            docs, partial = np.concatenate([docs, fresh]), np.concatenate([partial, np.zeros(len(fresh), np.int64)])
        looked += _score(block, docs, partial, long, rest, best)
    return looked


def _score(block: _Block, docs: np.ndarray, partial: np.ndarray, long: list[int], rest: np.ndarray, best: _Best, offer: bool = True) -> int:
    """Add the long lists, from the one with most to give on, for documents that may still reach the floor."""
    looked = 0
    for k, t in enumerate(long):
        may = partial + rest[k][docs // STRETCH] >= best.floor
        docs, partial = docs[may], partial[may]
        if not len(docs):
            return looked
        mine, part = block.postings(t)
        at = np.minimum(np.searchsorted(mine, docs), len(mine) - 1)
        partial = partial + np.where(mine[at] == docs, part[at], 0)
        looked += len(docs)
    if offer:
        best.offer(partial, block.ids[docs])
    elif len(partial) >= best.k:
        best.floor = max(best.floor, int(np.sort(partial)[-best.k]))
    return looked


#: Stands for no id: it comes after all ids.
_NO_ID = np.iinfo(np.int64).max


def search_part(batches: Iterator[pd.DataFrame], queries: Queries, weights: Weights, k: int) -> Iterator[pd.DataFrame]:
    """The best documents of each item among those of a part: ``item`` (its number), ``doc_id, score``."""
    best = [_Best(k) for _ in queries.ids]

    def search(frames: list[pd.DataFrame]) -> None:
        rows = pd.concat(frames)
        has = rows[rows["terms"].map(len) > 0]
        if not len(has):
            return
        lengths = has["terms"].map(len).to_numpy()
        ids = has["doc_id"].astype("Int64").fillna(_NO_ID).to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owner = np.repeat(place, lengths)
        by_doc = np.argsort(owner, kind="stable")
        term, tf = (np.concatenate(has[c].tolist()).astype(np.int64)[by_doc] for c in ("terms", "tfs"))
        block = _Block(ids[order], has["n"].to_numpy(np.int64)[order], owner[by_doc], term, tf, weights)
        bounds: dict[int, np.ndarray] = {}
        for wanted, mine in zip(queries.term_lists, best, strict=True):
            search_block(block, wanted, mine, bounds)

    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= BLOCK:
            search(held)
            held = []
    if held:
        search(held)
    found = [(i, d, s) for i, b in enumerate(best) for d, s in zip(b.ids.tolist(), b.scores.tolist(), strict=True)]
    yield pd.DataFrame(found, columns=["item", "doc_id", "score"])


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row for each document with a term: ``doc_id``, its number ``n`` of terms, and ``terms, tfs`` of those in ``vocabulary``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = terms(text)
                if words:
                    mine = sorted((number[t], c) for t, c in Counter(words).items() if t in number)
                    rows.append((None if pd.isna(doc_id) else int(doc_id), len(words), [t for t, _ in mine], [c for _, c in mine]))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "terms", "tfs"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(count, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def _passes(items: DataFrame) -> Iterator[Queries]:
    """Items with their different terms, so many at a time."""
    folded = F.translate("text", _UPPER, _UPPER.lower())
    words = written(
        items.select(F.col("item_id").cast("bigint").alias("item_id"), F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("term"))
        .groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    )
    rows: list[tuple[int | None, list[str]]] = []
    for row in words.toLocalIterator():
        rows.append((row["item_id"], row["terms"]))
        if len(rows) >= ITEMS or sum(len(t) for _, t in rows) >= TERMS:
            yield Queries.of(rows)
            rows = []
    if rows:
        yield Queries.of(rows)


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Each item's ``k`` best documents: ``item_id, rank, doc_id, score``; only scores above 0, ties to the smaller ``doc_id``.

    Whole texts count. Null or empty texts have no terms: such documents aren't found, nor counted, and such items have
    no rows. Rows under one ``doc_id`` are documents of their own; a document without an id counts, and comes after others
    of its score. Items under one ``item_id`` (null too) are one item with the terms of all. Other columns are not read.
    Empty tables give an empty result. Weights come from the statistics of all documents; every 5000 items, or as many as
    have 200,000 terms, take one pass over the documents, whatever their number.
    """
    spark = docs.sparkSession
    results: DataFrame | None = None
    for queries in _passes(items):
        index = written(forward_index(docs, queries.vocabulary))
        documents, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        counted = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # no more rows than terms asked for
        weight = np.zeros(len(queries.vocabulary), np.int64)
        for term, df in counted:
            weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        shared = spark.sparkContext.broadcast((queries, Weights(documents, total, weight)))

        def part(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            return search_part(batches, *shared.value, k)

        names = spark.createDataFrame(list(enumerate(queries.ids)), "item int, item_id bigint")
        found = index.mapInPandas(part, "item int, doc_id bigint, score bigint")
        ranked = _ranked(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), k, "item", "salt")
        ranked = _ranked(ranked, k, "item").withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))
        named = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        results = named if results is None else results.unionByName(named)
    if results is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return results


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)
