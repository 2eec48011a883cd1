"""Exact top-k search with multi-resolution segment statistics.

A vector is cut into segments, and each segment is kept as its mean and its deviation. By the Cauchy-Schwarz
inequality, the squared distance of two vectors is at least the sum over segments of
``length * ((mean difference)^2 + (deviation difference)^2)``. With means and deviations scaled by the root of the
length, that bounds their inner product from above by the inner product of their statistics. Bounds are taken over
a few long segments first, then over more and shorter ones; what still can reach the k best is computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import grouped
from marginalia.scratch import written

#: Shares of the vector's length: segments of each resolution, coarse to fine.
RESOLUTIONS = (1 / 16, 1 / 4, 1 / 2, 3 / 4)
#: Queries of a block, about; candidates of a block.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 1024
#: Query blocks are sent to all candidates if they hold no more components than this (16 MB); else both sides are dealt.
BROADCAST_NUMBERS = 2_000_000
#: Blocks that a task searches at once, where they come mixed.
OPEN_BLOCKS = 16
SCALE = 1024
LONG = (-(1 << 63), (1 << 63) - 1)


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Mean and deviation of each segment, times the root of its length."""
    n = vectors.shape[1]
    edges = np.linspace(0, n, min(segments, max(n, 1)) + 1).astype(int)
    out = np.zeros((len(vectors), 2 * (len(edges) - 1)))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = vectors[:, a:b]
        out[:, 2 * k] = part.mean(axis=1) * np.sqrt(b - a)
        if b - a > 1:
            out[:, 2 * k + 1] = part.std(axis=1) * np.sqrt(b - a)
    return out


def levels(vectors: np.ndarray) -> list[np.ndarray]:
    return [segment_statistics(vectors, max(1, round(share * vectors.shape[1]))) for share in RESOLUTIONS] if vectors.shape[1] else []


class Search:
    """The k best of each query so far, by score and then by smaller id."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.uids, self.ids, self.vectors, self.k = uids, ids, vectors, k
        self.levels, self.norms = levels(vectors), (vectors**2).sum(axis=1)
        self.pairs = self.exact = 0
        # by query: scores as far as they are known exactly, and ids; -inf where there is none yet
        self.scores = np.full((len(ids), k), -np.inf, object if self._huge(vectors) else float)
        self.best = np.full((len(ids), k), LONG[1], np.int64)

    @staticmethod
    def _huge(vectors: np.ndarray) -> bool:
        return bool(len(vectors)) and float(np.abs(vectors).max(initial=0)) > 1 << 24

    def offer(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        worst, at = self.scores[q, -1], self.best[q, -1]
        good = ((scores > worst) | ((scores == worst) & (ids < at))) & (ids != self.ids[q])
        q, ids, scores = q[good], ids[good], scores[good]
        if not len(q):
            return
        some = np.unique(q)
        q = np.concatenate([np.repeat(some, self.k), q])
        ids = np.concatenate([self.best[some].ravel(), ids])
        scores = np.concatenate([self.scores[some].ravel(), scores])
        order = np.lexsort((ids, -scores, q)) if scores.dtype != object else np.array(sorted(range(len(q)), key=lambda i: (q[i], -scores[i], ids[i])))
        q, ids, scores = q[order], ids[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.scores[q[kept], place[kept]], self.best[q[kept], place[kept]] = scores[kept], ids[kept]

    def _products(self, a: np.ndarray, b: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Inner products of the pairs; of all pairs at once where most are asked for."""
        if len(q) > 0.2 * len(a) * len(b):
            return (a @ b.T)[q, c]
        step = 1 << 16
        parts = [np.einsum("ij,ij->i", a[q[at : at + step]], b[c[at : at + step]]) for at in range(0, len(q), step)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _exact(self, vectors: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        self.exact += len(q)
        most = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
        if most < 1 << 53:  # every partial sum is a whole number that a double holds
            return self._products(self.vectors, vectors, q, c)
        mine, theirs = ([[int(x) for x in row] for row in side] for side in (self.vectors, vectors))
        sums = (sum(x * y for x, y in zip(mine[i], theirs[j], strict=True)) for i, j in zip(q.tolist(), c.tolist(), strict=True))
        return np.array([min(max(x, LONG[0]), LONG[1]) for x in sums], object)

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if self.scores.dtype != object and self._huge(vectors):
            self.scores = self.scores.astype(object)
        self.pairs += len(self.ids) * len(ids)
        margin = 1e-9 * (self.norms[:, None] + (vectors**2).sum(axis=1)[None, :]) + 1e-6
        q, c = (x.ravel() for x in np.indices((len(self.ids), len(ids))))
        bound = np.full(len(q), np.inf)
        for a, b in zip(self.levels, levels(vectors), strict=True):
            bound = np.nan_to_num(self._products(a, b, q, c) + margin[q, c], nan=np.inf)
            keep = bound >= self.scores[:, -1].astype(float)[q]
            q, c, bound = q[keep], c[keep], bound[keep]
        # the most promising of each query first: they raise the floor that prunes the rest
        order = np.lexsort((-bound, q))
        q, c, bound = q[order], c[order], bound[order]
        lead = np.arange(len(q)) - np.searchsorted(q, q) < 2 * self.k
        self.offer(q[lead], ids[c[lead]], self._exact(vectors, q[lead], c[lead]))
        keep = ~lead & (bound >= self.scores[:, -1].astype(float)[q])
        self.offer(q[keep], ids[c[keep]], self._exact(vectors, q[keep], c[keep]))

    def found(self) -> pd.DataFrame:
        i, j = np.nonzero(self.scores.astype(float) > -np.inf)
        scores = np.array([int(s) for s in self.scores[i, j]], np.int64)
        return pd.DataFrame({"uid": self.uids[i], "query_id": self.ids[i], "vec_id": self.best[i, j], "score": scores})


_BLOCK = "dim int, uids binary, ids binary, body binary"


def _usable(side: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
    return side.where(ok).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def _blocks(frame: pd.DataFrame, uids: pd.Series | None = None) -> pd.DataFrame:
    """Vectors of one frame as a block for each length: whole components floor(1024 * x), as doubles."""
    rows = []
    sizes = frame["v"].map(len).to_numpy()
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        body = np.floor(np.array(frame["v"].iloc[own].tolist(), float).reshape(len(own), n) * SCALE)
        rows.append((n, b"" if uids is None else uids.to_numpy()[own].tobytes(), frame["vec_id"].to_numpy()[own].tobytes(), body.tobytes()))
    return pd.DataFrame(rows, columns=["dim", "uids", "ids", "body"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of every query among ``vectors``.

    Both sides have ``vec_id, embedding``; a component x counts as floor(1024 * x). Rows with a null id, and vectors
    that are null or hold null or non-finite components, take no part; vectors of another length than the query's
    don't meet it, and no row with the query's own id does. Ties go to the smaller id, all are given if there are
    fewer than k. Scores beyond a long count as the nearest long. Repeated rows count as often as they stand there. Other
    columns are not read; tables may be empty.

    Vectors travel in blocks; each block of candidates meets each block of queries of its length. Few queries are
    sent to all candidates; many are dealt with them, so nothing goes through the driver but their number. Statistics
    are computed where two blocks meet, which is a small part of comparing them. A task leaves at most k rows for a
    query, so nothing but those is ranked.
    """
    asked = written(_usable(queries).withColumn("uid", F.monotonically_increasing_id()))
    n, numbers = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    count = max(1, -(-n // QUERY_BLOCK))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(count)).cast("int")).repartition("block").sortWithinPartitions("block")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in grouped(batches, ["block"]):
            found = _blocks(frame, frame["uid"])
            found.insert(0, "block", int(frame["block"].iloc[0]))
            yield found

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), CANDIDATE_BLOCK):
                yield _blocks(frame.iloc[at : at + CANDIDATE_BLOCK])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], Search] = {}
        for frame in batches:
            for row in frame.itertuples(index=False):
                key = (row.block, row.dim)
                if key not in held:
                    if len(held) >= OPEN_BLOCKS:
                        yield held.pop(next(iter(held))).found()
                    mine = [np.frombuffer(x, kind) for x, kind in ((row.uids, np.int64), (row.query_ids, np.int64), (row.query_body, float))]
                    held[key] = Search(mine[0], mine[1], mine[2].reshape(len(mine[1]), row.dim), k)
                ids = np.frombuffer(row.ids, np.int64)
                held[key].search(ids, np.frombuffer(row.body, float).reshape(len(ids), row.dim))
        for search in held.values():
            yield search.found()

    blocks = dealt.mapInPandas(gather, f"block int, {_BLOCK}").select("block", "dim", "uids", F.col("ids").alias("query_ids"), F.col("body").alias("query_body"))
    candidates = _usable(vectors).mapInPandas(cut, _BLOCK).select("dim", "ids", "body", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"))
    if numbers <= BROADCAST_NUMBERS:
        met = candidates.join(F.broadcast(blocks), ["block", "dim"])
    else:
        # salted, as one length may have all candidates
        salted = candidates.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(16)))
        met = salted.join(blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint")))), ["block", "dim", "salt"])
        met = met.sortWithinPartitions("block", "dim")
    found = met.mapInPandas(scan, "uid bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
