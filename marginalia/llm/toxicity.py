"""Toxic passages by maximum-scoring segments.

A word's score is its log odds of standing in toxic text, with a Dirichlet prior that its beginning sets, less what a word
must have to count at all, so that ordinary text scores below 0 on the way. One linear scan finds all maximal segments of a
text. How large the segments of clean text get is known from labelled clean documents: the chance of a segment falls
exponentially with its score and rises with the length of the text. What the segments of a text have beyond that, summed,
gives its score by a logistic curve.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import small_batches
from marginalia.llm.language_id import held_out
from marginalia.scratch import written

#: Bounds of what is learned from: labelled documents of each class, about, chosen by a hash of their id, and words, the
#: most frequent ones (rarer ones count for their beginnings alone). One sampled document in CALIBRATE sets the curve, the
#: others the words' odds.
SAMPLE_ROWS, MOST_WORDS, CALIBRATE = 20_000, 150_000, 4
#: Letters of a word's beginning, which stands for words never seen; weight of the class's share in the prior of a
#: beginning, and of the beginning's in the prior of a word.
BEGINNING, PRIOR_OF_BEGINNING, PRIOR_OF_WORD = 4, 20.0, 5.0
#: Log odds that a word must exceed to add to a segment, the most it adds, and the most an ordinary word takes away.
DRIFT, MOST, LEAST = 2.0, 4.0, -0.5
#: Words whose score is this near to that of their beginning aren't kept.
NEAR = 0.1
#: The curve before anything is learned, and how firmly it is held to.
CURVE, FIRMNESS = (-3.0, 1.0), 1.0
#: The curve is set as if no text were more surprising than this.
MOST_SURPRISE = 20.0
#: From this score on a document is toxic.
THRESHOLD = 0.7
_CONTEXTS = 64
_WORD = re.compile(r"\w+")


def _fold(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words(text: str | None) -> list[str]:
    """Words of a text in lower case, in order."""
    return _WORD.findall(_fold(text)) if isinstance(text, str) else []


@dataclass
class Curve:
    """Chance of a clean segment (``rate, log_k``), and the logistic curve over what is beyond it."""

    rate: float = 1.0
    log_k: float = 0.0
    a: float = CURVE[0]
    b: float = CURVE[1]

    def surprise(self, n: int, scores: list[float]) -> float:
        """Sum over segments of the negative log of how many as high a clean text of n words has, where that is below one."""
        return sum(max(0.0, self.rate * s - self.log_k - math.log(max(n, 1))) for s in scores)

    def score(self, n: int, scores: list[float]) -> float:
        return 1 / (1 + math.exp(-min(max(self.a + self.b * self.surprise(n, scores), -700.0), 700.0)))


class _Scores(dict):
    """Scores of words; a word that isn't there has that of its beginning."""

    def __init__(self, kept: dict[str, float], beginnings: dict[str, float], base: float) -> None:
        super().__init__(kept)
        self.beginnings, self.base = beginnings, base

    def __missing__(self, word: str) -> float:
        return self.beginnings.get(word[:BEGINNING], self.base)

    def __reduce__(self):
        return _Scores, (dict(self), self.beginnings, self.base)


@dataclass
class Model:
    of_word: _Scores = field(default_factory=lambda: _Scores({}, {}, LEAST))
    curve: Curve = field(default_factory=Curve)


def fit_words(counts: list[tuple[str, float, float]], begins: list[tuple[str, float, float]]) -> _Scores:
    """Scores from rows ``word, toxic, clean``: how many documents of each class have it; and the same of all words' beginnings."""
    toxic, clean = math.fsum(t for _, t, _ in begins), math.fsum(c for _, _, c in begins)
    if not toxic or not clean:
        return _Scores({}, {}, LEAST)
    share, odds = toxic / (toxic + clean), math.log(toxic / clean)

    def score(t: float, c: float, begin_share: float) -> float:
        found = math.log((t + PRIOR_OF_WORD * begin_share) / (c + PRIOR_OF_WORD * (1 - begin_share))) - odds
        return min(max(found - DRIFT, LEAST), MOST)

    shares = {b: (t + PRIOR_OF_BEGINNING * share) / (t + c + PRIOR_OF_BEGINNING) for b, t, c in begins}
    base = score(0, 0, share)
    beginnings = {b: s for b, x in shares.items() if abs((s := score(0, 0, x)) - base) > NEAR}
    kept = {w: s for w, t, c in counts if abs((s := score(t, c, shares[w[:BEGINNING]])) - beginnings.get(w[:BEGINNING], base)) > NEAR}
    return _Scores(kept, beginnings, base)


def segments(found: list[str], of_word: _Scores) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of words: first word, word after the last, score. One scan, linear time.

    A word adds to a segment once in a text; its repeats neither add nor take away.
    """
    each = np.fromiter(map(of_word.__getitem__, found), float, len(found))
    high, seen = [], set()
    for i in np.flatnonzero(each > 0).tolist():
        if found[i] in seen:
            each[i] = 0
        else:
            seen.add(found[i])
            high.append(i)
    if not high:
        return []
    total = np.concatenate([[0.0], np.cumsum(each)])
    # begin, end, sum before, sum after, and the nearest segment to the left with a lower sum before
    out: list[tuple[int, int, float, float, int]] = []
    for i in high:
        begin, before, after = i, float(total[i]), float(total[i + 1])
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= before:
                j = out[j][4]
            if j < 0 or out[j][3] >= after:
                out.append((begin, i + 1, before, after, j))
                break
            begin, before = out[j][0], out[j][2]
            del out[j:]
    return [(b, e, after - before) for b, e, before, after, _ in out]


def fit_curve(judged: list[tuple[int, int, list[float]]]) -> Curve:
    """The curve from documents that set no odds: ``toxic, words, scores of segments``."""
    judged = sorted(judged)
    clean = sorted(s for toxic, _, scores in judged if not toxic for s in scores)
    length = sum(n for toxic, n, _ in judged if not toxic)
    curve = Curve()
    # segments above a high floor: the mean of what is above it gives the rate, their number the constant; one made-up
    # segment of score 1 stands for rare data
    floor = clean[len(clean) * 9 // 10] if len(clean) >= 100 else 0.0
    above = [s - floor for s in clean if s > floor]
    curve.rate = (len(above) + 1) / (sum(above) + 1)
    curve.log_k = math.log((len(above) + 1) / (length + 1)) + curve.rate * floor
    x = np.array([curve.surprise(n, scores) for _, n, scores in judged])
    y = np.array([toxic for toxic, _, _ in judged], float)
    if not len(x) or y.min() == y.max():
        return curve
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * min(len(y), 1000)
    rows, prior, at = np.stack([np.ones(len(x)), np.minimum(x, MOST_SURPRISE)], axis=1), np.array(CURVE), np.array(CURVE)

    def loss(at: np.ndarray) -> float:
        z = rows @ at
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + FIRMNESS / 2 * ((at - prior) ** 2).sum())

    for _ in range(50):
        p = 0.5 * (1 + np.tanh(rows @ at / 2))
        slope = rows.T @ (weight * (p - y)) + FIRMNESS * (at - prior)
        bend = (rows * (weight * p * (1 - p))[:, None]).T @ rows + FIRMNESS * np.eye(2)
        step = np.linalg.solve(bend, slope)
        while loss(at - step) > loss(at) and abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
    curve.a, curve.b = float(at[0]), max(float(at[1]), 0.01)
    return curve


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled texts to learn from: ``text, toxic, tuning``; none of the held-out fold. A document is toxic if a label says so."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    part = F.shiftrightunsigned(F.xxhash64("doc_id"), 33) / F.lit(float(1 << 31))
    share = F.when(F.col("toxic") == 1, SAMPLE_ROWS / max(counts.get(1, 0), 1)).otherwise(SAMPLE_ROWS / max(counts.get(0, 0), 1))
    # at most about SAMPLE_ROWS ids of each class, by the counts just made
    chosen = F.broadcast(known.where(part < share))
    tuning = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATE)) == 0
    return docs.select("doc_id", "text").where("text IS NOT NULL").join(chosen, "doc_id").select("text", "toxic", tuning.alias("tuning"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, toxic, clean``: documents of each class with the word, as far as it follows different words in them.

    Copies of a passage have their words after the same words; they count about once, however many there are.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                masks: dict[str, int] = {}
                before = ""
                for w in words(text):
                    masks[w] = masks.get(w, 0) | 1 << hash_of(before)
                    before = w
                rows += [(w, toxic, m - (1 << 64) if m >> 63 else m) for w, m in masks.items()]
            yield pd.DataFrame(rows, columns=["word", "toxic", "mask"])

    seen = texts.mapInPandas(each, "word string, toxic int, mask bigint").groupBy("word").agg(
        *[F.count_if(F.col("toxic") == k).alias(f"n{k}") for k in (0, 1)],
        *[F.coalesce(F.bit_count(F.bit_or(F.when(F.col("toxic") == k, F.col("mask")))), F.lit(0)).alias(f"b{k}") for k in (0, 1)],
    )

    def effective(k: int) -> Column:
        bits = F.col(f"b{k}")
        different = -_CONTEXTS * F.log(1 - F.least(bits, F.lit(_CONTEXTS - 1)) / _CONTEXTS)
        return F.when(bits >= _CONTEXTS * 3 // 4, F.col(f"n{k}").cast("double")).otherwise(F.least(F.col(f"n{k}").cast("double"), different))

    return seen.select("word", effective(1).alias("toxic"), effective(0).alias("clean"), (F.col("n0") + F.col("n1")).alias("n"))


def hash_of(word: str) -> int:
    """One of 64 classes of a word, the same in every process."""
    return sum(map(ord, word[:8])) * 31 + len(word) & _CONTEXTS - 1


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample; its words' counts and its segments' scores are all that comes to the driver."""
    small_batches(docs.sparkSession)
    texts = written(sample(docs, labels))
    counts = written(word_counts(texts.where("NOT tuning")))
    begins = counts.groupBy(F.substring("word", 1, BEGINNING).alias("begin")).agg(*[F.sum(F.round(c, 6).cast("decimal(24,6)")).cast("double").alias(c) for c in ("toxic", "clean")])
    # the least frequency of which there aren't too many words
    least, room = 1, MOST_WORDS
    for n, words_of in sorted(map(tuple, counts.groupBy("n").count().collect()), reverse=True):
        room -= words_of
        if room < 0:
            least = n + 1
            break
    kept = counts.where(F.col("n") >= least).select("word", "toxic", "clean").toPandas()
    of_word = fit_words(list(kept.itertuples(index=False, name=None)), sorted(map(tuple, begins.collect())))
    del kept
    shared = docs.sparkSession.sparkContext.broadcast(of_word)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [words(t) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "n": [len(w) for w in found], "scores": [[s for *_, s in segments(w, shared.value)] for w in found]})

    judged = texts.where("tuning").select("text", "toxic").mapInPandas(scan, "toxic int, n bigint, scores array<double>").collect()
    return Model(of_word, fit_curve([(r["toxic"], r["n"], list(r["scores"])) for r in judged]))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``passages`` (existing columns of these names are replaced).

    ``passages`` has start and length in code points and score of each segment that a clean text of its length has less
    often than once. Whole texts are scanned. Null and empty texts have no segment and the lowest score. Equal texts are
    judged alike, repeated rows are kept, an empty table gives an empty result, other columns pass unchanged.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, passages array<struct<start:int,length:int,score:double>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of_word, curve = shared.value.of_word, shared.value.curve
        for texts in batches:
            scores, passages = [], []
            for text in texts:
                found = words(text)
                mine = segments(found, of_word)
                scores.append(curve.score(len(found), [s for *_, s in mine]))
                high = [x for x in mine if curve.surprise(len(found), [x[2]]) > 0]
                spans = [m.span() for m in _WORD.finditer(_fold(text))] if high else []
                passages.append([{"start": spans[b][0], "length": spans[e - 1][1] - spans[b][0], "score": s} for b, e, s in high])
            yield pd.DataFrame({"score": scores, "passages": passages})

    keep = [c for c in docs.columns if c not in ("score", "predicted", "passages")]
    # so that a filter on the outcome isn't pushed below it, which would judge twice
    judged = docs.select(F.struct(*keep).alias("row"), scan.asNondeterministic()(F.col("text")).alias("judged"))
    return judged.select(
        *[F.col("row")[c].alias(c) for c in keep], F.col("judged.score").alias("score"),
        (F.col("judged.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("judged.passages").alias("passages"),
    )


def find_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``judge`` with a model of the labelled documents outside the held-out fold. Without labels of both classes all score low."""
    return judge(docs, train(docs, labels))
