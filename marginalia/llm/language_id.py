"""Language identification by cross-parsing entropy.

A suffix automaton is built from a bounded sample of labelled text per language. A text is then parsed
greedily against each automaton: a phrase is the longest run that occurs anywhere in that language's sample.
The language that needs the fewest phrases, normalised by the bits that name one phrase and by the length of
the text, wins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import broadcast_if_small, small_batches
from marginalia.scratch import written

#: Bounds of the training sample: rows of a language, code points of one slice of each row, and of all slices together:
#: with more than SAMPLE_TOTAL / (SAMPLE_ROWS * SAMPLE_CHARS) languages each gets fewer rows, but one at least.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_TOTAL = 160, 128, 4_000_000
#: Entries of the table that gives the steps of the commonest letters; those of all other letters are looked up.
TABLE = 16_000_000
#: Texts are parsed in pieces of so many symbols, so many pieces at once. A phrase ends with its piece, which adds one
#: phrase at most to each piece, in every language alike.
PIECE, LANES = 1024, 2048
#: Added to a state for each phrase that ends on the way there.
BREAK = 1 << 29
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from; rows without an id belong to it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


@dataclass
class Model:
    """Automata of all languages in one numbering of states. Symbols below ``width`` step by a table, others by search."""

    langs: list[str]
    width: int
    table: np.ndarray  # flat: state * width + symbol -> state, plus BREAKs
    rare_keys: np.ndarray  # sorted: state << 32 | symbol
    rare_to: np.ndarray
    starts: np.ndarray  # first state of each language
    start_of: np.ndarray  # first state of each state's language
    bits: np.ndarray  # bits that name a phrase, by language
    known: np.ndarray  # sorted code points of the letters
    symbol: np.ndarray  # their symbols

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The states after one symbol for each column, plus BREAK for each phrase that ends on the way."""
        out = self.table[state * self.width + np.minimum(symbols, self.width - 1)]
        rare = np.flatnonzero(symbols >= self.width)
        if len(rare):
            out[:, rare] = self._rare(state[:, rare], symbols[rare].astype(np.int64))
        return out

    def _rare(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        start = self.start_of[state]
        on = self._find(state, symbols)
        fresh = self._find(start, symbols)  # the phrase ends before the symbol, which begins the next one
        fresh = np.where(fresh < 0, start + BREAK, fresh)  # what never occurs is a phrase by itself
        return np.where(on >= 0, on, fresh + np.where(state == start, 0, BREAK)).astype(np.int32)

    def _find(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        if not len(self.rare_keys):
            return np.full(state.shape, -1, np.int64)
        keys = state.astype(np.int64) << 32 | symbols
        at = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
        return np.where(self.rare_keys[at] == keys, self.rare_to[at].astype(np.int64), -1)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``codes``; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


def _fold(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


#: Symbols: the end of a piece, a run of non-letters, a letter that no sample has (it never matches); then the letters.
END, GAP, STRANGE, FIRST = 0, 1, 2, 3


def fit(samples: dict[str, list[str]]) -> Model:
    """A model from texts by language."""
    langs = sorted(samples)
    seen = Counter(c for lang in langs for t in samples[lang] for c in t.lower() if c.isalpha())
    order = [ord(c) for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
    known = np.array(sorted(order), np.uint32)
    symbol = np.empty(len(order), np.uint32)
    symbol[np.searchsorted(known, np.array(order, np.uint32))] = np.arange(FIRST, FIRST + len(order), dtype=np.uint32)
    automata, starts, bits, at = [], [], [], 0
    for lang in langs:
        codes = [GAP]
        for t in samples[lang]:
            codes += _symbols(t, known, symbol).tolist()
        automata.append(suffix_automaton(codes))
        starts.append(at)
        bits.append(np.log2(len(codes) + 1))
        at += len(automata[-1])
    width = max(FIRST + 1, min(FIRST + len(order), TABLE // max(at, 1)))
    table = np.zeros((at, width), np.int32)
    start_of = np.zeros(at, np.int64)
    rare: list[tuple[int, int]] = []
    for begin, automaton in zip(starts, automata, strict=True):
        root = np.full(width, BREAK, np.int64)  # what never occurs is a phrase by itself
        mine = table[begin : begin + len(automaton)]
        for state, to in enumerate(automaton):
            rare += [((begin + state) << 32 | c, begin + nxt) for c, nxt in to.items() if c >= width]
        common = [{c: nxt for c, nxt in to.items() if c < width} for to in automaton]
        root[list(common[0])] = list(common[0].values())
        mine[:] = (root + BREAK + begin)[None, :]
        mine[0] = root + begin
        for state, to in enumerate(common):
            if to:
                mine[state, list(to)] = [begin + nxt for nxt in to.values()]
        mine[:, END] = BREAK + begin
        mine[0, END] = begin
        start_of[begin : begin + len(automaton)] = begin
    rare.sort()
    keys, to = (np.array([x[k] for x in rare], np.int64) for k in range(2))
    return Model(langs, width, table.ravel(), keys, to.astype(np.int32), np.array(starts, np.int64), start_of, np.array(bits), known, symbol)


def _symbols(text: str, known: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Symbols of a text between two single gaps; runs of non-letters count as one gap."""
    folded = _fold(text)
    points, back = np.unique(folded, return_inverse=True)
    each = np.where([chr(p).isalpha() for p in points.tolist()], STRANGE, GAP).astype(np.uint32)
    if len(known) and len(points):
        at = np.minimum(np.searchsorted(known, points), len(known) - 1)
        each = np.where(known[at] == points, symbol[at], each)
    codes = np.concatenate([[GAP], each[back.ravel()] if len(folded) else [], [GAP]]).astype(np.uint32)
    return codes[1:][(codes[1:] != GAP) | (codes[:-1] != GAP)]


def phrases(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """Phrases that each text (as symbols) needs in each language: array of texts x languages."""
    out = np.zeros((len(texts), len(model.langs)), np.int64)
    owner, pieces = [], []
    for k, codes in enumerate(texts):
        for at in range(0, len(codes), PIECE):
            owner.append(k)
            pieces.append(codes[at : at + PIECE])
    order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
    lanes_at_once = max(1, min(LANES, 8 * LANES // max(1, len(model.langs))))
    for at in range(0, len(order), lanes_at_once):
        lanes = order[at : at + lanes_at_once]
        sizes = np.array([len(pieces[i]) for i in lanes])
        lines = np.zeros((sizes[0] + 1, len(lanes)), np.int32)
        for lane, i in enumerate(lanes):
            lines[: sizes[lane], lane] = pieces[i]
        state = np.repeat(model.starts[:, None], len(lanes), axis=1)
        count = np.zeros(state.shape, np.int64)
        live = len(lanes) - np.searchsorted(sizes[::-1], np.arange(sizes[0] + 1))  # lanes with that many symbols
        for t, n in enumerate(live):
            n = min(len(lanes), n if t else len(lanes))
            step = model.step(state[:, :n], lines[t, :n])
            count[:, :n] += step >> 29
            state[:, :n] = step & (BREAK - 1)
        np.add.at(out, np.array([owner[i] for i in lanes]), count.T)
    return out


def classify(texts: pd.Series, model: Model) -> pd.DataFrame:
    """``lang_pred`` and ``score``: by how much the best language's cost is below the next one's."""
    codes = [_symbols(t, model.known, model.symbol) if isinstance(t, str) else np.zeros(0, np.uint32) for t in texts]
    has = np.array([bool((c > 1).any()) for c in codes], bool)
    if not model.langs or not len(codes):
        return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(codes), "score": 0.0})
    cost = phrases(codes, model) * model.bits / np.maximum(1, [len(c) for c in codes])[:, None]
    best = cost.argmin(axis=1)
    ranked = np.sort(cost, axis=1)
    if len(model.langs) > 1:
        score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-12)
    else:
        score = np.ones(len(codes))
    names = np.array(model.langs, object)[best]
    return pd.DataFrame({"lang_pred": np.where(has, names, UNDETERMINED), "score": np.where(has, score, 0.0)})


def sample_rows(docs: DataFrame) -> DataFrame:
    """The bounded training sample: ``lang, part``. Rows are chosen by a hash of their id, then one slice of each.

    A threshold on the hash leaves a few times SAMPLE_ROWS of a language before anything is ranked, so a
    language with most of the rows is never brought into one task.
    """
    usable = docs.where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")
    ).select("lang", "text", F.xxhash64("doc_id").alias("h"))
    sizes = written(usable.groupBy("lang").count())
    n_langs = sizes.count()
    most = max(1, min(SAMPLE_ROWS, SAMPLE_TOTAL // (SAMPLE_CHARS * max(1, n_langs))))
    near = usable.join(broadcast_if_small(sizes, n_langs), "lang").where(
        (F.shiftrightunsigned("h", 33) / F.lit(float(1 << 31))) < F.lit(4.0 * most + 64) / F.col("count")
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    spare = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    return (
        near.withColumn("rank", rank)
        .where(F.col("rank") <= most)
        .select("lang", F.col("text").substr((F.pmod("h", spare) + 1).cast("int"), F.lit(SAMPLE_CHARS)).alias("part"), "h")
    )


def train(docs: DataFrame) -> Model:
    """Fit on the bounded sample: at most SAMPLE_TOTAL code points (or a slice a language, if that is more) reach the driver."""
    samples: dict[str, list[str]] = {}
    for lang, part, _ in sorted(map(tuple, sample_rows(docs).collect()), key=lambda r: (r[0], r[2], r[1])):
        samples.setdefault(lang, []).append(part)
    return fit(samples)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (existing columns of these names are replaced).

    Whole texts are parsed. Null texts and texts without a letter are ``und`` with score 0; so is every text
    when there is nothing to learn from. Equal costs go to the first language by name. Repeated rows are
    judged alike, an empty table gives an empty result, other columns pass unchanged.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or train(docs))

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield classify(texts, shared.value)

    # so that a filter on the outcome isn't pushed below it, which would judge twice
    judge = judge.asNondeterministic()
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    # the caller's columns in one struct: no name of theirs meets ours
    judged = docs.select(F.struct(*keep).alias("row"), judge(F.col("text")).alias("judged"))
    return judged.select(*[F.col("row")[c].alias(c) for c in keep], F.col("judged.lang_pred").alias("lang_pred"), F.col("judged.score").alias("score"))
