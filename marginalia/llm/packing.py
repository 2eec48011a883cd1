"""Packing documents into fixed-length sequences: shortest pack first over the length histogram.

Documents are tokenised and cut into full sequences and a rest. The lengths' histogram, which has no more
rows than a sequence has tokens, is packed on the driver, longest length first, each into the emptiest open
packs: that makes packing patterns with counts, not documents in packs. Patterns are then joined back to
the pieces by the rank of a piece among those of its length.
"""

from __future__ import annotations

import math
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import small_batches
from marginalia.scratch import written

CAPACITY, END_ID = 2048, 1
#: Pieces of one length are ranked in parts of about so many, or of about the root of the number of all if that is more.
PART_ROWS = 500
#: Units up to so many characters are remembered with their ids, so many of them twice over in each worker.
UNIT_CHARS, UNITS = 40, 300_000
#: No token of the byte-level pattern reaches from a non-space over a single space before another one, nor from a letter
#: to a space or to these marks, so a text's ids are those of its units one after another.
_UNIT = re.compile(r" ?[A-Za-z]++(?=[ ,.;:!?])|[,.;:!?]++(?= \S)|(?s:.)+?(?:(?<=\S)(?= \S)|(?<=[A-Za-z])(?=[,.;:!?])|\Z)")
_WORD = re.compile(r" ?[A-Za-z]+").fullmatch
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(16)]


class Units(dict):
    """Ids of units, as little-endian 32-bit numbers, by the tokenizer of a file in its default state.

    When UNITS are remembered they become the older half; what is met again comes back from there.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer, self.older = tokenizers.Tokenizer.from_file(path), {}
        self.by_units = _fits_units(self.tokenizer)
        if not self.by_units:
            return
        self.split, self.model = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        self.space = self.split(" ")[0][0]
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) if added else r"(?!)").search

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            if _WORD(unit):  # its bytes stand for themselves, and a space for the letter that stands for it
                ids = [token.id for token in self.model(unit.replace(" ", self.space))]
            elif self.added(unit):
                ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
            else:
                ids = [token.id for piece, _ in self.split(unit) for token in self.model(piece)]
            found = _PACKED[len(ids)](*ids) if len(ids) < len(_PACKED) else np.array(ids, "<u4").tobytes()
        if len(unit) <= UNIT_CHARS:
            if len(self) >= UNITS:
                self.older = dict(self)
                self.clear()
            self[unit] = found
        return found

    def ids(self, text: str) -> np.ndarray:
        if not self.by_units:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, _UNIT.findall(text))), "<u4")


def _fits_units(tokenizer: tokenizers.Tokenizer) -> bool:
    """Whether a text's ids are those of its units: by the byte-level pattern alone, and added tokens that take no neighbours."""
    split, model = tokenizer.pre_tokenizer, tokenizer.model
    plain = tokenizer.normalizer is None and isinstance(split, tokenizers.pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
    plain = plain and isinstance(model, tokenizers.models.BPE) and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix)
    added = tokenizer.get_added_tokens_decoder().values()
    # a unit ends between letters and marks or before a space, so a token must not hold such a place
    return plain and not any(t.lstrip or t.rstrip or t.single_word or len(_UNIT.findall(f"x{t.content}x")) > 1 for t in added)


_units: dict[str, Units] = {}


def encoded(texts: Iterable[str], path: str) -> Iterator[np.ndarray]:
    """Ids of whole texts by the tokenizer of a file, without added special tokens; a byte-level one goes by remembered units."""
    if path not in _units:
        _units[path] = Units(path)
    return map(_units[path].ids, texts)


def forget(path: str) -> None:
    """Free what a task has remembered; its worker keeps the tokenizer for the next one."""
    if path in _units:
        _units[path].clear()
        _units[path].older = {}


def pack_histogram(lengths: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a pack, in order) and how many packs have each, from counts by length."""
    open_packs: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # by space left
    for length in sorted(lengths, reverse=True):
        left, space = lengths[length], capacity
        while left:
            while space >= length and not open_packs[space]:
                space -= 1
            if space < length:
                open_packs[capacity - length].append(((length,), left))
                break
            pattern, count = open_packs[space].pop()
            used = min(left, count)
            if used < count:
                open_packs[space].append((pattern, count - used))
            open_packs[space - length].append(((*pattern, length), used))
            left -= used
    return [x for packs in open_packs for x in packs]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, remember: bool = True) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) of every piece of every document."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch["doc_id"], encoded(batch["text"].fillna(""), tokenizer_path), strict=True):
                ids = np.concatenate([found, end])
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    row = (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids))
                    rows.append((*row, part.astype("int32")) if with_ids else row)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            yield out.astype({"doc_id": "Int64"})
        if not remember:
            forget(tokenizer_path)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(cut, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, remember: bool = True) -> DataFrame:
    """Pieces of all ``docs`` (``doc_id, text``) with their ``sequence_id`` and ``offset``.

    A document's ids and the end id lie in pieces of at most ``capacity`` ids: full ones and a rest. Null and
    empty texts have the end id alone. Repeated rows are documents of their own; an empty table gives none.
    Other columns are not read. A length with very many pieces, as full ones are, is ranked in many parts: what comes
    to the driver is a count for each length (``capacity`` at most) and for each part (their root of all pieces at most).

    What a worker has remembered serves its next tasks too; without ``remember`` each task frees it, which takes about
    a quarter more CPU time and leaves later stages in the same worker about 100 MB more.
    """
    spark = docs.sparkSession
    # a number of its own for each piece, so that equal rows are dealt over all parts
    pieces = written(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids, remember).withColumn("_row", F.monotonically_increasing_id()))
    totals = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        totals[length] = n
    parts = -(-totals // max(PART_ROWS, math.isqrt(int(totals.sum()))))
    first = np.cumsum(parts) - parts
    dealing = spark.createDataFrame([(k, int(first[k]), int(parts[k])) for k in range(capacity + 1) if parts[k]], "length bigint, first bigint, parts bigint")
    part = F.col("first") + F.pmod(F.xxhash64("_row"), F.col("parts"))
    dealt = pieces.join(F.broadcast(dealing), "length").withColumn("_part", part).drop("first", "parts")
    counts = np.zeros(parts.sum(), np.int64)
    for where, n in dealt.groupBy("_part").count().collect():
        counts[where] = n
    # how many pieces of a part's length are in the parts before it
    ahead = np.cumsum(counts) - counts
    ahead -= np.repeat(ahead[first[parts > 0]], parts[parts > 0])
    patterns = pack_histogram({k: int(n) for k, n in enumerate(totals) if n}, capacity)
    taken = np.zeros(capacity + 1, np.int64)
    slots, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            slots.append((length, taken[length], sequence, offset))
            taken[length] += n
            offset += length
        sequence += n
    slots.sort()
    shape = np.array(slots, np.int64).reshape(-1, 4)
    # a row for each place of a pattern, and one for each part
    shared = spark.sparkContext.broadcast((ahead, shape[:, 0] << 44 | shape[:, 1], shape[:, 1:].copy()))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        before, keys, values = shared.value
        for length, where, nth in batches:
            rank = before[where] + nth.to_numpy() - 1
            slot = np.searchsorted(keys, length.to_numpy() << 44 | rank, side="right") - 1
            found = values[slot]
            yield pd.DataFrame({"sequence_id": found[:, 1] + rank - found[:, 0], "offset": found[:, 2]})

    nth = F.row_number().over(Window.partitionBy("_part").orderBy("_row"))
    return (
        dealt.withColumn("_nth", nth.cast("bigint"))
        .withColumn("_at", place("length", "_part", "_nth"))
        .select(*[c for c in pieces.columns if c != "_row"], "_at.sequence_id", "_at.offset")
    )
