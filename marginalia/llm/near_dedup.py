"""Near-duplicate documents by min-max hashing.

Under each permutation a document keeps both its least and its greatest shingle, so a signature of 2k values
costs k hash evaluations. Bands of the signature propose candidates; components of the candidate graph are
disjoint, so every document's whole shingle set is shuffled to its candidates, and links are confirmed there on
the whole sets, exactly. A large component is first cut into blocks that share some leaders; only documents that
then still share a band with one of another group meet again, in pairs of blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import broadcast_if_small, connected_components, grouped, small_batches
from marginalia.scratch import written

#: BANDS bands of BAND_VALUES values (half of them minima, half maxima): a pair of similarity 0.8 shares no
#: band with odds of (1 - 0.8 ** 6) ** 48 < 1e-6.
BANDS, BAND_VALUES = 48, 6
PERMUTATIONS = BANDS * BAND_VALUES // 2
#: Sets of one comparison block: about so many documents and so many shingles, on either side.
BLOCK_DOCS, BLOCK_SHINGLES = 250, 500_000
#: Documents of a large component that all its blocks see, about.
LEADERS = 8
#: Documents without an id get a stand-in above every real id.
STAND_IN = 1 << 62

_seeds = np.random.Generator(np.random.PCG64(20240607))
_MULTIPLY = _seeds.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _seeds.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up, self.down = np.full(n, _BASE), np.full(n, inverse)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)
        return self.up, self.down


_powers = _Powers()


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, in order; A-Z count as a-z."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    up, down = _powers.get(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return _mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words; of the whole sequence if it is shorter; else empty."""
    if not isinstance(text, str):
        return np.zeros(0, np.uint64)
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        out = _mix(out * _BASE + hashes[k : k + n])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under every permutation, as (PERMUTATIONS, 2)."""
    out = np.empty((PERMUTATIONS, 2), np.uint64)
    low = high = None
    for at in range(0, len(shingles), _CHUNK // 16):
        value = np.multiply.outer(_MULTIPLY, shingles[at : at + _CHUNK // 16]) + _ADD[:, None]
        least, most = value.min(axis=1), value.max(axis=1)
        low = least if low is None else np.minimum(low, least)
        high = most if high is None else np.maximum(high, most)
    out[:, 0], out[:, 1] = low, high
    return out


def band_keys(shingles: np.ndarray) -> np.ndarray:
    bands = signature(shingles).reshape(BANDS, BAND_VALUES)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(BAND_VALUES):
        key = _mix(key * _BASE + bands[:, k])
    return key.view(np.int64)


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    key = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, k1, k2, bands``: set size, 128-bit key of the set and its band keys (null for empty sets)."""
    return docs.select("doc_id", _signed(words)("text").alias("s")).select("doc_id", "s.*")


def _signed(words: int) -> Callable[[str], Column]:
    @F.pandas_udf("n bigint, k1 bigint, k2 bigint, bands array<bigint>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                shingles = shingle_set(text, words)
                rows.append((len(shingles), *_set_key(shingles), band_keys(shingles) if len(shingles) else None))
            yield pd.DataFrame(rows, columns=["n", "k1", "k2", "bands"])

    return sign


def _all_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs with 100 * |intersection| >= percent * |union|; within ``left`` if right is None."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[token] > 1  # a shingle of a single document is in no intersection
    owner, token = owner[shared], token[shared]
    order = np.argsort(token, kind="stable")
    owner = owner[order]
    token = np.unique(token[order], return_inverse=True)[1] if len(token) else token
    # a set whose shared shingles are fewer than percent of it has no partner here
    able = np.bincount(owner, minlength=len(sets)) * 100 >= percent * sizes
    rows = np.flatnonzero(able[: len(left)])
    cols = rows if right is None else np.flatnonzero(able[len(left) :]) + len(left)
    if not len(rows) or not len(cols):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # float32 counts exactly up to 2 ** 24
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64
    both = np.zeros((len(rows), len(cols)), kind)
    row_of, col_of = np.full(len(sets), -1), np.full(len(sets), -1)
    row_of[rows], col_of[cols] = np.arange(len(rows)), np.arange(len(cols))
    width = max(64, 4_000_000 // (len(rows) + len(cols)))
    tokens = int(token[-1]) + 1 if len(token) else 0
    for at in range(0, tokens, width):
        span = slice(*np.searchsorted(token, [at, at + width]))
        who, what = owner[span], token[span] - at
        a = np.zeros((len(rows), min(width, tokens - at)), kind)
        mine = row_of[who] >= 0
        a[row_of[who[mine]], what[mine]] = 1
        if right is None:
            b = a
        else:
            b = np.zeros((len(cols), a.shape[1]), kind)
            mine = col_of[who] >= 0
            b[col_of[who[mine]], what[mine]] = 1
        both += a @ b.T
    common = both.astype(np.int64)
    linked = common * 100 >= percent * (sizes[rows][:, None] + sizes[cols][None, :] - common)
    if right is None:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    return rows[i], cols[j]


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links: each node with the least id it is joined to."""
    parent = list(range(len(ids)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            if ids[a] < ids[b]:
                parent[b] = a
            else:
                parent[a] = b
    return [(int(ids[top(k)]), int(ids[k])) for k in range(len(ids)) if top(k) != k]


def star_edges(links: DataFrame) -> DataFrame:
    """Edges ``a, b`` with the components of the links ``hub, node``, in which a node has one hub a band at most.

    All hubs of a node are linked through it, so it is enough to tie the node and its other hubs to its least one:
    the nodes of a large group name the same few hubs, and their pairs fall together.
    """
    return (
        links.groupBy("node")
        .agg(F.min("hub").alias("a"), F.collect_set("hub").alias("hubs"))
        .select("a", F.explode(F.array_union("hubs", F.array("node"))).alias("b"))
        .where("a <> b")
    )


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id`` long, ``text``).

    Documents are linked if ``100 * |intersection| >= percent * |union|`` of their sets of distinct shingles;
    ``component_id`` is the smallest id reachable. Null and empty texts have an empty set and stay alone.
    Equal sets are one class before anything is compared, so copies cost one row each. Rows that share an id
    are one document that has the links of each; rows without an id are classed by their set, below every id, and a component of such rows alone
    has a null id and keeps them all. Tables may be empty; other columns are not read.
    """
    real = F.when(F.col("component") < STAND_IN, F.col("component"))
    return (
        _grouped(docs, words, percent)
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(real).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (``doc_id`` long, ``text``) with one of each component: one of its smallest id.

    Documents with an empty set all stay. Of rows that share an id, as one document, and of near-duplicates without
    an id one row stays, the one with the least key of its set. All columns pass unchanged; tables may be empty.
    """
    found = written(_grouped(docs, words, percent).withColumn("node", F.coalesce("doc_id", _stand_in("k1"))))
    shared = written(found.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"))
    # the caller's columns in one struct: no name of theirs meets one of ours
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    kept = found.where("doc_id IS NOT NULL AND (n = 0 OR node = component)").select("doc_id").join(shared, "doc_id", "left_anti")
    single = rows.join(broadcast_if_small(kept), "doc_id", "left_semi").select("row.*")
    if shared.isEmpty():
        return single
    # ids that don't tell rows apart: their sets do
    again = rows.join(broadcast_if_small(shared), rows["doc_id"].eqNullSafe(shared["doc_id"]), "left_semi")
    signed = written(again.select("row", "doc_id", _signed(words)("text").alias("s")).select("row", "doc_id", "s.n", "s.k1", "s.k2"))
    node = F.coalesce("doc_id", _stand_in("k1"))
    tops = found.select("k1", "k2", "component").where("component IS NOT NULL").distinct()
    chosen = (
        signed.where("n > 0")
        .join(tops, ["k1", "k2"])
        .where(node == F.col("component"))
        .groupBy("component")
        .agg(F.min_by("row", F.struct("k1", "k2")).alias("row"))
    )
    return single.unionByName(signed.where("n = 0").select("row.*")).unionByName(chosen.select("row.*"))


def _stand_in(k1: str) -> Column:
    return F.lit(STAND_IN) + F.pmod(F.shiftright(k1, 3), F.lit(1 << 61))


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, n, k1, k2, component`` of every row; a component of rows without an id is a stand-in, of an empty set null."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = written(signatures(docs, words).withColumn("node", F.coalesce("doc_id", _stand_in("k1"))))
    classes = written(signed.where("n > 0").groupBy("k1", "k2").agg(F.min("node").alias("class"), F.first("n").alias("n")))
    # one row a class: the bands of its smallest document
    tops = signed.where("n > 0").join(classes.select("k1", "k2", F.col("class").alias("node")), ["k1", "k2", "node"]).select("node", "bands")
    heads = tops.select("node", F.explode("bands").alias("band"))
    hubs = written(heads.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1"))
    hubs = broadcast_if_small(hubs.select("band", "hub"))
    candidates = connected_components(star_edges(heads.join(hubs, "band").select("hub", "node")))
    links = _confirmed(docs, tops, signed, candidates, words, percent)
    # an id with several sets is one document: its classes are linked
    several = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b")
    several = written(several.select("doc_id"))
    if not several.isEmpty():
        sets = signed.where("n > 0").join(several, "doc_id").join(classes.select("k1", "k2", "class"), ["k1", "k2"])
        links = links.union(sets.select(F.col("doc_id").alias("a"), F.col("class").alias("b")).where("a <> b"))
    joined = connected_components(links)
    found = joined.select(F.col("node").alias("class"), "component")
    final = classes.join(broadcast_if_small(found), "class", "left").select("k1", "k2", F.coalesce("component", "class").alias("component"))
    return signed.select("doc_id", "n", "k1", "k2").join(final, ["k1", "k2"], "left")


def _sized(placed: DataFrame, *keys: str) -> DataFrame:
    """``keys, g``: how many blocks the documents (``n`` shingles each) of a group fill."""
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return sizes.select(*keys, "docs", blocks.alias("g"))


def _confirmed(docs: DataFrame, tops: DataFrame, signed: DataFrame, candidates: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``a, b`` with the components of all links; a forest for each block of comparisons, not every pair.

    A candidate component that fits one block is compared in one task. A larger one is dealt over blocks, each of
    which also has the component's leaders: every document is compared with those of its block and with them, and
    a group of copies of one text comes together. Bands that still have documents of more than one group tell which
    documents must meet again.
    """
    sizes = signed.where("n > 0").groupBy("node").agg(F.max("n").alias("n"))
    known = candidates.join(sizes, "node")
    placed = written(known.join(_sized(known, "component"), "component"))
    block = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    own = placed.select("component", block.alias("i"), block.alias("j"), "node")
    leads = F.pmod(F.xxhash64("node", F.lit("leader")), F.col("docs")) < LEADERS
    sent = placed.where((F.col("g") > 1) & leads).select("component", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("i"), block.alias("b"), "node")
    sent = sent.where("i <> b").select("component", "i", F.col("i").alias("j"), "node")
    links = _met(docs, own.union(sent).withColumn("side", F.lit(0)), words, percent)
    large = placed.where("g > 1").select("node", "n")
    if large.isEmpty():
        return links
    groups = connected_components(links).select("node", F.col("component").alias("known"))
    large = written(large.join(groups, "node", "left").withColumn("known", F.coalesce("known", "node")))
    bands = tops.join(broadcast_if_small(large), "node").select("node", "known", F.explode("bands").alias("band"))
    open_ = bands.groupBy("band").agg(F.min("known").alias("a"), F.max("known").alias("b"), F.min("node").alias("hub")).where("a <> b")
    open_ = written(open_.select("band", "hub"))
    if open_.isEmpty():
        return links
    left = connected_components(star_edges(bands.join(broadcast_if_small(open_), "band").select("hub", "node")))
    placed = written(left.join(large, "node"))
    return links.union(_met(docs, _rooms(placed), words, percent))


def _rooms(placed: DataFrame) -> DataFrame:
    """``component, i, j, side, node``: documents (``known`` group) of a component in all pairs of its blocks.

    A group that fills blocks has its own, which needn't meet each other; the smaller groups share others.
    """
    filled = placed.join(_sized(placed, "component", "known").where("g > 1").select("component", "known", F.col("g").alias("own")), ["component", "known"], "left")
    mixed = _sized(filled.where("own IS NULL"), "component").select("component", F.col("g").alias("mixed"))
    group = F.when(F.col("own").isNotNull(), F.col("known"))
    block = F.pmod(F.xxhash64("node"), F.coalesce("own", "mixed"))
    # a block is named by a hash of its group, if it has one, and its number
    name = F.xxhash64(F.coalesce(group, F.lit(-1)), block)
    dealt = written(filled.join(mixed, "component", "left").select("component", "node", group.alias("known"), name.alias("i")))
    blocks = dealt.select("component", F.col("known").alias("other"), F.col("i").alias("k")).distinct()
    met = dealt.join(blocks, "component").where("known IS NULL OR other IS NULL OR known <> other")
    return met.select("component", F.least("i", "k").alias("i"), F.greatest("i", "k").alias("j"), "node", F.when(F.col("i") <= F.col("k"), 0).otherwise(1).alias("side"))


def _met(docs: DataFrame, rooms: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``a, b`` among the documents of each room ``component, i, j``: all pairs if i = j, else across its sides."""
    rooms = written(rooms.groupBy("node").agg(F.collect_list(F.struct("component", "i", "j", "side")).alias("rooms")))

    @F.pandas_udf("bigint")
    def stand_in(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([STAND_IN + (_set_key(shingle_set(t, words))[0] >> 3) % (1 << 61) for t in texts], dtype="int64")

    @F.pandas_udf("binary")
    def whole_set(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, words).tobytes() for t in texts], dtype=object)

    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "text")
    if not rooms.where(F.col("node") >= STAND_IN).isEmpty():
        texts = texts.union(docs.where("doc_id IS NULL").select(stand_in("text"), "text"))
    sets = texts.join(broadcast_if_small(rooms), "node").select("node", "rooms", whole_set("text").alias("body"))
    dealt = sets.select("node", "body", F.inline("rooms"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped(batches, ["component", "i", "j"]):
            group = group.sort_values(["side", "node"])
            bodies = [np.frombuffer(b, np.uint64) for b in group["body"]]
            ids = group["node"].to_numpy()
            n = int((group["side"] == 0).sum())
            if group["i"].iloc[0] == group["j"].iloc[0]:
                a, b = _all_pairs(bodies, None, percent)
            elif 0 < n < len(bodies):
                a, b = _all_pairs(bodies[:n], bodies[n:], percent)
            else:
                continue
            yield pd.DataFrame(_forest(ids, a, b), columns=["a", "b"], dtype="int64")

    parts = F.col("component"), F.col("i"), F.col("j")
    return written(dealt.repartition(*parts).sortWithinPartitions(*parts).mapInPandas(compare, "a bigint, b bigint"))
