"""Document fingerprints by randomised edit embedding.

A pointer walks over a text: at every step of the walk the character under it is written, and shared random
bits, one for each step and character, say whether it moves on. Texts at a small edit distance get walks that
fall into step again soon after each edit, so their outputs have a small Hamming distance. A fingerprint samples
the output at shared places; bands of samples propose candidates, all samples verify them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import connected_components, small_batches
from marginalia.scratch import written

#: Steps after which the shared bits begin again; classes that characters are hashed to.
PERIOD, CLASSES = 4096, 64
#: Samples at each scale, a hexadecimal digit each; samples in a band.
SAMPLES, BAND = 128, 4
PAD = "-"
#: Documents that one bucket of the order by id holds, about, and buckets at most.
BUCKET_DOCS, MOST_BUCKETS = 2000, 10_000

_rng = np.random.Generator(np.random.PCG64(77))
_PLACES = np.sort(_rng.random(SAMPLES))
_ODD = _rng.integers(1, 1 << 31, 4).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _states() -> list[list]:
    """The walk as linked states: ``state[class]`` is the state after that character, ``state[CLASSES]`` its step."""
    moves = np.random.Generator(np.random.PCG64(78)).random((PERIOD, CLASSES)) < 0.5
    moves[PERIOD - 1] |= ~moves.any(axis=0)
    until = np.zeros((PERIOD, CLASSES), np.int64)
    ahead = np.argmax(moves, axis=0) + PERIOD
    for step in range(PERIOD - 1, -1, -1):
        ahead = np.where(moves[step], step, ahead)
        until[step] = ahead
    after = (until + 1) % PERIOD
    states: list[list] = [[] for _ in range(PERIOD)]
    for step, state in enumerate(states):
        state.extend(states[k] for k in after[step].tolist())
        state.append(step)
    return states


_walk: list[list] = []


def walk(codes: np.ndarray, begin: int = 0) -> np.ndarray:
    """Step (modulo PERIOD) at which each character is met, and the step after the last."""
    if not _walk:
        _walk.extend(_states())
    classes = ((codes.astype(np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(16)) % np.uint64(CLASSES)
    steps = map(itemgetter(CLASSES), accumulate(classes.astype(np.uint8).tobytes(), getitem, initial=_walk[begin]))
    return np.fromiter(steps, np.int64, len(codes) + 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _sampled(codes: np.ndarray, steps: np.ndarray) -> str:
    n = len(codes)
    moved = np.diff(steps) % PERIOD
    met = np.zeros(n + 1, np.int64)
    np.cumsum(np.where(moved == 0, PERIOD, moved), out=met[1:])
    padded = np.concatenate([codes, np.zeros(3, codes.dtype)]).astype(np.uint64)
    scale = n.bit_length()
    out = [f"{scale:02x}"]
    for s in (scale, scale + 1):
        places = (_PLACES * (2 << s)).astype(np.int64)
        inside = places < met[-1]
        at = np.searchsorted(met, places[inside], side="right") - 1
        gram = sum(padded[at + k] * _ODD[k] for k in range(4)) if len(at) else np.zeros(0, np.uint64)
        gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        digits = np.full(SAMPLES, PAD)
        digits[inside] = np.array(list("0123456789abcdef"))[(gram >> np.uint64(60)).astype(int)]
        out.append("".join(digits.tolist()))
    return "".join(out)


def fingerprint(text: str | None) -> str:
    """Two hexadecimal digits for the scale of the text's length, then samples at that scale and at the next."""
    codes = _codes(text or "")
    return _sampled(codes, walk(codes))


def _common(a: str, b: str) -> tuple[str, str]:
    s, t = int(a[:2], 16), int(b[:2], 16)
    if s > t:
        b, a = _common(b, a)
        return a, b
    if s == t:
        return a[2:], b[2:]
    return (a[2 + SAMPLES :], b[2 : 2 + SAMPLES]) if t == s + 1 else ("", "")


def likeness(a: str, b: str) -> float:
    """Share of equal samples among those that lie inside either text; 0 for lengths of other scales."""
    x, y = _common(a, b)
    if not x:
        return 0.0
    p, q = np.frombuffer(x.encode(), np.uint8), np.frombuffer(y.encode(), np.uint8)
    inside = (p != ord(PAD)) | (q != ord(PAD))
    if not inside.any():
        return 1.0
    return float(((p == q) & inside).sum() / inside.sum())


def band_names(fp: str) -> list[str]:
    """Bands of a fingerprint: the samples of a band lie far apart, so one edit spoils few; no band is all pads."""
    scale = int(fp[:2], 16)
    out = []
    for k in range(2):
        part = fp[2 + k * SAMPLES : 2 + (k + 1) * SAMPLES]
        for b in range(SAMPLES // BAND):
            digits = part[b :: SAMPLES // BAND]
            if digits.strip(PAD):
                out.append(f"{scale + k}.{b}.{digits}")
    return out


def _dealt(docs: DataFrame) -> tuple[DataFrame, Column]:
    """Rows ``key, doc_id, text`` and the number of the range of ids that a row belongs to, highest ids first.

    Only bounds of the ranges come to the driver. Rows without an id are the last ones.
    """
    lowest = -(1 << 63)
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(lowest)).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ids = keyed.select("key")
    buckets = min(MOST_BUCKETS, max(1, ids.count() // BUCKET_DOCS))
    cuts = ids.agg(F.percentile_approx("key", [k / buckets for k in range(1, buckets)] or [0.5], 100_000)).first()[0] or []
    cuts = sorted(set(cuts)) if buckets > 1 else []
    # how many cuts are above the key: halving finds it without going through all
    bucket = F.lit(0)
    if cuts:
        above = F.array(*[F.lit(c) for c in reversed(cuts)])
        widths = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

        def halve(found: Column, width: Column) -> Column:
            reach = found + width
            return F.when((reach <= len(cuts)) & (F.get(above, reach - 1) > F.col("key")), reach).otherwise(found)

        bucket = F.aggregate(widths, F.lit(0), halve)
    return keyed, bucket


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (``doc_id, text``) its fingerprint and that of its edited text.

    The edited text has its last third replaced by the beginning of the next document (by descending id; after
    the last the first). Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, candidate_edited`` (whether a band is shared). Null texts are empty ones; an empty text equals
    only empty ones. Rows with one id are ordered by their texts, rows without an id come last. Whole texts are
    read; other columns are not; tables may be empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keyed, bucket_of = _dealt(docs)
    firsts = keyed.select("key", bucket_of.alias("bucket")).groupBy("bucket").agg(F.max("key").alias("key")).orderBy("bucket").collect()
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    tails = [(firsts[(k + 1) % len(firsts)]["key"], row["bucket"]) for k, row in enumerate(firsts)]
    ends = spark.createDataFrame(tails, "key bigint, bucket int")
    rows = keyed.select(bucket_of.alias("bucket"), F.lit(0).alias("tail"), "key", "doc_id", "text").union(
        keyed.join(F.broadcast(ends), "key").select("bucket", F.lit(1), "key", "doc_id", "text")
    )
    order = ["bucket", "tail", F.desc("key"), "hash", "text"]
    dealt = rows.withColumn("hash", F.xxhash64("text")).repartition("bucket").sortWithinPartitions(*order)
    return dealt.mapInPandas(_finish, SCHEMA)


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, candidate_edited boolean"
)


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None  # a document that waits for the next one
    for batch in batches:
        out = []
        for bucket, tail, doc_id, text in zip(batch["bucket"], batch["tail"], batch["doc_id"], batch["text"], strict=True):
            if tail and (held is None or held[0] != bucket):
                continue  # a further copy of the bucket's end
            codes = _codes(text)
            steps = walk(codes)
            fp = _sampled(codes, steps)
            if held is not None and held[0] == bucket:
                out.append(_row(*held[1:], text, codes, fp))
            held = None if tail else (bucket, doc_id, text, codes, steps, fp)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})


def _row(doc_id, text, codes, steps, fp, next_text, next_codes, next_fp) -> tuple:
    n = len(codes)
    keep = n - n // 3
    edited = text[:keep] + next_text[: n // 3]
    tail = next_codes[: n // 3]
    # the walk over the part that stays is known
    edited_steps = np.concatenate([steps[:keep], walk(tail, int(steps[keep]))])
    edited_fp = _sampled(np.concatenate([codes[:keep], tail]), edited_steps)
    return (
        None if pd.isna(doc_id) else int(doc_id), n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fp, edited_fp,
        likeness(fp, edited_fp), likeness(fp, next_fp), not set(band_names(fp)).isdisjoint(band_names(edited_fp)),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row; null texts count as empty."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def sign(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint)

    return docs.select("doc_id", sign(F.coalesce("text", F.lit(""))).alias("fingerprint"))


def similar_groups(docs: DataFrame, at_least: float = 0.5) -> DataFrame:
    """``doc_id, group_id`` of documents linked by bands and verified by likeness; ids must be unique.

    Unrelated texts agree in a sixteenth of their samples; an edit costs what lies before the walks fall into
    step again. Equal fingerprints are one class; likeness of all samples decides. In each band every class is held
    against the smallest one first. Those that don't come into its group are then held against all of the band that
    are in other groups than theirs, so no link of a band is missed; that is many pairs where a large band has many of them.
    """
    signed = written(fingerprints(docs))
    classes = signed.groupBy("fingerprint").agg(F.min("doc_id").alias("node"))

    @F.pandas_udf("array<string>")
    def bands(fps: pd.Series) -> pd.Series:
        return fps.map(band_names)

    @F.pandas_udf("double")
    def like(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    named = written(classes.select("node", "fingerprint", F.explode(bands("fingerprint")).alias("band")))
    hubs = named.groupBy("band").agg(F.min(F.struct("node", "fingerprint")).alias("hub"))
    met = named.join(hubs, "band").where("hub.node < node").select("node", "fingerprint", "hub").distinct()
    links = met.where(like("hub.fingerprint", "fingerprint") >= at_least).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    known = connected_components(links)
    placed = written(named.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")))
    first = placed.groupBy("band").agg(F.min_by("component", "node").alias("first"))
    left = placed.join(first, "band").where("component <> first").select(
        "band", "first", F.col("node").alias("a"), F.col("fingerprint").alias("fp"), F.col("component").alias("other")
    )
    pairs = left.join(placed, "band").where("other <> component AND (component = first OR a < node)").select("a", "fp", "node", "fingerprint").distinct()
    more = pairs.where(like("fp", "fingerprint") >= at_least).select("a", F.col("node").alias("b"))
    found = connected_components(written(links.union(more)))
    top = classes.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("group_id"))
    return signed.join(top, "fingerprint").select("doc_id", "group_id")
