"""Conversation prefix trie by composable monoid fingerprints.

A sequence of turns has a polynomial fingerprint: the sum of its turns' hashes, each times a power of a base that its
place chooses. Two fingerprints compose: that of a head followed by a suffix is the head's plus the suffix's times one
power, and a suffix's is a difference of two prefixes'. So the fingerprints of all prefixes of a rebuilt conversation come
from those of the two stored ones, and no rebuilt text is ever made. Prefixes that share a fingerprint are a node, which is
held against the turns that its members refer to: all must be one turn, and turns of one reference one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import broadcast_if_small, small_batches
from marginalia.scratch import written

#: A fingerprint is a residue for each base; sums of 2^32 residues stay below 2^63.
PRIME = (1 << 31) - 1
BASES = (1_000_003, 998_244_353, 48_271)
LANES = range(len(BASES))
#: A base's powers are products of table entries, one for each digit of the exponent: 256^5 turns in a conversation at most.
RADIX_BITS, DIGITS = 8, 5
#: Heads are of fewer turns than this; a rebuilt conversation's head is of its group of so many conversations.
MOST_HEAD, GROUP = 9, 5
#: Turns that are summed up together before a conversation's blocks are; ids whose text is hashed at once.
BLOCK_BITS, CHUNK_BITS = 12, 10


def _power(base: int, exponent: Column) -> Column:
    product = F.lit(1).cast("bigint")
    for digit in range(DIGITS):
        step = pow(base, 1 << (RADIX_BITS * digit), PRIME)
        table = F.expr("array(" + ",".join(f"{pow(step, k, PRIME)}L" for k in range(1 << RADIX_BITS)) + ")")
        place = F.shiftright(exponent, RADIX_BITS * digit).bitwiseAND((1 << RADIX_BITS) - 1)
        product = product * F.get(table, place.cast("int")) % PRIME
    return product


def head_size(conv_id: Column) -> Column:
    """Turns that a conversation takes from the first one of its group."""
    return F.crc32(conv_id.cast("string")) % MOST_HEAD


def turn_references(salt: int) -> tuple[Column, Column]:
    """What a turn is referred to by: 128 bits of its role and text."""
    return F.xxhash64(F.lit(2 * salt), "role", "text"), F.xxhash64(F.lit(2 * salt + 1), "role", "text")


def _residues(salt: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(31 * salt + k), "t1", "t2"), F.lit(PRIME)) for k in LANES]


def turns_in_order(turns: DataFrame, salt: int) -> DataFrame:
    """A row for each turn: ``conv_id, pos`` from 1, references, bytes, and the fingerprints ``f0..`` through it and ``b0..`` before it.

    Rows are dealt in ranges of (conv_id, turn), so a conversation of any length is spread; each range fingerprints its own
    rows, and a conversation's ranges compose.
    """
    t1, t2 = turn_references(salt)
    dealt = written(
        turns.repartitionByRange(F.col("conv_id"), F.col("turn").asc_nulls_first())
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
        .select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), t1.alias("t1"), t2.alias("t2"),
                F.octet_length("text").cast("bigint").alias("bytes"))
    )
    own = Window.partitionBy("conv_id", "part").orderBy("at")
    local = dealt.withColumn("k", F.row_number().over(own).cast("bigint")).withColumns(
        {f"h{i}": h * _power(BASES[i], F.col("k")) % PRIME for i, h in enumerate(_residues(salt))}
    )
    local = local.withColumns({f"s{i}": F.sum(f"h{i}").over(own) % PRIME for i in LANES})
    blocks = local.groupBy("conv_id", "part").agg(F.count("*").alias("n"), *[(F.sum(f"h{i}") % PRIME).alias(f"s{i}") for i in LANES])
    order = Window.partitionBy("conv_id").orderBy("part")
    blocks = blocks.withColumn("offset", F.sum("n").over(order) - F.col("n")).withColumns({f"x{i}": _power(BASES[i], F.col("offset")) for i in LANES})
    blocks = blocks.withColumns({f"m{i}": F.col(f"s{i}") * F.col(f"x{i}") % PRIME for i in LANES})
    before = blocks.select("conv_id", "part", "offset", *[f"x{i}" for i in LANES], *[((F.sum(f"m{i}").over(order) - F.col(f"m{i}")) % PRIME).alias(f"m{i}") for i in LANES])
    placed = local.join(before, ["conv_id", "part"])
    through = [((F.col(f"m{i}") + F.col(f"s{i}") * F.col(f"x{i}")) % PRIME).alias(f"f{i}") for i in LANES]
    until = [F.pmod(F.col(f"m{i}") + (F.col(f"s{i}") - F.col(f"h{i}")) * F.col(f"x{i}"), F.lit(PRIME)).alias(f"b{i}") for i in LANES]
    return placed.select("conv_id", (F.col("offset") + F.col("k")).alias("pos"), "t1", "t2", "bytes", *through, *until)


def rebuilt_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations (``conv_id, length``), and all their prefixes by references and fingerprints alone."""
    first = F.when(F.col("pos") < MOST_HEAD, F.struct("pos", "t1", "t2", "bytes", *[f"{c}{i}" for c in "fb" for i in LANES]))
    heads = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(first)).alias("firsts"))
    base = heads.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("firsts").alias("base_firsts"))
    joined = heads.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(base, "base", "left").withColumn("h", head_size(F.col("conv_id")))
    joined = joined.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)).cast("bigint"))).withColumn("left", F.least("h", "n"))

    def at(firsts: str, place: str, lane: int) -> Column:
        return F.coalesce(F.get(firsts, (F.col(place) - 1).cast("int"))[f"f{lane}"], F.lit(0).cast("bigint"))

    shift = (F.col("h") - F.col("taken")).cast("int")
    inverse = [F.get(F.expr("array(" + ",".join(f"{pow(b, -k, PRIME)}L" for k in range(MOST_HEAD)) + ")"), shift) for b in BASES]
    convs = joined.select(
        "conv_id", "h", "taken", "base_firsts", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        *[inverse[i].alias(f"y{i}") for i in LANES],
        *[F.pmod(at("base_firsts", "taken", i) - at("firsts", "left", i) * inverse[i], F.lit(PRIME)).alias(f"c{i}") for i in LANES],
    )
    of_base = convs.where("taken > 0").select("conv_id", "length", F.inline(F.slice("base_firsts", F.lit(1), F.col("taken").cast("int")))).withColumnRenamed("pos", "depth")
    own = turns.join(convs.drop("base_firsts"), "conv_id").where("pos > h")
    of_own = own.select(
        "conv_id", "length", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "t1", "t2", "bytes",
        *[((F.col(f"c{i}") + F.col(f"{c}{i}") * F.col(f"y{i}")) % PRIME).alias(f"{c}{i}") for c in "fb" for i in LANES],
    )
    return convs.select("conv_id", "length"), of_base.unionByName(of_own)


def _one_turn_each(nodes: DataFrame) -> bool:
    """Whether the members of every node agree on its last turn's reference; by induction they do then on all turns before."""
    return nodes.where("t1 <> u1 OR t2 <> u2").isEmpty()


def _one_text_each(turns: DataFrame, salt: int, ordered: DataFrame) -> bool:
    """Whether turns of one reference are of one role and text, byte by byte. Copies collapse before they are shuffled."""
    repeated = ordered.groupBy("t1", "t2").count().where("count > 1").select("t1", "t2")
    t1, t2 = turn_references(salt)
    named = turns.select(t1.alias("t1"), t2.alias("t2"), "role", "text").join(broadcast_if_small(repeated), ["t1", "t2"], "left_semi")
    return named.distinct().groupBy("t1", "t2").count().where("count > 1").isEmpty()


def _suffix_sums(rows: DataFrame, *columns: str) -> DataFrame:
    """Each conversation's columns summed from a depth to its end: in blocks, so that long conversations are spread."""
    blocked = rows.withColumn("block", F.shiftright("depth", BLOCK_BITS))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block"))
    long = blocked.where(F.col("length") >= 1 << BLOCK_BITS).groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in columns])
    after = long.select("conv_id", "block", *[(F.sum(c).over(later) - F.col(c)).alias(f"{c}_after") for c in columns])
    own = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth"))
    return blocked.join(after, ["conv_id", "block"], "left").withColumns(
        {c: F.sum(c).over(own) + F.coalesce(F.col(f"{c}_after"), F.lit(0)) for c in columns}
    )


def _hash_of_ids(ends: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of each key's ids, joined by commas in ascending order: ids come in chunks, and chunks go by one at a time."""
    small_batches(ends.sparkSession)
    chunk = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = ends.groupBy(*keys, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(chunk.alias("ids"))
    chunks = written(chunks)
    counted = chunks.join(chunks.groupBy(*keys).agg(F.count("*").alias("n")), keys)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for *now, ids in batch[[*keys, "ids"]].itertuples(index=False):
                if now != key:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*keys, "ends_sha256"])
        if state:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*keys, "ends_sha256"])

    short = counted.where("n = 1").select(*keys, F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    # only nodes at which very many conversations end: the order of the hash asks for one task each, which holds a batch at a time
    long = counted.where("n > 1").repartition(*keys).sortWithinPartitions(*keys, "chunk").select(*keys, "ids")
    return short.unionByName(long.mapInPandas(stream, short.schema))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations of ``conversations`` (``conv_id, turn, role, text``).

    A conversation is rebuilt from the first turns of its group's first one (``head_size``) and its own turns after as
    many. Turns are in order of ``turn``, null first; ties go by role, then text; repeated rows are turns of their own.
    Null roles and texts are empty; rows without ``conv_id`` take no part; other columns are not read. Texts may be of any
    length. An empty table has no node, not even the root; if all rebuilt conversations have no turn, the root is the only
    node, and a leaf. Should a fingerprint be shared by different prefixes, all is fingerprinted anew by other hashes.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    fingerprint, before = [f"f{i}" for i in LANES], [f"b{i}" for i in LANES]
    salt = 0
    while True:
        ordered = written(turns_in_order(turns, salt))
        convs, prefixes = map(written, rebuilt_prefixes(ordered))
        nodes = written(
            prefixes.groupBy("depth", *fingerprint).agg(
                F.min("conv_id").alias("first"), F.count("*").alias("n"), F.max("length").alias("longest"), F.min("bytes").alias("bytes"),
                F.min("t1").alias("t1"), F.max("t1").alias("u1"), F.min("t2").alias("t2"), F.max("t2").alias("u2"), *[F.min(b).alias(b) for b in before],
            )
        )
        if _one_turn_each(nodes) and _one_text_each(turns, salt, ordered):
            break
        salt += 1

    # a node's smallest member has a place for the node's own values; members sum up what is on their way to the end
    member = prefixes.select("conv_id", "length", "depth", *fingerprint).join(nodes.select("depth", *fingerprint, "first", "n", "longest", "bytes"), ["depth", *fingerprint])
    mine = F.col("conv_id") == F.col("first")
    leaf = mine & (F.col("depth") == F.col("longest"))
    member = written(
        member.select("conv_id", "length", "depth", "first", F.when(mine, (F.col("n") - 1) * F.col("bytes")).otherwise(0).alias("saved"), leaf.cast("bigint").alias("leaves"))
    )
    sums = _suffix_sums(member, "saved", "leaves").groupBy("first", "depth").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    # the root is summed up by itself, so that no key has all conversations; it is first = 0 at depth 0 here
    zero = F.lit(0).cast("bigint")
    own = member.where(mine)
    parts = [
        convs.select("conv_id", F.lit(1).alias("n"), zero.alias("children"), zero.alias("leaves"), zero.alias("saved")),
        own.select(F.lit(None).cast("bigint").alias("conv_id"), zero.alias("n"), (F.col("depth") == 1).cast("bigint").alias("children"), "leaves", "saved"),
    ]
    root = written(
        reduce(DataFrame.unionByName, parts)
        .agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")])
        .where("conv_id IS NOT NULL")
    )
    ends = member.where("depth = length").select("first", "depth", "conv_id").unionByName(convs.where("length = 0").select(zero.alias("first"), zero.alias("depth"), "conv_id"))
    hashes = _hash_of_ids(ends, ["first", "depth"])

    parent = [F.col(b).alias(f) for b, f in zip(before, fingerprint, strict=True)]
    children = nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), *parent).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(f).alias(b) for b, f in zip(before, fingerprint, strict=True)], F.col("first").alias("parent"))
    deep = nodes.where("depth > 1").join(above, ["depth", *before]).select("depth", *fingerprint, "first", "n", "parent")
    top = nodes.where("depth = 1").join(F.broadcast(root.select(F.lit(1).cast("bigint").alias("depth"), F.col("conv_id").alias("parent"))), "depth")
    every = deep.unionByName(top.select(*deep.columns)).join(children, ["depth", *fingerprint], "left").join(sums, ["first", "depth"])
    columns = ["first", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    below = every.select(
        "first", "depth", F.col("first").alias("conv_id"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
    )
    whole = root.select(
        zero.alias("first"), zero.alias("depth"), "conv_id", F.lit(None).cast("bigint").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.greatest("leaves", F.lit(1)).alias("n_leaves"), F.col("saved").alias("saved_tokens"),
    )
    named = below.unionByName(whole.select(*columns)).join(hashes, ["first", "depth"], "left")
    return named.select(*columns[2:3], "depth", *columns[3:], F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
