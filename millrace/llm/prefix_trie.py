"""Prefix trie of conversations by vertical bitmaps.

Conversations are dealt to shards of about ``SHARD`` conversations. A shard's index is vertical: for every (position, turn) a
bitset of the shard's conversations that have this turn there. The trie comes from it depth first: the bitset of a node and
the postings of the next position intersect to the bitsets of its children; a popcount is a node's number of members, and
what ends at its depth its end list. Long conversations are cut into segments of ``SEGMENT`` positions, each a task of its own,
that start from the groups of conversations with the same beginning.

A node's name is the exclusive or of 128-bit hashes of its (position, turn) pairs. It can be had for any segment without
reading those before it in order, and shards agree on it, so nodes that several shards share are added up by name: a hot
beginning is one row per shard. Sums over subtrees don't climb the tree: every value belongs to the smallest member of its
node, and a node's subtree holds the values of all its members less those of its own smallest member further up.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.llm.batches import quoted
from millrace.plans.runs import numbered, running_sums
from millrace.session import cut

SHARD = 1024
SEGMENT = 64
CHUNK = 1024
PIECE_IDS = 1024
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "hi", "lo"]
_LOCAL = (
    "depth long, hi long, lo long, parent_hi long, parent_lo long, conv long, n long, words long, ends array<long>, members array<long>"
)
_NODE_NAMES = [c.split()[0] for c in _LOCAL.split(", ")]


@dataclass(frozen=True)
class Trie:
    """``nodes``: one row per node, named by depth, hi and lo. ``ends``: (depth, hi, lo, conv), each conversation with the node it
    ends at."""

    nodes: DataFrame
    ends: DataFrame


def ordered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, position, mark, words): the turns of every conversation from 1, by ``turn`` (null first), then role and text digest.

    Null roles and texts are empty. Rows without a conversation belong to none and are left out; repeated rows are turns
    of their own. ``words`` counts the words of the text. Other columns are not read.
    """
    column = lambda name: F.col(quoted(name))
    who, said = F.coalesce(column(role), F.lit("")), F.coalesce(column(text), F.lit(""))
    rows = conversations.where(column(conv).isNotNull()).select(
        column(conv).cast("long").alias("conv"), column(turn).cast("long").alias("turn"),
        F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary")).alias("mark"),
        F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"),
    )
    chunk = F.floor(F.col("turn") / CHUNK)
    placed = numbered(rows, ["conv"], [F.asc_nulls_first("turn"), "mark"], chunk, "position")
    return placed.select("conv", "position", "mark", "words")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(turns, turnless): every conversation c begins with the first h turns of c - c % group and goes on after its own first h.

    h is crc32(c) mod (most + 1), fewer where that conversation is shorter, none where it is absent. ``turnless`` has the
    conversations that are left without a turn.
    """
    turns = cut(turns, "turns")
    first = lambda c: c - c % group
    own = turns.groupBy("conv").agg(F.count("*").alias("own"), F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most + 1)).alias("h"))
    heads = turns.where((F.col("position") <= most) & (F.col("conv") == first(F.col("conv"))))
    heads = heads.groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("position", "mark", "words"))).alias("head"))
    convs = own.withColumn("base", first(F.col("conv"))).join(heads, "base", "left")
    convs = convs.withColumn("head", F.when(F.col("h") > 0, F.slice("head", 1, F.greatest(F.col("h"), F.lit(1)).cast("int"))))
    convs = cut(convs.select("conv", "own", "h", F.coalesce("head", F.array().cast("array<struct<position:long,mark:string,words:long>>")).alias("head")), "convs")
    borrowed = convs.select("conv", F.inline("head"))
    later = turns.join(convs.select("conv", "h", F.size("head").alias("taken")), "conv").where("position > h")
    later = later.select("conv", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), "mark", "words")
    return borrowed.union(later), convs.where((F.size("head") == 0) & (F.col("own") <= F.col("h"))).select("conv")


def _segments(turns: DataFrame, turnless: DataFrame) -> DataFrame:
    """(conv, segment, hi, lo, goes_on, turns): the name of what stands before each segment, and the segment's turns."""
    bits = lambda salt: F.xxhash64(F.lit(salt), "position", "mark")
    named = turns.select("conv", F.floor((F.col("position") - 1) / SEGMENT).alias("segment"), F.struct("position", bits(1).alias("hi"), bits(2).alias("lo"), "words").alias("turn"))
    own = named.groupBy("conv", "segment").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"), F.bit_xor("turn.hi").alias("own_hi"), F.bit_xor("turn.lo").alias("own_lo"),
    )
    own = cut(own, "segments")
    long_ones = (F.col("segment") > 0) | (F.size("turns") == SEGMENT)
    along = W.partitionBy("conv").orderBy("segment")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    entry = lambda c: F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("long"))
    goes_on = F.lead("segment").over(along).isNotNull()
    zero = F.lit(0).cast("long")
    return (
        own.where(~long_ones).select("conv", "segment", zero.alias("hi"), zero.alias("lo"), F.lit(False).alias("goes_on"), "turns")
        .union(own.where(long_ones).select("conv", "segment", entry("own_hi").alias("hi"), entry("own_lo").alias("lo"), goes_on.alias("goes_on"), "turns"))
        .union(turnless.select("conv", zero, zero, zero, F.lit(False), F.array().cast(own.schema["turns"].dataType)))
    )


def _grow(table: pa.Table) -> pa.Table:
    """All nodes of one segment of one shard."""
    table = table.sort_by("conv")
    convs = table.column("conv").to_pylist()
    turns = [[(t["hi"], t["lo"], t["words"]) for t in row] for row in table.column("turns").to_pylist()]
    start = table.column("segment")[0].as_py() * SEGMENT
    postings: dict[tuple, int] = {}
    lasting, ending = [0] * (SEGMENT + 2), [0] * (SEGMENT + 2)
    tops: dict[tuple[int, int], int] = {}
    for i, (row, goes_on, hi, lo) in enumerate(zip(turns, table.column("goes_on").to_pylist(), table.column("hi").to_pylist(), table.column("lo").to_pylist())):
        bit = 1 << i
        tops[hi, lo] = tops.get((hi, lo), 0) | bit
        for at, turn in enumerate(row, 1):
            postings[at, turn] = postings.get((at, turn), 0) | bit
            lasting[at] |= bit
        if not goes_on:
            ending[len(row)] |= bit
    rows: list[tuple] = []
    stack = [(members, 0, hi, lo, 0, 0, 0) for (hi, lo), members in tops.items()]
    while stack:
        members, at, hi, lo, parent_hi, parent_lo, words = stack.pop()
        if at or not start:
            smallest = convs[(members & -members).bit_length() - 1]
            rows.append((start + at, hi, lo, parent_hi, parent_lo, smallest, members.bit_count(), words, _ids(members & ending[at], convs), _ids(members, convs)))
        rest = members & lasting[at + 1]
        while rest:
            turn = turns[(rest & -rest).bit_length() - 1][at]
            child = members & postings[at + 1, turn]
            rest &= ~child
            stack.append((child, at + 1, hi ^ turn[0], lo ^ turn[1], hi, lo, turn[2]))
    columns = list(zip(*rows)) if rows else [()] * len(_NODE_NAMES)
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())] * 2
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NODE_NAMES)


def _ids(bits: int, convs: list[int]) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(convs[low.bit_length() - 1])
        bits ^= low
    return out


def build(turns: DataFrame, turnless: DataFrame, shard_of: Column | None = None) -> Trie:
    """The trie of conversations given as (conv, position, mark, words), positions from 1 without gaps; ``turnless`` has a conv
    for each conversation without turns. Turns are equal if their marks are. ``shard_of`` deals conversations to shards and
    should keep those with equal beginnings together; it changes no result. No conversations: no node.

    Node columns: depth, hi, lo, parent_hi, parent_lo, conv (smallest member), n (members), words (of the last turn),
    parent_conv, n_children, n_leaves (childless nodes in the subtree), saved ((n - 1) * words over the subtree).
    """
    segments = cut(_segments(turns, turnless), "entries")
    shards = -(-segments.where("segment = 0").count() // SHARD) or 1
    key = F.xxhash64(F.col("conv") if shard_of is None else shard_of)
    grown = segments.withColumn("shard", F.pmod(key, F.lit(shards))).groupBy("shard", "segment").applyInArrow(_grow, _LOCAL)
    local = cut(grown, "nodes")
    merged = local.groupBy(*NODE).agg(
        F.min("conv").alias("conv"), F.sum("n").alias("n"), F.max("words").alias("words"),
        F.max("parent_hi").alias("parent_hi"), F.max("parent_lo").alias("parent_lo"),
    )
    merged = cut(merged, "merged")
    above = [(F.col("depth") - 1).alias("depth"), F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo")]
    children = merged.where("depth > 0").select(*above).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    own = merged.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = own.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("words")})
    own = cut(own, "valued")
    # what the smallest member of a node has above it is no part of the node's subtree
    upto = running_sums(own, ["conv"], ["depth"], F.floor(F.col("depth") / CHUNK), {"leaf_upto": F.col("leaf"), "saved_upto": F.col("saved")})
    totals = own.groupBy("conv").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saves"))
    members = local.select(*NODE, F.explode("members").alias("conv"))
    below = members.join(totals, "conv").groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saves").alias("saves"))
    parents = merged.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv").alias("parent_conv"))
    nodes = upto.join(below, NODE).join(parents, ["depth", "parent_hi", "parent_lo"], "left")
    nodes = nodes.select(
        *NODE, "parent_hi", "parent_lo", "conv", "n", "words", "parent_conv", "n_children",
        (F.col("leaves") - F.col("leaf_upto") + F.col("leaf")).alias("n_leaves"), (F.col("saves") - F.col("saved_upto") + F.col("saved")).alias("saved"),
    )
    return Trie(nodes, local.where(F.size("ends") > 0).select(*NODE, F.explode("ends").alias("conv")))


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, hi, lo, digest): SHA-256 of the ascending conversation ids, joined by commas, that end at each node.

    Ids are gathered in ranges of ``PIECE_IDS``. A node with several ranges has them hashed one after the other from a sorted
    partition: a SHA-256 cannot be put together from parts, but one text piece is all a task holds.
    """
    pieces = ends.groupBy(*NODE, F.floor(F.col("conv") / PIECE_IDS).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    pieces = cut(pieces, "ends")
    counted = pieces.groupBy(*NODE).agg(F.count("*").alias("pieces"), F.min("ids").alias("ids"))
    single = counted.where("pieces = 1").select(*NODE, F.sha2("ids", 256).alias("digest"))
    several = pieces.join(counted.where("pieces > 1").select(*NODE), NODE, "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        done = lambda: pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in node], pa.array([state.hexdigest()])], [*NODE, "digest"])
        for batch in batches:
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in NODE], batch.column("ids").to_pylist()):
                if key != node:
                    if node:
                        yield done()
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if node:
            yield done()

    return single.union(several.select(*NODE, "ids").mapInArrow(run, "depth long, hi long, lo long, digest string"))
