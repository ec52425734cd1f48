"""The trie of conversation prefixes, built level by level.

A node is a distinct sequence of first turns; within its depth the smallest conv_id of its members names it. Going
down, each depth groups the live conversations by (parent node, next turn) and gives every group its least conv_id.
Going up, each depth's nodes are joined to their parents with the leaves and savings of all below.

A conversation that is alone in its node is not live any more: what is left of it is a chain
that nothing else shares, and its nodes follow from its length. So there are as many rounds as turns that two
conversations share, each over the conversations that still share something. A turn is known by its SHA-256,
and texts are read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, settle

#: Turns that a conversation may take from the first of its hundred: fewer than this.
SHARED = 6
CHUNK = 1 << 16
STEP = 1 << 12


def numbered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, i, key, chars): the turns of every conversation from 1 on, by turn (null first), role and text; key stands for role and text."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    made = rows.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), whole(role_col).alias("role"), whole(text_col).alias("text"))
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return made.select("conv", F.row_number().over(order).cast("long").alias("i"), key.alias("key"), F.length("text").cast("long").alias("chars"))


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, i, key, chars): the first h turns of conversation conv - conv % 100, then the conversation's own after its first h; h = crc32(conv) % 6."""
    h = F.crc32(F.col("conv").cast("string")) % SHARED
    heads = turns.where((F.col("i") < SHARED) & (F.col("conv") % 100 == 0)).groupBy(F.col("conv").alias("base")).agg(F.collect_list(F.struct("i", "key", "chars")).alias("head"))  # at most 5 turns each
    taken = convs.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base")).join(heads, "base", "left")
    taken = taken.select("conv", "h", F.filter("head", lambda t: t["i"] <= F.col("h")).alias("head"))
    first = taken.select("conv", F.inline("head"))
    own = turns.join(taken.select("conv", "h", F.coalesce(F.size("head"), F.lit(0)).alias("n")), "conv").where(F.col("i") > F.col("h"))
    return first.unionByName(own.select("conv", (F.col("n") + F.col("i") - F.col("h")).alias("i"), "key", "chars"))


def _streamed(batches: Iterator[pa.RecordBatch], into) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (depth, node) through into(depth, node, piece) -> rows; into(None, None, None) ends it."""
    names, types = ["depth", "node", "first", "piece"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    out: list[tuple] = []

    def packed() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        out.clear()
        return made

    size = 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            for made in into(*row):
                out.append(made)
                size += len(made[3])
            if size > 4 << 20 or len(out) > 1 << 14:
                yield packed()
                size = 0
    out.extend(into(None, None, None, None))
    if out:
        yield packed()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, node, conv, decimal conv) in order -> pieces of joined ids, a new one after CHUNK characters."""
    at: tuple | None = None
    first, held, size = 0, [], 0

    def into(depth, node, conv, text):
        nonlocal at, first, held, size
        if held and ((depth, node) != at or size > CHUNK):
            yield (*at, first, ",".join(held))
            held, size = [], 0
        if not held:
            at, first = (depth, node), conv
        if text is not None:
            held.append(text)
            size += len(text) + 1

    yield from _streamed(batches, into)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a node in order -> its digest; one piece is held at a time."""
    at, running = None, None

    def into(depth, node, first, piece):
        nonlocal at, running
        if running is not None and (depth, node) != at:
            yield (*at, 0, running.hexdigest())
            running = None
        if piece is not None:
            if running is None:
                at, running = (depth, node), hashlib.sha256(piece.encode())
            else:
                running.update(f",{piece}".encode())

    yield from _streamed(batches, into)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of (depth, node, conv): SHA-256 of a node's decimal ids in ascending order, joined by commas.

    Ranges of (depth, node, conv) are joined into pieces of about 64 KB wherever their node's other ids are; the digest
    itself can only be taken in order, so a node's pieces run through one task, one at a time.
    """
    schema = "depth long, node long, first long, piece string"
    dealt = ends.select("depth", "node", "conv", F.col("conv").cast("string").alias("text")).repartitionByRange("depth", "node", "conv").sortWithinPartitions("depth", "node", "conv")
    pieces = dealt.mapInArrow(_chunks, schema)
    done = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(_hashed, schema)
    return done.select("depth", "node", F.col("piece").alias("ends_sha256"))


def _chain(alone: DataFrame) -> DataFrame:
    """(conv, depth): the depths below a node of one conversation, made in steps of 4096."""
    steps = F.sequence(F.col("depth") + 1, F.col("length"), F.lit(STEP).cast("long"))
    wide = alone.where(F.col("length") > F.col("depth")).select(F.col("node").alias("conv"), "length", F.explode(steps).alias("at"))
    return wide.select("conv", "length", F.explode(F.sequence("at", F.least(F.col("at") + STEP - 1, "length"))).alias("depth"))


def levels(turns: DataFrame, lengths: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], list[DataFrame]]:
    """Top-down: the nodes (depth, node, parent, n_convs, chars, length) of each depth, and the shared nodes' ends (depth, node, conv).

    turns is stored by depth, so a round reads its own depth only.
    """
    top = lengths.agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.max("length").alias("length"))
    root = top.where(F.col("n_convs") > 0).select(F.lit(0).cast("long").alias("depth"), "node", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("chars"), "length")
    nodes, ends, depth = [scratch.settle(root, "level")], [], 0
    first = nodes[0].head()
    live = lengths.select("conv", "length", F.lit(first.node if first else None).cast("long").alias("node"))
    shared = first is not None and first.n_convs > 1
    while shared:
        ends.append(live.where(F.col("length") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv"))
        depth += 1
        turn = turns.where(F.col("i") == depth).select("conv", "key", "chars")
        step = scratch.settle(live.where(F.col("length") >= depth).join(turn, "conv").select("conv", "length", F.col("node").alias("parent"), "key", "chars"), "step")
        found = step.groupBy("parent", "key").agg(F.min("conv").alias("node"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("length").alias("length"))
        found = scratch.settle(found.withColumn("depth", F.lit(depth).cast("long")), "level")
        nodes.append(found.drop("key"))
        several = found.where(F.col("n_convs") > 1)
        shared = bool(several.head(1))
        live = scratch.settle(step.join(several.select("parent", "key", "node"), ["parent", "key"]).select("conv", "length", "node"), "live") if shared else live
    return nodes, ends


def rolled(nodes: list[DataFrame], scratch: Scratch) -> list[DataFrame]:
    """Bottom-up: each depth's nodes with n_children, n_leaves and saved of their subtrees."""
    alone, out = F.col("n_convs") == 1, []
    below: DataFrame | None = None
    for level in reversed(nodes):
        own = (F.col("n_convs") - 1) * F.col("chars")
        if below is None:
            level = level.withColumns({"kids": F.lit(0).cast("long"), "leaves": F.lit(None).cast("long"), "saved": F.lit(0).cast("long")})
        else:
            up = below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            level = level.join(up, "node", "left")
        kids = F.when(alone, (F.col("length") > F.col("depth")).cast("long")).otherwise(F.coalesce("kids", F.lit(0)))
        done = level.select("depth", "node", "parent", "n_convs", "length", kids.alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), (own + F.coalesce("saved", F.lit(0))).cast("long").alias("saved_tokens"))
        below = scratch.settle(done, "rolled")
        out.append(below)
    return out


def trie(conversations: DataFrame, rebuild=rebuilt, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per node.

    rebuild(turns, conversations) gives the turns that the trie is made of (None: those of the table); the default lets
    conversations of one hundred share their beginnings. Rows are ordered by turn (null first), equal turns by role and
    text; null roles and texts are empty. Rows without conv_id belong to no conversation and are left
    out. A conversation that is left without turns ends at the root. An empty table gives no node, not even a root.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    own = scratch.settle(numbered(conversations, conv_col, turn_col, role_col, text_col), "own")
    convs = own.select("conv").distinct()
    made = own if rebuild is None else rebuild(own, convs)
    turns = scratch.settle(made.repartitionByRange("i", "conv").sortWithinPartitions("i"), "turns")  # files of few depths each
    lengths = scratch.settle(convs.join(turns.groupBy("conv").agg(F.count("*").alias("length")), "conv", "left").select("conv", F.coalesce("length", F.lit(0)).cast("long").alias("length")), "lengths")
    nodes, ends = levels(turns, lengths, scratch)
    each = reduce(DataFrame.unionByName, rolled(nodes, scratch))
    alone = each.where(F.col("n_convs") == 1)
    one = lambda conv: F.sha2(conv.cast("string"), 256)
    none = F.sha2(F.lit(""), 256)
    ended = F.col("length") == F.col("depth")

    def result(df: DataFrame, digest: Column, **given: Column) -> DataFrame:
        cols = {c: F.col(c) for c in ("depth", "n_convs", "n_children", "n_leaves", "saved_tokens")} | given
        return df.select(F.col("node").alias("conv_id"), cols["depth"].alias("depth"), F.col("parent").alias("parent_conv_id"), *(cols[c].cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), digest.alias("ends_sha256"))

    parts = [result(alone, F.when(ended, one(F.col("node"))).otherwise(none))]
    parts.append(result(_chain(alone).withColumns({"node": F.col("conv"), "parent": F.col("conv")}), F.when(ended, one(F.col("conv"))).otherwise(none), n_convs=F.lit(1), n_children=(~ended).cast("long"), n_leaves=F.lit(1), saved_tokens=F.lit(0)))
    if ends:
        digests = end_digests(reduce(DataFrame.unionByName, ends))
        parts.append(result(each.where(F.col("n_convs") > 1).join(digests, ["depth", "node"], "left"), F.coalesce("ends_sha256", none)))
    made = settle(reduce(DataFrame.unionByName, parts), "trie")
    scratch.clear()
    return made
