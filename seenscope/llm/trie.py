"""Trie of conversation prefixes, with what sharing them would save.

A node is a sequence of turns that some conversation starts with; the root is the empty one.
The prefix of a turn is known by a running sum of hashes of (place, turn), so conversations of
any length are worked on in ranges, and a prefix's parent is that sum without the turn itself.
Nodes are numbered, the tree is toured (:mod:`seenscope.llm.euler`), and leaves and savings of
subtrees are differences of prefix sums along the tour.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.llm import euler
from seenscope.llm.words import reachable
from seenscope.plans.joins import lookup_join
from seenscope.plans.materialize import materialize
from seenscope.plans.running import running_sums

WORD = "[^\\x20\\x09-\\x0D]+"
CHUNK = 1 << 16
# The 128 bits of a hash, as numbers whose sums stay far below the largest long.
PARTS = ["h0", "h1", "h2", "h3"]
ROOT = hashlib.md5(b"0:0:0:0").hexdigest()


def place_turns(turns: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn_hash, words)``: the turns of each conversation numbered from 1 in
    the order of ``turn`` (null first), then role, then a hash of the text.

    A null role or text counts as empty; rows with a null ``conv_id`` are left out, repeated
    rows are turns of their own. Further columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    marked = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull(), F.col("turn"), role, F.md5(text), F.monotonically_increasing_id()
        ).alias("_order"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_hash"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.lit(1).cast("long").alias("one"),
    )
    placed = running_sums(marked, ["conv_id"], "_order", ["one"])
    return placed.select("conv_id", F.col("cum_one").alias("pos"), "turn_hash", "words")


def _node(sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(":", *[s.cast("string") for s in sums]))


def prefixes(placed: DataFrame) -> DataFrame:
    """``(conv_id, depth, node, parent, words, last)`` per turn; ``last`` marks the whole
    conversation."""
    digest = F.md5(F.concat_ws(":", F.col("pos").cast("string"), "turn_hash"))
    hashed = placed.withColumn("_digest", digest).select(
        "conv_id",
        "pos",
        "words",
        F.lit(1).cast("long").alias("one"),
        *[
            F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long").alias(h)
            for i, h in enumerate(PARTS)
        ],
    )
    summed = running_sums(hashed, ["conv_id"], "pos", ["one", *PARTS])
    return summed.select(
        "conv_id",
        F.col("cum_one").alias("depth"),
        _node([F.col(f"cum_{h}") for h in PARTS]).alias("node"),
        _node([F.col(f"cum_{h}") - F.col(h) for h in PARTS]).alias("parent"),
        "words",
        (F.col("cum_one") == F.col("total_one")).alias("last"),
    )


def _join_ids(batches):
    """Sorted ``(node, conv_id, part)`` to pieces of text, in order."""

    def piece(node, part, number, ids):
        columns = [[node], [part], [number], [",".join(map(str, ids))]]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string()), strict=True)],
            ["node", "part", "number", "ids"],
        )

    node, part, number, ids = None, None, 0, []
    for batch in batches:
        for n, i, p in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
            if ids and (n != node or len(ids) >= CHUNK):
                yield piece(node, part, number, ids)
                number, ids = number + 1, []
            node, part = n, p
            ids.append(i)
    if ids:
        yield piece(node, part, number, ids)


def _hash_pieces(batches):
    """Pieces sorted by node, part and number to one digest per node, as a stream."""
    node, state, out = None, None, []

    def result(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["node", "ends_sha256"]
        )

    for batch in batches:
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n == node:
                state.update(b",")
            else:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256()
            state.update(ids.encode())
        if len(out) >= CHUNK:
            yield result(out)
            out = []
    if state is not None:
        out.append((node, state.hexdigest()))
    yield result(out)


def id_digests(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)``: SHA-256 of each node's ``conv_id``, rising, joined by commas.

    Ids are sorted and joined in ranges; what one task reads of a node are its pieces of text,
    one after the other, so memory does not grow with the node.
    """
    reachable(ends.sparkSession)
    ranged = ends.select("node", "conv_id").repartitionByRange("node", "conv_id")
    pieces = (
        ranged.sortWithinPartitions("node", "conv_id")
        .select("node", "conv_id", F.spark_partition_id().alias("part"))
        .mapInArrow(_join_ids, "node STRING, part INT, number LONG, ids STRING")
    )
    pieces = materialize(pieces, "end-pieces")
    return (
        pieces.repartition("node")
        .sortWithinPartitions("node", "part", "number")
        .select("node", "ids")
        .mapInArrow(_hash_pieces, "node STRING, ends_sha256 STRING")
    )


def prefix_trie(placed: DataFrame, members: DataFrame, base: int = euler.BASE) -> DataFrame:
    """One row per node: ``node`` (a hash), ``conv_id`` (its smallest member), ``depth``,
    ``parent`` and ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` of its subtree, and ``ends_sha256``, a digest of the
    members that end there.

    ``placed`` is like :func:`place_turns`; ``members(conv_id)`` names every conversation once,
    those without turns, too. The last turn of a node is turn ``depth`` of conversation
    ``conv_id``. Without members the result is empty.
    """
    found = materialize(prefixes(placed), "prefixes")
    members = materialize(members.select("conv_id"), "members")
    nodes = found.groupBy("node").agg(
        F.min("parent").alias("parent"),
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.count("*").alias("n_convs"),
        F.min("words").alias("words"),
    )
    top = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = top.select(
        F.lit(ROOT).alias("node"),
        F.lit(None).cast("string").alias("parent"),
        "conv_id",
        F.lit(0).cast("long").alias("depth"),
        "n_convs",
        F.lit(0).cast("long").alias("words"),
    )
    nodes = materialize(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(kids, "node", "left").na.fill(0, ["n_children"]), "nodes")
    # The root may be the parent of most nodes.
    parents = nodes.where("n_children > 0").select(
        F.col("node").alias("parent"),
        F.col("id").alias("parent_id"),
        F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("uses"),
    )
    tree = materialize(lookup_join(nodes, parents, ["parent"]), "tree")
    sums = euler.subtree_sums(
        tree.select(
            F.col("id").alias("node"),
            F.col("parent_id").alias("parent"),
            (F.col("n_children") == 0).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        ),
        ["n_leaves", "saved_tokens"],
        base,
    ).withColumnRenamed("node", "id")
    whole = found.where("last").select("node", "conv_id")
    turnless = members.join(whole.select("conv_id"), "conv_id", "left_anti").select(F.lit(ROOT).alias("node"), "conv_id")
    digests = id_digests(whole.unionByName(turnless))
    return (
        tree.join(sums, "id")
        .join(digests, "node", "left")
        .select(
            "node",
            "conv_id",
            "depth",
            "parent",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


def share_openings(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with borrowed openings, and the ids of all: conversation c gets the first
    h turns of conversation c - c % 20, then its own turns after its first h, where h is the
    CRC-32 of the decimal c, modulo 4. ``%`` takes the sign of c."""
    placed = materialize(placed, "placed")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    convs = placed.groupBy("conv_id").agg(F.max("pos").alias("n")).select(
        "conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("lender")
    )
    convs = materialize(convs, "conversations")
    lenders = convs.where("conv_id % 20 = 0").select(F.col("conv_id").alias("lender"), F.col("n").alias("_n"))
    borrowed = convs.join(lenders, "lender", "left").select(
        "conv_id", "lender", "h", F.least("h", F.coalesce("_n", F.lit(0))).alias("n_borrowed")
    )
    borrowed = materialize(borrowed, "borrowed")
    openings = placed.where("conv_id % 20 = 0 AND pos <= 3").withColumnRenamed("conv_id", "lender")
    first = borrowed.join(openings, "lender").where("pos <= h").select("conv_id", "pos", "turn_hash", "words")
    own = placed.join(borrowed, "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("n_borrowed")).alias("pos"), "turn_hash", "words"
    )
    return first.unionByName(own), convs.select("conv_id")
