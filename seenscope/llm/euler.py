"""Ranks of linked lists, and Euler tours of trees, as joins of tables.

A list is ranked by contraction: in every round the elements whose hash is below that of both
neighbours leave the list, about a third of them, and no two of them are neighbours. Each is
kept with its distance from the element before it. What is left at last, at most ``BASE``
elements, is walked in one task; then the rounds are undone, last one first. The work is in
proportion to the list, every table is written, and no step depends on how long a list is or
how many children a node has.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.llm.words import reachable
from seenscope.plans.carry import last_before
from seenscope.plans.materialize import materialize
from seenscope.plans.running import running_sums

# Elements walked in one task at the end: a fixed bound whatever the input.
BASE = 1 << 14


def _contract(links: DataFrame, turn: int) -> DataFrame:
    """The list without local minima of a hash; an element before one that left carries it as
    ``lost``, with its distance ``far``."""

    def draw(name: str) -> Column:
        return F.xxhash64(name, F.lit(turn))

    before = links.where("next IS NOT NULL").select(F.col("next").alias("at"), F.col("at").alias("before"))
    lowest = (draw("at") < draw("before")) & (draw("at") < draw("next"))
    inner = F.col("before").isNotNull() & F.col("next").isNotNull()
    seen = links.join(before, "at", "left").withColumn("leaves", lowest & inner)
    lost = seen.where("leaves").select(
        F.col("before").alias("at"),
        F.col("at").alias("lost"),
        F.col("next").alias("_next"),
        F.col("weight").alias("_weight"),
    )
    return (
        seen.where("NOT leaves")
        .join(lost, "at", "left")
        .select(
            "at",
            F.coalesce("_next", "next").alias("next"),
            (F.col("weight") + F.coalesce("_weight", F.lit(0))).alias("weight"),
            "lost",
            F.when(F.col("lost").isNotNull(), F.col("weight")).alias("far"),
        )
    )


def _walk(batches):
    after: dict[int, tuple[int | None, int]] = {}
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        after.update((a, (b, w)) for a, b, w in zip(*columns, strict=True))
    heads = after.keys() - {b for b, _ in after.values()}
    places, ranks = [], []
    for at in heads:
        rank = 0
        while at is not None:
            places.append(at)
            ranks.append(rank)
            at, weight = after[at]
            rank += weight
    yield pa.RecordBatch.from_arrays(
        [pa.array(places, pa.int64()), pa.array(ranks, pa.int64())], ["at", "rank"]
    )


def list_rank(links: DataFrame, base: int = BASE) -> DataFrame:
    """``(at, rank)``: the place, from 0, of every element of ``links(at, next)`` in its list.

    ``at`` is unique, ``next`` is null at the end of a list; there may be several lists, but
    no rings. An empty table gives an empty result; further columns are ignored.
    """
    reachable(links.sparkSession)
    links = links.select("at", "next", F.lit(1).cast("long").alias("weight"))
    links = materialize(links, "list")
    rounds: list[DataFrame] = []
    while links.count() > base:
        rounds.append(materialize(_contract(links, len(rounds)), "list"))
        links = rounds[-1].select("at", "next", "weight")
    ranks = materialize(links.repartition(1).mapInArrow(_walk, "at LONG, rank LONG"), "ranks")
    for kept in reversed(rounds):
        both = F.array(
            F.struct("at", "rank"),
            F.struct(F.col("lost").alias("at"), (F.col("rank") + F.col("far")).alias("rank")),
        )
        found = kept.join(ranks, "at").select(F.inline(F.filter(both, lambda x: x["at"].isNotNull())))
        ranks = materialize(found, "ranks")
    return ranks


def tour(tree: DataFrame) -> DataFrame:
    """``(node, leave, at, next)``: an arc into and an arc out of every node of
    ``tree(node, parent)``, each with the arc that follows it in the Euler tour.

    Nodes are numbers from 0, the parent of a root is null. Siblings are visited from the
    highest number down; a node with any number of children is spread over many tasks.
    """
    tree = tree.select("node", "parent")

    def into(name: str) -> Column:
        return F.col(name) * 2

    def out_of(name: str) -> Column:
        return F.col(name) * 2 + 1

    first = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.max("node").alias("first"))
    enter = tree.join(first, "node", "left").select(
        "node",
        F.lit(False).alias("leave"),
        into("node").alias("at"),
        F.coalesce(into("first"), out_of("node")).alias("next"),
    )
    beside = last_before(tree.where("parent IS NOT NULL"), "parent", F.col("node"), F.col("node"), "beside")
    roots = tree.where("parent IS NULL").withColumn("beside", F.lit(None).cast("long"))
    leave = beside.unionByName(roots).select(
        "node",
        F.lit(True).alias("leave"),
        out_of("node").alias("at"),
        F.coalesce(into("beside"), out_of("parent")).alias("next"),
    )
    return enter.unionByName(leave)


def subtree_sums(tree: DataFrame, values: list[str], base: int = BASE) -> DataFrame:
    """``(node, values)``: the sums of ``values`` over each node's subtree, itself included.

    The values of a node stand at its arc into the node; a subtree is the stretch of the tour
    between a node's two arcs, so its sum is a difference of two prefix sums. ``tree`` has one
    root, and values are whole numbers that are not null.
    """
    arcs = materialize(tour(tree), "tour")
    ranked = arcs.select("node", "leave", "at").join(list_rank(arcs, base), "at")
    held = ranked.join(tree.select("node", *values), "node").select(
        "node", "leave", "rank", *[F.when(~F.col("leave"), F.col(v)).otherwise(0).alias(v) for v in values]
    )
    summed = running_sums(held, [], "rank", values)
    return summed.groupBy("node").agg(
        *[
            (
                F.max(F.when(F.col("leave"), F.col(f"cum_{v}")))
                - F.max(F.when(~F.col("leave"), F.col(f"cum_{v}")))
                + F.max(v)
            ).alias(v)
            for v in values
        ]
    )
