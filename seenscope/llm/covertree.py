"""Exact search of largest inner products, and of those in a window, by a cover tree.

Vectors of whole numbers get one more component, so that all have the same norm M; then the
inner product with a query falls as the distance grows, ``|q - x|^2 = |q|^2 + M^2 - 2 q.x``, and
a ball of radius r around c holds no score outside
``(|q|^2 + M^2 - (d + r)^2) / 2`` to ``(|q|^2 + M^2 - max(0, d - r)^2) / 2``, d being the distance
of c.

The top level are cells around centres chosen farthest-first from a bounded sample, with radii
that cover all rows. Rows of a cell are dealt to blocks of bounded size; in a block, balls are
covered by smaller balls, level by level, each with the exact radius of what it holds. A query
descends from the ball with the highest bound, skips balls outside its windows or below the
scores it has, and scores the rows of the leaves it reaches one by one, so results are exact.

Queries and blocks meet by block and group of queries, so a task holds one block and a bounded
number of queries, whatever the size of either table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seenscope.llm.words import reachable
from seenscope.plans.materialize import materialize

# Bounds: rows sampled for the centres, centres, rows of a block and queries of a group (both
# on average over hashes), rows of a leaf and centres of one ball.
SAMPLE = 1024
CELLS = 64
BLOCK = 8192
GROUP = 8192
LEAF = 64
FANOUT = 32
# A ball whose covering shrinks by less is not divided: every row is near its rim.
SHRINK = 0.8
# Scores of components below this size fit a long, up to 65,536 dimensions.
LIMIT = 32768.0
SCALE = 256

ROWS = "row LONG, id LONG, label INT, vec ARRAY<INT>, sq LONG"


def scale_vectors(vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """``(id, label, vec, sq)``: each component x as floor(256 x), and their sum of squares.

    Rows with a null key, label, vector or component, or with a component that is not finite
    or has a size of 32768 or more, are left out; further columns are ignored.
    """
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < LIMIT, F.lit(False)))
    vec = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & good)
    scaled = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label"), vec.alias("vec"))
    squares = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    return scaled.withColumn("sq", squares)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole numbers as doubles; shorter ones are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes] or [[]]).astype(int)] = flat
    return out


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles."""
    largest = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[-1]
    if largest < 2.0**53:
        return (x @ y).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64)


def _distances(x, rim_x, y, rim_y) -> np.ndarray:
    """Between all rows of ``x`` and ``y``, with their further component ``rim``."""
    squares = (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(squares + (rim_x[:, None] - rim_y[None]) ** 2, 0))


def _farthest_first(x: np.ndarray, rim: np.ndarray, most: int, first: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Rows each farthest from those before; the nearest of them, and how far, for all rows."""
    chosen = [first]
    far = _distances(x, rim, x[[first]], rim[[first]])[:, 0]
    near = np.zeros(len(x), int)
    while len(chosen) < most and far.max(initial=0) > 0:
        at = int(far.argmax())
        d = _distances(x, rim, x[[at]], rim[[at]])[:, 0]
        closer = d < far
        near[closer], far[closer] = len(chosen), d[closer]
        chosen.append(at)
    return chosen, near, far


def build(x: np.ndarray, rim: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, float]]]:
    """The leaf of each row, and balls ``(node, parent, row of the centre, radius)``, the root
    first; its parent is -1."""
    leaf, balls = np.zeros(len(x), int), []
    first = int(((x - x.mean(0)) ** 2).sum(1).argmin()) if len(x) else 0
    todo = [(np.arange(len(x)), first, -1)] if len(x) else []
    while todo:
        own, centre, parent = todo.pop()
        far = _distances(x[own], rim[own], x[[centre]], rim[[centre]])[:, 0]
        node, radius = len(balls), float(far.max())
        balls.append((node, parent, centre, radius))
        leaf[own] = node
        if len(own) <= LEAF or radius == 0:
            continue
        chosen, near, rest = _farthest_first(x[own], rim[own], FANOUT, int(np.flatnonzero(own == centre)[0]))
        if rest.max() > SHRINK * radius:
            continue
        todo += [(own[near == i], int(own[c]), node) for i, c in enumerate(chosen)]
    return leaf, balls


@dataclass
class Tree:
    """One block."""

    x: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    centres: np.ndarray  # one row per ball
    radii: np.ndarray
    children: list[list[int]]
    members: list[np.ndarray]  # rows of each leaf
    norm: float  # M^2

    def bounds(self, q: np.ndarray, balls: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest scores that the balls may hold, with room for rounding."""
        whole = float(q @ q) + self.norm
        return ball_bounds(whole, self.centres[balls] @ q, self.radii[balls])

    def descend(self, q: np.ndarray, windows: list[Best], wanted) -> None:
        """Offer all rows that matter to the windows; ``wanted(labels, ids)`` says which rows
        may count."""
        heap = [(-np.inf, 0)]
        while heap:
            bound, ball = heapq.heappop(heap)
            if not any(-bound >= w.least() for w in windows):
                return
            if not self.children[ball]:
                rows = self.members[ball]
                rows = rows[wanted(self.labels[rows], self.ids[rows])]
                found = scores(self.x[rows], q)
                for w in windows:
                    w.offer(found, self.ids[rows])
                continue
            low, high = self.bounds(q, self.children[ball])
            for child, a, b in zip(self.children[ball], low, high, strict=True):
                if any(a <= w.high and b >= w.least() for w in windows):
                    heapq.heappush(heap, (-b, child))


def ball_bounds(whole, inner, radius) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score in balls, from ``|q|^2 + M^2`` and the scores of the centres."""
    d = np.sqrt(np.maximum(whole - 2 * inner, 0))
    room = 1e-6 * np.abs(whole) + 1e-3
    return (whole - (d + radius) ** 2) / 2 - room, (whole - np.maximum(d - radius, 0) ** 2) / 2 + room


class Best:
    """The ``k`` best scores between ``low`` and ``high``; ties go to the smaller id."""

    def __init__(self, k: int, low: float, high: float):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> float:
        """A row below this score does not count."""
        return max(self.low, self.scores[-1]) if len(self.scores) == self.k else self.low

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.least()) & (scores <= self.high)
        if good.any():
            scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


@dataclass(frozen=True)
class Index:
    """``rows``: every row with its cell, block and leaf, and the balls it is the centre of.
    Cells are few; their centres and radii travel with the tasks."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    blocks: list[int]  # of each cell
    norm: int
    dim: int


def _cell_rows(batches, centres, rims, norm, dim):
    for batch in batches:
        x = _matrix(batch.column("vec"), dim)
        rim = np.sqrt(np.maximum(norm - (x * x).sum(1), 0))
        d = _distances(x, rim, centres, rims)
        cell = d.argmin(1)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(x)), cell])],
            [*batch.schema.names, "cell", "far"],
        )


BALLS = pa.list_(pa.struct([("node", pa.int32()), ("up", pa.int32()), ("radius", pa.float64())]))


def _block_rows(table: pa.Table, norm, dim) -> pa.Table:
    x = _matrix(table.column("vec"), dim)
    leaf, balls = build(x, np.sqrt(np.maximum(norm - (x * x).sum(1), 0)))
    centre_of: dict[int, list] = {}
    for node, up, row, radius in balls:
        centre_of.setdefault(row, []).append({"node": node, "up": up, "radius": radius})
    return table.append_column("leaf", pa.array(leaf, pa.int32())).append_column(
        "balls", pa.array([centre_of.get(i) for i in range(len(x))], BALLS)
    )


def build_index(scaled: DataFrame) -> Index | None:
    """The index of all rows of :func:`scale_vectors`, written; None without rows."""
    spark = scaled.sparkSession
    reachable(spark)
    # Repeated ids are rows of their own.
    rows = materialize(
        scaled.select(F.monotonically_increasing_id().alias("row"), "id", "label", "vec", "sq"), "vectors"
    )
    norm, dim = rows.agg(F.max("sq"), F.max(F.size("vec"))).first()
    if norm is None:
        return None
    sample = rows.orderBy(F.xxhash64("row")).limit(SAMPLE).select("vec").toArrow()
    x = _matrix(sample.column("vec"), dim)
    rim = np.sqrt(np.maximum(norm - (x * x).sum(1), 0))
    chosen, _, _ = _farthest_first(x, rim, CELLS, 0)
    centres, rims = x[chosen], rim[chosen]
    placed = rows.mapInArrow(lambda b: _cell_rows(b, centres, rims, norm, dim), ROWS + ", cell INT, far DOUBLE")
    placed = materialize(placed, "cells")
    sizes = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    blocks = [-(-sizes[c]["n"] // BLOCK) if c in sizes else 0 for c in range(len(chosen))]
    radii = np.array([sizes[c]["far"] if c in sizes else -1.0 for c in range(len(chosen))])
    n_blocks = F.array(*[F.lit(max(b, 1)) for b in blocks])
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("row"), F.get(n_blocks, F.col("cell"))).cast("int")).drop("far")
    balls = "ARRAY<STRUCT<node: INT, up: INT, radius: DOUBLE>>"
    indexed = dealt.groupBy("cell", "block").applyInArrow(
        lambda table: _block_rows(table, norm, dim), f"{ROWS}, cell INT, block INT, leaf INT, balls {balls}"
    )
    return Index(materialize(indexed, "cover-tree"), centres, radii, blocks, norm, dim)


def _tree(table: pa.Table, norm, dim) -> Tree:
    x = _matrix(table.column("vec"), dim)
    nodes = [
        (b["node"], b["up"], row, b["radius"])
        for row, balls in enumerate(table.column("balls").to_pylist())
        for b in balls or ()
    ]
    nodes.sort()
    children: list[list[int]] = [[] for _ in nodes]
    for node, up, _, _ in nodes:
        if up >= 0:
            children[up].append(node)
    leaf = table.column("leaf").to_numpy()
    order = np.argsort(leaf, kind="stable")
    ends = np.searchsorted(leaf[order], np.arange(len(nodes) + 1))
    return Tree(
        x,
        table.column("id").to_numpy(),
        table.column("label").to_numpy(),
        x[[row for _, _, row, _ in nodes]],
        np.array([radius for *_, radius in nodes]),
        children,
        [order[ends[i] : ends[i + 1]] for i in range(len(nodes))],
        float(norm),
    )


def _search(tables: pa.Table, queries: pa.Table, norm, dim, k, same) -> pa.Table:
    """Each query's best rows of one block, for each of its windows."""
    out: list[tuple] = []
    if tables.num_rows and queries.num_rows:
        tree = _tree(tables, norm, dim)
        vectors = _matrix(queries.column("vec"), dim)
        columns = [queries.column(c).to_pylist() for c in ("row", "id", "label", "windows")]
        for q, row, key, label, given in zip(vectors, *columns, strict=True):
            windows = [Best(k, w["low"], w["high"]) for w in given]
            if same:
                tree.descend(q, windows, lambda labels, ids: (labels == label) & (ids != key))  # noqa: B023
            else:
                tree.descend(q, windows, lambda labels, ids: labels != label)  # noqa: B023
            for i, w in enumerate(windows):
                out += [(row, i, s, d) for s, d in zip(w.scores.tolist(), w.ids.tolist(), strict=True)]
    kinds = {"row": pa.int64(), "window": pa.int32(), "score": pa.int64(), "found": pa.int64()}
    return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(kinds.items())})


def _reached(batches, index: tuple, own: bool | None):
    """The cells each query has to look at: its own (True), the others (False) or all (None)
    whose scores may fall into a window."""
    centres, radii, norm, dim = index
    for batch in batches:
        q = _matrix(batch.column("vec"), dim)
        whole = (q * q).sum(1)[:, None] + norm
        low, high = ball_bounds(whole, q @ centres.T, radii[None])
        cells = batch.column("cell").to_pylist()
        reached = []
        for i, windows in enumerate(batch.column("windows").to_pylist()):
            hit = np.zeros(len(radii), bool)
            for w in windows:
                hit |= (low[i] <= w["high"]) & (high[i] >= w["low"])
            if own is True:
                hit = np.arange(len(radii)) == cells[i]
            elif own is False:
                hit[cells[i]] = False
            reached.append(np.flatnonzero(hit & (radii >= 0)).tolist())
        keep = [batch.column(c) for c in ("row", "id", "label", "vec", "windows")]
        yield pa.RecordBatch.from_arrays(
            [*keep, pa.array(reached, pa.list_(pa.int32()))], ["row", "id", "label", "vec", "windows", "reached"]
        )


WINDOWS = "windows ARRAY<STRUCT<low: DOUBLE, high: DOUBLE>>"


def search(index: Index, queries: DataFrame, n_queries: int, k: int, same: bool, own: bool | None = None) -> DataFrame:
    """``(row, window, score, found)``: for each query and each of its windows at least the
    ``k`` best rows of the same (else another) label, ties to the smaller id.

    ``queries(row, id, label, vec, cell, windows)`` are rows of the index; ``own`` limits the
    search to their own cell, or to the other ones. A row never finds its own id among the same
    label.
    """
    norm, dim = index.norm, index.dim
    groups = -(-n_queries // GROUP)
    held = (index.centres, index.radii, norm, dim)
    reached = queries.select("row", "id", "label", "vec", "cell", "windows").mapInArrow(
        lambda b: _reached(b, held, own), f"row LONG, id LONG, label INT, vec ARRAY<INT>, {WINDOWS}, reached ARRAY<INT>"
    )
    blocks = F.get(F.array(*[F.lit(max(b, 1)) for b in index.blocks]), F.col("cell"))
    sent = (
        reached.select("row", "id", "label", "vec", "windows", F.explode("reached").alias("cell"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    )
    rows = index.rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    keys = ["cell", "block", "group"]
    return (
        rows.groupBy(*keys)
        .cogroup(sent.groupBy(*keys))
        .applyInArrow(
            lambda tables, asked: _search(tables, asked, norm, dim, k, same),
            "row LONG, window INT, score LONG, found LONG",
        )
    )


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` per query and window, with their place from 1."""
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


RESULT = "anchor_id LONG, positive_id LONG, rank INT, negative_id LONG, positive_score LONG, negative_score LONG"


def hard_negatives(scaled: DataFrame, anchors: Column, k: int = 5, percent: int = 80) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``scaled`` is like :func:`scale_vectors`; ``anchors`` is a condition on its columns. An
    anchor's positives are the ``k`` best other rows of its label (rows that repeat its id do
    not count), and for each of them come the ``k`` best rows of other labels with a score
    between ``percent`` of the positive's and the positive's own. Larger scores come first,
    ties go to the smaller id. Vectors of different lengths meet on the components they share.
    Rows that repeat an id take part one by one. Without rows the result is empty.
    """
    spark = scaled.sparkSession
    index = build_index(scaled)
    if index is None:
        return spark.createDataFrame([], RESULT)
    every = F.array(F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    asked = index.rows.where(anchors).select("row", "id", "label", "vec", "cell", every.alias("windows"))
    asked = materialize(asked, "anchors")
    n = asked.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    # The own cell gives a limit that far cells do not reach.
    near = materialize(_first(search(index, asked, n, k, True, True), k).drop("rank"), "near")
    limit = near.groupBy("row").agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("limit"))
    raised = F.transform(
        "windows", lambda w: F.struct(F.coalesce("limit", w["low"]).alias("low"), w["high"].alias("high"))
    )
    limited = asked.join(limit, "row", "left").withColumn("windows", raised)
    far = search(index, limited, n, k, True, False)
    positives = _first(near.unionByName(far), k).select("row", F.struct("rank", "score", "found").alias("pair"))
    lists = positives.groupBy("row").agg(F.array_sort(F.collect_list("pair")).alias("pairs"))
    # Whole numbers: the least score is rounded up. Below zero a window is empty.
    windows = F.transform(
        "pairs",
        lambda p: F.struct(
            F.floor((p["score"] * percent + 99) / 100).cast("double").alias("low"),
            p["score"].cast("double").alias("high"),
        ),
    )
    paired = materialize(asked.join(lists, "row").withColumn("windows", windows), "windows")
    found = _first(search(index, paired, n, k, False), k)
    pair = F.get("pairs", F.col("window"))
    return found.join(paired.select("row", F.col("id").alias("anchor_id"), "pairs"), "row").select(
        "anchor_id",
        pair["found"].alias("positive_id"),
        "rank",
        F.col("found").alias("negative_id"),
        pair["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
