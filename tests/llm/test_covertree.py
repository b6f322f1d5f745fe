"""Cover tree and hard negatives against all scores."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seenscope.llm import covertree

VECTORS = "vec_id LONG, label INT, embedding ARRAY<FLOAT>, cell STRING, row INT"


def clustered(rng, n, dim, centres=6):
    middles = rng.normal(size=(centres, dim))
    x = middles[rng.integers(centres, size=n)] + 0.1 * rng.normal(size=(n, dim))
    return np.floor(256 * x / np.abs(x).max(initial=1))


@pytest.mark.parametrize("n", [0, 1, 70, 900])
def test_balls_cover_what_they_hold(n):
    rng = np.random.default_rng(n)
    x = clustered(rng, n, 5)
    x[n // 2 :] = x[: n - n // 2] if n > 500 else x[n // 2 :]  # copies
    rim = np.sqrt((x * x).sum(1).max(initial=0) - (x * x).sum(1))
    leaf, balls = covertree.build(x, rim)
    parent = {node: up for node, up, _, _ in balls}
    whole = np.column_stack([x, rim])
    for node, up, centre, radius in balls:
        below = {node}
        for other, above, _, _ in balls:  # parents come first
            if above in below:
                below.add(other)
        held = np.isin(leaf, list(below))
        far = np.sqrt(((whole[held] - whole[centre]) ** 2).sum(1))
        assert far.max() <= radius + 1e-6
        assert up < node and (up == -1) == (node == 0)
    assert n < 900 or len(balls) > 20
    assert set(leaf) <= set(parent)


def tree_of(x, ids, labels):
    norm = (x * x).sum(1).max(initial=0)
    vec = pa.array([list(map(int, r)) for r in x], pa.list_(pa.int32()))
    table = pa.table({"vec": vec, "id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.int32())})
    return covertree._tree(covertree._block_rows(table, norm, x.shape[1]), norm, x.shape[1])


def test_descent_finds_the_best_and_skips_balls():
    rng = np.random.default_rng(1)
    x, ids, labels = clustered(rng, 3000, 4, 30), rng.permutation(3000), rng.integers(3, size=3000)
    tree = tree_of(x, ids, labels)
    looked = []
    scores = covertree.scores
    for q in clustered(rng, 20, 4):
        all_scores = scores(x, q)
        for low, high in ((-math.inf, math.inf), (0, 9000), (5, 4), (7.0, 7.0)):
            windows = [covertree.Best(5, low, high), covertree.Best(5, low, high - 100)]
            tree.descend(q, windows, lambda labels, ids: (looked.append(len(ids)), labels == 1)[1])
            for w in windows:
                good = (labels == 1) & (all_scores >= w.low) & (all_scores <= w.high)
                wanted = sorted(zip(-all_scores[good], ids[good], strict=True))[:5]
                assert list(zip(-w.scores, w.ids, strict=True)) == wanted
    assert sum(looked) < 0.5 * 20 * 4 * len(x)


def test_scores_are_exact():
    x = np.array([[2.0**23, -3.0, 2.0**23], [1.0, 2.0, 3.0]])
    big = np.concatenate([x] * 3000, axis=1)
    wanted = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in big] for r in big]
    assert covertree.scores(big, big.T).tolist() == wanted


def brute(rows):
    good = []
    for key, label, vec, *_ in rows:
        if key is None or label is None or vec is None or any(v is None or not math.isfinite(v) for v in vec):
            continue
        good.append((key, label, [math.floor(256 * float(np.float32(v))) for v in vec]))
    score = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for key, label, vec in good:
        if key % 100:
            continue
        found = sorted((-score(vec, v), i, x) for i, x, v in good if x != label or i != key)
        positives = [(-s, i) for s, i, x in found if x == label][:5]
        for s, p in positives:
            negatives = [(-t, i) for t, i, x in found if x != label and 80 * s <= -100 * t <= 100 * s][:5]
            out += [(key, p, r + 1, i, s, t) for r, (t, i) in enumerate(negatives)]
    return sorted(out)


def find(spark, rows):
    scaled = covertree.scale_vectors(spark.createDataFrame(rows, VECTORS).repartition(3))
    return sorted(tuple(r) for r in covertree.hard_negatives(scaled, F.col("id") % 100 == 0).collect())


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 150)
    monkeypatch.setattr(covertree, "GROUP", 4)
    monkeypatch.setattr(covertree, "CELLS", 5)
    rng = np.random.default_rng(3)
    x = clustered(rng, 1200, 6) / 256
    x[400:800] = x[7]  # one vector in a third of the rows
    rows = [(i, int(rng.integers(4)), [float(v) for v in x[i]], "clash", 1) for i in range(1200)]
    rows += [(300, 1, rows[5][2], None, None), (11, 2, rows[5][2], None, None)]  # repeated ids
    random.Random(1).shuffle(rows)
    wanted = brute(rows)
    assert len(wanted) > 100
    assert find(spark, rows) == wanted


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (None, 1, [1.0, 1.0]), (0, None, [1.0, 1.0]), (0, 1, None), (0, 1, [1.0, None]), (0, 1, [nan, 1.0]),
        (0, 1, [inf, 1.0]), (100, 1, [1.0, 0.5]), (101, 1, [0.5, 0.5]), (102, 2, [0.5, 0.5]), (103, 2, [0.4]),
        (104, 2, []), (200, 2, []), (300, 3, [0.0, 0.0, 0.0]), (-100, 1, [-1.0, -0.5]), (105, 3, [-0.9, -0.5]),
        (400, 1, [40000.0, 1.0]), (500, 9, [0.1]),
    ]
    rows = [(*r, None, None) for r in rows]
    wanted = brute([r for r in rows if r[0] != 400])
    assert wanted
    assert find(spark, rows) == wanted
    assert find(spark, []) == []
    assert find(spark, rows[:1]) == []
    assert find(spark, [(1, 1, [1.0], None, None)]) == []
