"""Optimiser trajectories against the same steps on whole matrices."""

import hashlib
import math
import re

import numpy as np
import pytest

from seenscope.operators import optimiser

TEXTS = [
    ("d", 1, "the cat sat on the mat the cat ran . . ."),
    ("d", 2, "a dog sat on a log"),
    (None, 3, "the the the the"),
    ("d", 4, "one"),
    ("d", 5, None),
    ("d", 6, ""),
    ("d", 7, "!! ..."),
]
PAIRS = [("", "the", 3), ("the", "cat", 2), ("cat", "sat", 1), ("sat", "on", 4)]


def bucket(word):
    return int(hashlib.md5(word.encode()).hexdigest()[0], 16)


def start():
    counts = np.zeros((16, 16))
    for u, t, n in PAIRS:
        if u:
            counts[bucket(u), bucket(t)] += n
    return np.log((counts + 1) / (counts.sum(1, keepdims=True) + 16))


def by_hand(text):
    """AdamW on all parameters at once."""
    words = text.split()
    n = np.zeros((16, 16))
    for u, t in zip(words, words[1:]):
        n[bucket(u), bucket(t)] += 1
    content = [w for w in words if re.search(r"[^\W_]", w)]
    at = bucket(content[-1] if content else words[-1])
    w, m, v = start(), np.zeros((16, 16)), np.zeros((16, 16))
    out = [(None, None, w[at])]
    for s in range(1, 6):
        ln_p = w - np.log(np.exp(w).sum(1, keepdims=True))
        g = (n.sum(1, keepdims=True) * np.exp(ln_p) - n) / n.sum()
        loss, norm = -(n * ln_p).sum() / n.sum(), math.sqrt((g * g).sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w * (1 - 0.1 * 0.01) - 0.1 * (m / (1 - 0.9**s)) / (np.sqrt(v / (1 - 0.999**s)) + 1e-8)
        out.append((loss, norm, w[at]))
    return out


@pytest.fixture(scope="module")
def found(spark):
    items = spark.createDataFrame(TEXTS, "dataset_name STRING, id_num LONG, instruction_text STRING")
    state = optimiser.start_state(spark.createDataFrame(PAIRS, "prev STRING, tok STRING, c_pair LONG"))
    rows = optimiser.trajectory(items, state).collect()
    return {(r["id_num"], r["step"]): r for r in rows}


def test_steps_against_whole_matrices(found):
    assert {i for i, _ in found} == {1, 2, 3, 7}
    assert len(found) == 4 * 6
    for _, i, text in TEXTS:
        if (i, 0) not in found:
            continue
        for step, (loss, norm, vector) in enumerate(by_hand(text)):
            row = found[i, step]
            assert row["embedding"] == pytest.approx(list(vector), abs=1e-9)
            if step:
                assert row["loss"] == pytest.approx(loss, abs=1e-9)
                assert row["grad_norm"] == pytest.approx(norm, abs=1e-9)
            else:
                assert row["loss"] is None and row["grad_norm"] is None


def test_loss_falls_at_each_step(found):
    for i in (1, 2, 3, 7):
        losses = [found[i, s]["loss"] for s in range(1, 6)]
        assert all(b < a for a, b in zip(losses, losses[1:]))


def test_start_without_pairs(spark):
    state = optimiser.start_state(spark.createDataFrame([], "prev STRING, tok STRING, c_pair LONG")).collect()
    assert sorted(r["u"] for r in state) == list(range(16))
    assert all(x == pytest.approx(-math.log(16)) for r in state for x in r["w"])
