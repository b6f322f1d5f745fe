"""Word vectors and the vector of the last content word."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from seenscope.operators import language_model, scores, word_vectors

PAIRS = "prev STRING, tok STRING, c_pair LONG"


def matrix(counts):
    """The positive PPMI values, in full."""
    first, second = sorted({u for u, _ in counts}), sorted({t for _, t in counts})
    total = sum(counts.values())
    by_first, by_second = Counter(), Counter()
    for (u, t), n in counts.items():
        by_first[u] += n
        by_second[t] += n
    out = np.zeros((len(first), len(second)))
    for (u, t), n in counts.items():
        out[first.index(u), second.index(t)] = max(0, math.log(n * total / (by_first[u] * by_second[t])))
    return out, first, second


def some_counts(seed, words=30, n=400):
    rng = random.Random(seed)
    return Counter((f"w{min(rng.randrange(words), rng.randrange(words))}", f"w{rng.randrange(words) // 2}") for _ in range(n))


def fitted(spark, counts, **options):
    pairs = [(u, t, n) for (u, t), n in counts.items()] + [("", "w0", 9)]
    found = word_vectors.fit(spark.createDataFrame(pairs, PAIRS), **options).collect()
    return {r["word"]: r["vector"] for r in found}


def by_hand(counts, dim, turns):
    """The same multiplications with whole matrices."""
    whole, _, second = matrix(counts)
    used = whole.any(axis=0)

    def start(word):
        digits = hashlib.md5(f"42:start-0:{word}".encode()).hexdigest()
        return [int(digits[4 * i : 4 * i + 4], 16) / 32768 - 1 for i in range(dim)]

    right = np.array([start(w) for w in second]) * used[:, None]
    for turn in range(turns):
        if turn:
            right = np.linalg.qr(right)[0] * np.sign(np.diag(np.linalg.qr(right)[1]))
        left = whole @ right
        q, r = np.linalg.qr(left)
        right = whole.T @ (q * np.sign(np.diag(r)))
    vectors = right / np.sqrt(np.sqrt((right**2).sum(0)))
    return {w: v for w, v, u in zip(second, vectors, used, strict=True) if u}


def test_vectors_against_whole_matrices(spark):
    counts = some_counts(1)
    found, wanted = fitted(spark, counts, dim=3, turns=2), by_hand(counts, 3, 2)
    assert found.keys() == wanted.keys()
    for word, vector in found.items():
        assert vector == pytest.approx(wanted[word], abs=1e-9)


def test_vectors_are_the_leading_directions(spark):
    """Words of two groups that do not mix: one direction each."""
    groups = [[f"a{i}" for i in range(12)], [f"b{i}" for i in range(3)]]
    counts = {(u, t): n for group, n in zip(groups, (1, 2), strict=True) for u in group for t in group}
    found = fitted(spark, counts, dim=2, turns=4)
    large, small = 12 * math.log(162 / 144), 3 * math.log(162 / 18)
    for word, vector in found.items():
        wanted = [0, math.sqrt(large / 12)] if word[0] == "a" else [math.sqrt(small / 3), 0]
        assert [abs(v) for v in vector] == pytest.approx(wanted, abs=1e-3)


def test_rows_do_not_depend_on_the_partitions(spark):
    counts = some_counts(2)
    once = fitted(spark, counts, dim=3, turns=2)
    rows = spark.createDataFrame([(u, t, n) for (u, t), n in counts.items()], PAIRS).repartition(7)
    again = {r["word"]: r["vector"] for r in word_vectors.fit(rows, dim=3, turns=2).collect()}
    assert once.keys() == again.keys()
    for word in once:
        assert once[word] == pytest.approx(again[word], abs=1e-9)


def test_orthogonal_columns():
    rng = np.random.default_rng(3)
    block = rng.normal(size=(50, 5)) @ np.diag([1, 1e3, 1, 1e-3, 1])
    block[:, 4] = block[:, 0] + 2 * block[:, 2]  # depends on others
    made = block @ word_vectors.orthogonal(block.T @ block)
    assert made.T @ made == pytest.approx(np.diag([1, 1, 1, 1, 0]), abs=1e-9)


def test_fewer_directions_than_columns(spark):
    found = fitted(spark, Counter({("a", "b"): 3, ("b", "a"): 2}), dim=4, turns=2)
    assert found.keys() == {"a", "b"}
    assert all(v[2:] == [0.0, 0.0] for v in found.values())
    assert np.array([v[:2] for v in found.values()]).any()
    assert fitted(spark, Counter(), dim=4) == {}


def test_vector_of_the_last_content_word(spark):
    texts = [
        ("d", 1, "the cat sat on the mat . . ."),
        ("d", 2, "a dog sat on a mat"),
        ("d", 3, "the cat ran on the log !!"),
        ("d", 4, None),
        ("d", 5, ""),
        ("d", 6, "... !!"),
        ("d", 7, "unknown words"),
        (None, 8, "the mat"),
    ]
    items = spark.createDataFrame(texts, "dataset_name STRING, id_num LONG, instruction_text STRING")
    seen = items.where("id_num <= 3").selectExpr("*", "true AS seen")
    vectors = word_vectors.fit(language_model.fit(seen).pairs, 3)
    of = {r["word"]: r["vector"] for r in vectors.collect()}
    found = {r["id_num"]: r for r in scores.last_content_token(items, vectors, 3).collect()}
    assert {i: (r["last_pos"], r["last_token"]) for i, r in found.items()} == {
        1: (5, "mat"), 2: (5, "mat"), 3: (5, "log"), 6: (1, "!!"), 7: (1, "words"), 8: (1, "mat")
    }
    for i, word in ((1, "mat"), (2, "mat"), (3, "log"), (8, "mat")):
        assert found[i]["vector"] == of[word] and any(of[word])
    assert found[6]["vector"] == of["!!"]
    assert found[7]["vector"] == [0.0, 0.0, 0.0]
    assert found[1]["vector"] != found[3]["vector"]
