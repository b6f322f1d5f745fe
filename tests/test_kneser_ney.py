"""The model of order three against plain counting."""

import math
from collections import Counter

import pytest

from seenscope.operators import kneser_ney, scores

TEXTS = [
    ("d", 1, True, "the cat sat on the mat the cat ran on the mat"),
    ("d", 2, True, "a cat sat on a log and the cat sat"),
    (None, 3, True, "one"),
    ("d", 4, False, "the cat sat on unknown things on the"),
    ("e", 5, False, "zebra zebra zebra the cat"),
    ("e", 6, False, ""),
    ("e", 7, True, None),
]
SCHEMA = "dataset_name STRING, id_num LONG, seen BOOLEAN, instruction_text STRING"
D = 0.75


def grams(text):
    words = ["", "", *(text or "").split()]
    return list(zip(words, words[1:], words[2:]))


TRIPLES = Counter(g for _, _, seen, text in TEXTS if seen for g in grams(text))
PAIRS = Counter((v, w) for _, v, w in TRIPLES)
WORDS = Counter(w for _, w in PAIRS)


def probability(u, v, w):
    total = sum(WORDS.values())
    p = (max(WORDS[w] - D, 0) + D * len(WORDS) / (len(WORDS) + 1)) / total
    after = {x: k for (a, x), k in PAIRS.items() if a == v}
    if after:
        p = (max(PAIRS[v, w] - D, 0) + D * len(after) * p) / sum(after.values())
    after = {x: c for (a, b, x), c in TRIPLES.items() if (a, b) == (u, v)}
    if after:
        p = (max(TRIPLES[u, v, w] - D, 0) + D * len(after) * p) / sum(after.values())
    return p


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(TEXTS, SCHEMA)


@pytest.fixture(scope="module")
def model(items):
    return kneser_ney.fit(items)


def test_token_logprobs(items, model):
    found = kneser_ney.token_logprobs(items, kneser_ney.lookup(items, model)).collect()
    wanted = {(i, at): (g[2], math.log(probability(*g))) for _, i, _, t in TEXTS for at, g in enumerate(grams(t)) if at}
    assert {(r["id_num"], r["pos"]) for r in found} == set(wanted)
    for r in found:
        token, value = wanted[r["id_num"], r["pos"]]
        assert r["token"] == token
        assert r["logprob"] == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("context", [("the", "cat"), ("never", "the"), ("never", "seen"), ("", "the"), ("", "")])
def test_probabilities_sum_to_one(spark, model, context):
    """Over all words of the model and one that it does not know."""
    every = [*WORDS, "unknown"]
    rows = [("d", i, False, " ".join([*context, w])) for i, w in enumerate(every)]
    found = kneser_ney.lookup(spark.createDataFrame(rows, SCHEMA), model).collect()
    start = ["", "", *[c for c in context if c]][-2:]
    last = {r["tok"]: r["logprob"] for r in found if [r["prev2"], r["prev"]] == start}
    assert last.keys() >= set(every)
    assert sum(math.exp(last[w]) for w in every) == pytest.approx(1, abs=1e-9)


def test_scores_of_the_longer_model(items, model):
    table = scores.score_table(items, kneser_ney.sample_logprobs(items, kneser_ney.lookup(items, model)))
    rows = {r["id_num"]: r for r in table.collect()}
    assert len(rows) == len(TEXTS)
    for _, i, _, text in TEXTS:
        values = sorted(math.log(probability(*g)) for g in grams(text)[1:])
        assert rows[i]["num_tokens"] == len(values)
        if values:
            assert rows[i]["avg_nll"] == pytest.approx(-sum(values) / len(values))
            assert rows[i]["min_k_20"] == pytest.approx(-sum(values[: max(1, int(len(values) * 0.2))]) / max(1, int(len(values) * 0.2)))
        else:
            assert rows[i]["min_k_20"] == 0.0 and rows[i]["perplexity"] is None


def test_model_of_nothing(items):
    empty = kneser_ney.fit(items.where("false"))
    assert all(r["logprob"] == 0.0 for r in kneser_ney.lookup(items, empty).collect())
