"""Language model, scores, trajectories and evaluation against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seenscope.operators import (
    classifier,
    evaluate,
    features,
    language_model,
    scores,
    trajectory,
)

TEXTS = [
    ("d", 1, True, "the cat sat on the mat the cat ran"),
    ("d", 2, False, "the dog sat on the log"),
    ("d", 3, True, "one"),
    ("d", 4, False, ""),
    ("e", 1, False, "The cat sat\ton THE mat"),
    ("e", 2, True, "a b a b a b ... !!"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        TEXTS, "dataset_name STRING, id_num LONG, seen BOOLEAN, instruction_text STRING"
    )


@pytest.fixture(scope="module")
def model(items):
    return language_model.lookup(items, language_model.fit(items))


def _counts():
    pairs, tokens = Counter(), Counter()
    for _, _, seen, text in TEXTS:
        words = text.lower().split()
        if seen:
            tokens.update(words)
            pairs.update(zip(words, words[1:]))
    contexts = Counter()
    for (prev, _), n in pairs.items():
        contexts[prev] += n
    return pairs, contexts, tokens


def _logprobs(text, steps=0):
    pairs, contexts, tokens = _counts()
    total, distinct = sum(tokens.values()), len(tokens)
    words = text.lower().split()
    own = Counter(zip(words, words[1:]))
    own_prev = Counter(words[:-1])
    return [
        math.log(
            (pairs[u, t] + steps * own[u, t] + (tokens[t] + 1) / (total + distinct + 1))
            / (contexts[u] + steps * own_prev[u] + 1)
        )
        for u, t in zip(words, words[1:])
    ]


def test_min_k_and_perplexity(items, model):
    found = scores.score_table(items, language_model.sample_logprobs(items, model)).collect()
    assert len(found) == len(TEXTS)
    for row in found:
        text = next(t for d, i, _, t in TEXTS if (d, i) == (row["dataset_name"], row["id_num"]))
        values = sorted(_logprobs(text))
        assert row["num_tokens"] == len(values)
        for ratio, k in zip(scores.K_RATIOS, (10, 20, 30, 50)):
            if values:
                lowest = values[: max(1, int(len(values) * ratio))]
                assert row[f"min_k_{k}"] == pytest.approx(-np.mean(lowest), abs=1e-8)
            else:
                assert row[f"min_k_{k}"] == 0.0
        if values:
            assert row["perplexity"] == pytest.approx(math.exp(-np.mean(values)))
            assert row["min_k_10"] >= row["min_k_20"] >= row["min_k_30"] >= row["min_k_50"]
        else:
            assert row["perplexity"] is None


def test_trajectory(items, model):
    found = trajectory.trajectory(language_model.model_cells(items, model)).collect()
    states = {(r["dataset_name"], r["id_num"], r["step"]): r for r in found}
    long_enough = [t for t in TEXTS if len(t[3].split()) > 1]
    assert len(states) == 6 * len(long_enough)
    for name, id_num, _, text in long_enough:
        words = text.lower().split()
        own, own_prev = Counter(zip(words, words[1:])), Counter(words[:-1])
        for step in range(6):
            row = states[name, id_num, step]
            assert sum(row["embedding"]) == pytest.approx(np.mean(_logprobs(text, step)), abs=1e-6)
            if step == 0:
                assert row["loss"] is None and row["grad_norm"] is None
                continue
            before = _logprobs(text, step - 1)
            assert row["loss"] == pytest.approx(-np.mean(before), abs=1e-8)
            p = {pair: math.exp(v) for pair, v in zip(zip(words, words[1:]), before)}
            squares = [((own_prev[u] * p[u, t] - n) / len(before)) ** 2 for (u, t), n in own.items()]
            assert row["grad_norm"] == pytest.approx(math.sqrt(sum(squares)), abs=1e-8)


def test_max_length_is_optional(items):
    whole = language_model.word_pairs(items).count()
    assert whole == sum(len(t[3].split()) for t in TEXTS)
    assert language_model.word_pairs(items, 3).where("pos >= 3").count() == 0


def test_last_content_token(spark, items):
    found = {
        (r["dataset_name"], r["id_num"]): (r["last_pos"], r["last_token"])
        for r in scores.last_content_token(items).collect()
    }
    assert ("d", 4) not in found
    assert found["e", 2] == (5, "b")
    assert found["d", 2] == (5, "log")
    special = spark.createDataFrame(
        [("d", 9, "... !!")], "dataset_name STRING, id_num LONG, instruction_text STRING"
    )
    row = scores.last_content_token(special).first()
    assert (row["last_pos"], row["last_token"]) == (1, "!!")


def test_texts_that_had_no_part_in_the_model(spark, items):
    """Unknown words and pairs count with the model's share of an unknown word, and a null
    dataset is one like any other."""
    texts = [("d", 9, "the cat flew over purple hills today"), (None, 9, "on the mat on the hill")]
    other = spark.createDataFrame(texts, "dataset_name STRING, id_num LONG, instruction_text STRING")
    found = language_model.lookup(other, language_model.fit(items))
    table = scores.score_table(other, language_model.sample_logprobs(other, found)).collect()
    states = trajectory.trajectory(language_model.model_cells(other, found))
    states = trajectory.with_split(states, other.withColumn("split", F.lit("eval"))).collect()
    assert len(table) == 2 and len(states) == 12
    for name, _, text in texts:
        (row,) = [r for r in table if r["dataset_name"] == name]
        values = _logprobs(text)
        assert row["num_tokens"] == len(values)
        assert row["avg_nll"] == pytest.approx(-np.mean(values))
        assert row["min_k_10"] == pytest.approx(-min(values)) and row["min_k_10"] > 0
        (first,) = [r for r in states if r["dataset_name"] == name and r["step"] == 1]
        assert first["loss"] == pytest.approx(-np.mean(values))
    empty = language_model.fit(items.where("false"))
    assert language_model.lookup(other, empty).where("base != 1").count() == 0


def test_null_datasets_keep_their_rows(spark):
    rng = random.Random(6)
    rows = [
        (name, i, split, 30, rng.gauss(i % 2, 1.0), i % 2 == 0)
        for name in ("d", None)
        for split in ("train", "eval")
        for i in range(40)
    ]
    schema = "dataset_name STRING, id_num LONG, split STRING, k INT, score DOUBLE, seen BOOLEAN"
    found = evaluate.metrics_summary(spark.createDataFrame(rows, schema)).collect()
    assert {r["dataset_name"] for r in found} == {"d", None}
    assert all(r["eval_auc"] > 0.5 for r in found)
    numbers = spark.createDataFrame([(None, True, 1.0), (None, False, 3.0)], "dataset_name STRING, seen BOOLEAN, a DOUBLE")
    scaled = features.scale(numbers, features.scaler(numbers, ["a"]), ["a"])
    assert sorted(r["a"] for r in scaled.collect()) == [-1.0, 1.0]
    predicted = classifier.predict(scaled, classifier.fit_classifiers(scaled, ["a"]), ["a"])
    assert all(r["predicted"] == r["seen"] for r in predicted.collect())


def test_dataset_of_one_class(spark):
    df = spark.createDataFrame(
        [("one", True, 1.0), ("one", True, 2.0), ("two", True, 1.0), ("two", False, 2.0)],
        "dataset_name STRING, seen BOOLEAN, a DOUBLE",
    )
    coefficients = classifier.fit_classifiers(df, ["a"])
    found = {r["dataset_name"]: r["coefficients"] for r in coefficients.collect()}
    assert found["one"] is None and found["two"][0] < 0
    rows = classifier.predict(df, coefficients, ["a"]).collect()
    assert all((r["predicted"] is None) == (r["dataset_name"] == "one") for r in rows)


def _evaluate(spark, values, labels):
    df = spark.createDataFrame(
        [("d", 30, float(v), bool(y)) for v, y in zip(values, labels)],
        "dataset_name STRING, k INT, score DOUBLE, seen BOOLEAN",
    )
    counts = evaluate.score_counts(df, evaluate.BY_K)
    row = evaluate.best_thresholds(counts, evaluate.BY_K).first()
    return row["auc"], row["threshold"], row["accuracy"], counts


@pytest.mark.parametrize("seed", range(4))
def test_auc_and_threshold(spark, seed):
    rng = random.Random(seed)
    values = [rng.randrange(12) / 4 for _ in range(60)]
    labels = [rng.random() < 0.7 - v / 6 for v in values]
    auc, threshold, accuracy, counts = _evaluate(spark, values, labels)
    seen = [v for v, y in zip(values, labels) if y]
    unseen = [v for v, y in zip(values, labels) if not y]
    won = sum((a < b) + (a == b) / 2 for a in seen for b in unseen)
    assert auc == pytest.approx(won / (len(seen) * len(unseen)))
    best = max(
        (np.mean([(v < t) == y for v, y in zip(values, labels)]), -t) for t in set(values)
    )
    assert accuracy == pytest.approx(best[0])
    assert threshold == -best[1]
    points = evaluate.roc_points(counts, evaluate.BY_K).orderBy("fpr", "tpr").collect()
    assert len(points) == len(set(values)) + 1
    area = sum(
        (b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(points, points[1:])
    )
    assert area == pytest.approx(auc)
    # Collinear points by the definition: equal steps before and after.
    steps = [(sum(v == x and not y for v, y in zip(values, labels)), sum(v == x and y for v, y in zip(values, labels))) for x in sorted(set(values))]
    kept = [i for i in range(len(steps)) if i in (0, len(steps) - 1) or steps[i] != steps[i + 1]]
    assert evaluate.roc_points(counts, evaluate.BY_K, drop_intermediate=True).count() == len(kept) + 1
    mirrored, *_ = _evaluate(spark, [-v for v in values], labels)
    assert mirrored == pytest.approx(1 - auc)


def test_threshold_edges(spark):
    # All seen and equal: nothing can be right, so the median.
    assert _evaluate(spark, [2.0, 2.0, 2.0], [True] * 3)[:3] == (0.5, 2.0, 0.0)
    # One unseen row: nothing lies below the minimum.
    assert _evaluate(spark, [1.5], [False])[:3] == (0.5, 1.5, 1.0)
    assert _evaluate(spark, [1.0, 1.0], [True, False])[0] == 0.5


def test_metrics_with_fitted_and_permuted_labels(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        seen = i % 2 == 0
        other = rng.random() < 0.5
        score = rng.gauss(1.0 if seen else 3.0, 0.7)
        rows.append(("real", i, "train" if i % 4 < 2 else "eval", 30, score, seen))
        rows.append(("permuted", i, "train" if i % 4 < 2 else "eval", 30, score, other))
    df = spark.createDataFrame(
        rows,
        "dataset_name STRING, id_num LONG, split STRING, k INT, score DOUBLE, seen BOOLEAN",
    )
    found = {r["dataset_name"]: r for r in evaluate.metrics_summary(df).collect()}
    assert found["real"]["eval_auc"] > 0.9
    assert found["real"]["seen_mean"] < found["real"]["unseen_mean"]
    assert 0.35 < found["permuted"]["eval_auc"] < 0.65


def test_geometry_and_features(spark):
    states = spark.createDataFrame(
        [("d", 1, s, [1.0, 0.0], 0.5 * s if s else None, 0.1 * s if s else None) for s in range(3)]
        + [("d", 2, s, [math.cos(s), math.sin(s)], 1.0, 2.0) for s in range(3)],
        "dataset_name STRING, id_num LONG, step INT, embedding ARRAY<DOUBLE>, loss DOUBLE, "
        "grad_norm DOUBLE",
    )
    found = features.trace_features(states, ["dataset_name", "id_num"], num_steps=2)
    assert found.columns[2:] == features.feature_names(2)
    rows = {r["id_num"]: r for r in found.collect()}
    assert rows[1]["L2Dist_Step2"] == 0.0
    assert rows[1]["Angle_Step1"] == pytest.approx(0.0, abs=1e-3)
    assert rows[1]["Loss_Step2"] == 1.0
    assert rows[2]["Angle_Step2"] == pytest.approx(2.0, abs=1e-6)
    assert rows[2]["L2Dist_Step1"] == pytest.approx(2 * math.sin(0.5))


def test_scaler_handles_constant_features(spark):
    df = spark.createDataFrame(
        [("d", 1.0, 7.0), ("d", 3.0, 7.0)], "dataset_name STRING, a DOUBLE, b DOUBLE"
    )
    found = features.scale(df, features.scaler(df, ["a", "b"]), ["a", "b"]).collect()
    assert sorted((r["a"], r["b"]) for r in found) == [(-1.0, 0.0), (1.0, 0.0)]


def test_classifier_gradient_is_zero(spark):
    rng = np.random.default_rng(3)
    names = ["a", "b", "c"]
    x = rng.normal(size=(120, 3))
    y = (x @ [1.5, -1.0, 0.0] + rng.normal(size=120)) > 0.7
    df = spark.createDataFrame(
        [("d", bool(s), *map(float, v)) for s, v in zip(y, x)],
        "dataset_name STRING, seen BOOLEAN, a DOUBLE, b DOUBLE, c DOUBLE",
    )
    coefficients = classifier.fit_classifiers(df, names)
    row = coefficients.first()
    w, b = np.array(row["coefficients"]), row["intercept"]
    weight = np.where(y, len(y) / (2 * y.sum()), len(y) / (2 * (~y).sum()))
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(w + x.T @ (weight * (p - y))).max() < 1e-6
    assert abs((weight * (p - y)).sum()) < 1e-6
    predicted = classifier.predict(df, coefficients, names).collect()
    assert sum(r["predicted"] == r["seen"] for r in predicted) > 90
    top = classifier.top_coefficients(coefficients, names, 2).orderBy("rank").collect()
    assert [t["feature"] for t in top] == ["a", "b"]
    assert [t["sign"] for t in top] == ["+", "-"]


@pytest.mark.parametrize("partitions", [1, 16])
def test_partition_count_does_not_matter(spark, items, partitions):
    def run():
        found = language_model.lookup(items, language_model.fit(items))
        table = scores.score_table(items, language_model.sample_logprobs(items, found))
        return sorted(
            tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r)
            for r in table.drop("perplexity").collect()
        )

    wanted = run()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        assert run() == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
