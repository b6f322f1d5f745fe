"""Fits of many datasets at once."""

import uuid

import numpy as np
import pytest

from seenscope.operators import classifier

NAMES = ["a", "b"]
SCHEMA = "dataset_name STRING, seen BOOLEAN, a DOUBLE, b DOUBLE"


def dataset(rng, name, n, noise=1.0, scale=1.0):
    x = rng.normal(size=(n, 2)) * scale
    y = (x @ rng.normal(size=2) + noise * rng.normal(size=n)) > rng.normal()
    y[:2] = [True, False]
    return [(name, bool(s), *map(float, v)) for s, v in zip(y, x, strict=True)]


def by_hand(rows):
    """Newton steps of the same objective, one dataset at a time."""
    x = np.array([[1.0, r[2], r[3]] for r in rows])
    y = np.array([r[1] for r in rows], float)
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    penalty = np.array([0.0, 1, 1])
    w = np.zeros(3)
    loss = lambda w: (weight * (np.logaddexp(0, x @ w) - y * (x @ w))).sum() + 0.5 * (penalty * w * w).sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        curve = (x.T * (weight * p * (1 - p))) @ x + np.diag(penalty)
        ahead, step = np.linalg.solve(curve, gradient), 1.0
        while loss(w - step * ahead) > loss(w) and step > 1e-9:
            step /= 2
        w = w - step * ahead
    return w


def counted(spark, run):
    """The result, and how many jobs it took."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_the_datasets(spark):
    rng = np.random.default_rng(1)
    rows = {f"d{i}": dataset(rng, f"d{i}", 12) for i in range(500)}
    few = [r for name in ("d0", "d1") for r in rows[name]]
    every = [r for part in rows.values() for r in part]
    _, few_jobs = counted(spark, lambda: classifier.fit_classifiers(spark.createDataFrame(few, SCHEMA), NAMES).collect())
    found, jobs = counted(spark, lambda: classifier.fit_classifiers(spark.createDataFrame(every, SCHEMA), NAMES).collect())
    assert len(found) == 500
    assert jobs <= 2 * few_jobs < 200
    for r in found:
        wanted = by_hand(rows[r["dataset_name"]])
        assert [r["intercept"], *r["coefficients"]] == pytest.approx(wanted, abs=1e-6)


def test_steps_are_halved_where_newton_overshoots(spark):
    """Features of very different size, classes nearly apart."""
    rng = np.random.default_rng(2)
    rows = dataset(rng, "far", 40, noise=1e-3, scale=300.0) + dataset(rng, None, 30, noise=0.1, scale=1e-3)
    found = classifier.fit_classifiers(spark.createDataFrame(rows, SCHEMA), NAMES).collect()
    for r in found:
        wanted = by_hand([x for x in rows if x[0] == r["dataset_name"]])
        assert [r["intercept"], *r["coefficients"]] == pytest.approx(wanted, abs=1e-6)
    overshot = {"dataset_name": "d", "point": [4.0], "base": [0.0], "direction": [4.0], "base_loss": 1.0, "slope": 2.0, "step": 1.0, "turns": 1, "done": False}
    tried = classifier.newton(overshot, np.array([5.0, 1.0, 1.0]), 1e-15)
    assert tried["point"] == [2.0] and tried["step"] == 0.5 and not tried["done"] and tried["turns"] == 2


def test_odd_rows_of_a_fit(spark):
    rows = [
        ("d", True, 1.0, None), ("d", None, 1.0, 1.0), ("d", True, 1.0, 2.0), ("d", False, 2.0, 1.0),
        ("none", None, 1.0, 1.0), ("one", True, 1.0, 1.0),
    ]
    found = {r["dataset_name"]: r for r in classifier.fit_classifiers(spark.createDataFrame(rows, SCHEMA), NAMES).collect()}
    assert found.keys() == {"d", "one"}
    assert found["one"]["coefficients"] is None and found["one"]["intercept"] is None
    wanted = by_hand([("d", True, 1.0, 2.0), ("d", False, 2.0, 1.0)])
    assert [found["d"]["intercept"], *found["d"]["coefficients"]] == pytest.approx(wanted, abs=1e-6)
    assert classifier.fit_classifiers(spark.createDataFrame([], SCHEMA), NAMES).collect() == []
