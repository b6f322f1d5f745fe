"""Counts per block against those of the plain lookups, and what they shuffle."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seenscope.functions.words import words
from seenscope.operators import blocks, language_model, optimiser, scores, trajectory
from tests.test_places import REPEATED, SCHEMA, TEXTS, _rows

MANY = [("f", i, i % 2 == 0, f"the cat {i % 7} the w{i % 11} the cat Ünï{i % 5} ran") for i in range(60)]


@pytest.mark.parametrize("rows, chars", [(TEXTS + REPEATED, 1 << 20), (TEXTS + MANY, 64)])
def test_sample_logprobs(spark, monkeypatch, rows, chars):
    """As by the lookups, for repeated ids and whatever the number of blocks."""
    monkeypatch.setattr(blocks, "BLOCK_CHARS", chars)
    items = spark.createDataFrame(rows, SCHEMA)
    found = language_model.lookup(items, language_model.fit(items))
    plain = language_model.token_logprobs(items, found).withColumn("logprob", F.round("logprob", 12))
    listed = blocks.sample_logprobs(items, F.col("seen"), with_words=True)
    placed = listed.select("dataset_name", "id_num", F.posexplode(F.arrays_zip("tok", "logprob")).alias("pos", "place"))
    placed = placed.select(
        "dataset_name", "id_num", (F.col("pos") + 1).alias("pos"), F.col("place.tok").alias("token"),
        F.round("place.logprob", 12).alias("logprob"),
    )
    assert _rows(placed, "pos", "token", "logprob") == _rows(plain, "pos", "token", "logprob")


def _train():
    return F.coalesce(F.col("dataset_name") == "d", F.lit(False))


@pytest.mark.parametrize("chars", [64])
def test_cell_sums_of_other_texts(spark, monkeypatch, chars):
    monkeypatch.setattr(blocks, "BLOCK_CHARS", chars)
    items = spark.createDataFrame(TEXTS + MANY, SCHEMA)
    rest = items.where(~_train())
    found = language_model.lookup(rest, language_model.fit(items.where(_train())))
    plain = trajectory.trajectory(language_model.model_cells(rest, found))
    sums = blocks.cell_sums(items, _train() & F.col("seen"), trajectory.cell_values, trajectory.sum_names(), ~_train())
    states = trajectory.from_sums(sums)
    assert states.where("dataset_name IS NULL").count()
    embedding = F.transform("embedding", lambda x: F.round(x, 11)).alias("embedding")
    columns = ["step", F.round("loss", 11), F.round("grad_norm", 11), embedding]
    assert _rows(states, *columns) == _rows(plain, *columns)


def test_listed_scores(spark):
    items = spark.createDataFrame(TEXTS + MANY, SCHEMA)
    found = language_model.lookup(items, language_model.fit(items))
    plain = scores.sample_scores(language_model.sample_logprobs(items, found))
    listed = scores.listed_scores(blocks.sample_logprobs(items, F.col("seen")))
    names = [scores.min_k_name(r) for r in scores.K_RATIOS]
    columns = ["num_tokens", *[F.round(c, 11) for c in ("avg_nll", *names)]]
    assert _rows(listed, *columns) == _rows(plain, *columns)


def test_no_place_is_shuffled(spark):
    """Scores follow from texts dealt by block, without another shuffle."""
    items = spark.createDataFrame(TEXTS, SCHEMA)
    table = scores.listed_scores(blocks.sample_logprobs(items, F.col("seen")))
    assert table._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_nothing_fitted(spark):
    items = spark.createDataFrame(TEXTS, SCHEMA)
    found = blocks.sample_logprobs(items, F.lit(False), F.col("seen"))
    assert found.select(F.explode("logprob").alias("x")).where("x != 0").isEmpty()
    assert blocks.sample_logprobs(items.where("false"), F.col("seen")).isEmpty()


def test_start_state_without_pairs(spark):
    """The optimiser's start state as from the model's pairs, with only bucket counts shuffled."""
    items = spark.createDataFrame(TEXTS + MANY, SCHEMA)
    wanted = optimiser.start_state(language_model.fit(items).pairs)
    found = optimiser.fitted_state(items)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    plan = optimiser._bucket_pairs(items).groupBy("u", "j").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(u" in plan


def test_words(spark):
    """As by the expression, with blanks of all kinds, at both ends and across rows."""
    texts = ["a\tb\n\nc", "", None, "  ", "x", "y z ", "\fü\u00a0ß  ö\x0bq\r", " Ab\u0130 \u2003w"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    wanted = items.select("i", F.explode(words(F.col("t"))).alias("w")).orderBy("i").collect()
    lower = pa.array([r[0] for r in items.orderBy("i").select(F.lower("t")).collect()])
    for part in (lower, lower[3:]):
        found, rows = blocks._words(part)
        shift = len(lower) - len(part)
        assert list(zip((rows + shift).tolist(), found.to_pylist())) == [tuple(r) for r in wanted if r["i"] >= shift]


def test_listed_trajectories_are_not_shuffled(spark):
    """As from sums by bucket, with texts dealt by block the only shuffle."""
    items = spark.createDataFrame(TEXTS + MANY, SCHEMA)
    names = trajectory.sum_names()
    listed = blocks.listed_sums(items, F.col("seen"), trajectory.cell_values, names, keep=("seen",))
    states = trajectory.from_listed(listed, keep=("seen",))
    plain = trajectory.from_sums(blocks.by_bucket(listed, names))
    embedding = F.transform("embedding", lambda x: F.round(x, 11)).alias("embedding")
    columns = ["step", F.round("loss", 11), F.round("grad_norm", 11), embedding]
    assert _rows(states, *columns) == _rows(plain, *columns)
    assert states._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_packed_counts_and_words():
    """A word's many pairs and a large count take few bytes, and come back as they were."""
    counts, sizes = np.array([3, 0, 1 << 40, 1, 1] + [1] * 5000), np.array([3, 0, 5002])
    packed = blocks._packed(counts, sizes)
    found, n = blocks._unpacked(packed)
    assert found.tolist() == counts.tolist() and n.tolist() == sizes.tolist()
    assert sum(map(len, packed.to_pylist())) < 200
    words = pa.array(["a", "ß", "c"])
    assert blocks._unpacked_words(blocks._packed_words(words, np.array([2, 0, 1])), np.array([2, 0, 1])).equals(words)
