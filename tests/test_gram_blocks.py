"""The model of order three by blocks against the plain lookups, and what it shuffles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seenscope.operators import gram_blocks, kneser_ney, scores
from tests.test_blocks import MANY
from tests.test_places import REPEATED, SCHEMA, TEXTS, _rows


def _placed(listed):
    found = listed.select("dataset_name", "id_num", F.posexplode(F.arrays_zip("tok", "logprob")).alias("pos", "place"))
    return found.select(
        "dataset_name", "id_num", (F.col("pos") + 1).alias("pos"), F.col("place.tok").alias("token"),
        F.round("place.logprob", 12).alias("logprob"),
    )


@pytest.mark.parametrize("rows, chars", [(TEXTS + REPEATED, 1 << 20), (TEXTS + MANY, 64)])
def test_sample_logprobs(spark, monkeypatch, rows, chars):
    """As by the lookups, for repeated ids and whatever the number of blocks."""
    monkeypatch.setattr(gram_blocks, "BLOCK_CHARS", chars)
    items = spark.createDataFrame(rows, SCHEMA)
    plain = kneser_ney.token_logprobs(items, kneser_ney.lookup(items, kneser_ney.fit(items)))
    found = _placed(gram_blocks.sample_logprobs(items, F.col("seen"), with_words=True))
    wanted = plain.withColumn("logprob", F.round("logprob", 12))
    assert _rows(found, "pos", "token", "logprob") == _rows(wanted, "pos", "token", "logprob")


def test_no_place_is_shuffled(spark):
    """Scores follow from texts dealt by block, without another shuffle."""
    items = spark.createDataFrame(TEXTS, SCHEMA)
    table = scores.listed_scores(gram_blocks.sample_logprobs(items, F.col("seen")))
    assert table._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_queries_shuffle_no_place(spark, tmp_path):
    """Places are made from arrays behind the one shuffle, which deals samples by block."""
    from seenscope.catalog.queries import QUERIES

    documents = [(i, t, d or "x", "web") for i, (d, _, _, t) in enumerate(TEXTS + MANY)]
    folder = str(tmp_path)
    spark.createDataFrame(documents, "doc_id LONG, text STRING, lang STRING, source STRING").write.parquet(f"{folder}/documents.parquet")
    found = QUERIES["token_logprobs_order3"](spark, folder)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Exchange ") == 1 and "Window" not in plan and "REPARTITION_BY_COL" not in plan
    assert found.count() == sum(max(0, len((t or "").split()) - 1) for _, t, _, _ in documents)


def test_steps_between_numbers():
    numbers, sizes = np.array([2, 3, 9, 0, 4]), np.array([3, 0, 2])
    steps = gram_blocks._steps(numbers, sizes)
    assert steps.tolist() == [2, 1, 6, 0, 4]
    assert gram_blocks._sums_of_steps(steps, sizes).tolist() == numbers.tolist()


def test_nothing_fitted(spark):
    items = spark.createDataFrame(TEXTS, SCHEMA)
    found = gram_blocks.sample_logprobs(items, F.lit(False))
    assert found.select(F.explode("logprob").alias("x")).where("x != 0").isEmpty()
    assert gram_blocks.sample_logprobs(items.where("false"), F.col("seen")).isEmpty()
    assert gram_blocks.sample_logprobs(items.where("id_num > 3"), F.col("seen")).count() == 0
