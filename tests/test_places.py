"""Counts at every place against those of the plain lookups, and what they shuffle."""

import pytest
from pyspark.sql import functions as F

from seenscope.operators import kneser_ney, language_model, places, scores, trajectory

SCHEMA = "dataset_name STRING, id_num LONG, seen BOOLEAN, instruction_text STRING"
TEXTS = [
    ("d", 1, True, "the cat sat on the mat the cat ran"),
    ("d", 2, False, "the dog sat on the log"),
    ("d", 3, True, "one"),
    ("d", 4, False, ""),
    ("d", 5, True, None),
    ("e", 1, False, "The cat sat\ton THE mat"),
    ("e", 2, True, "a b a b a b ... !!"),
    (None, 1, True, "the mat the mat the"),
    (None, None, False, "the cat the cat"),
]
REPEATED = [("e", 2, True, "a b c a b"), ("e", 2, True, "a b c a b"), ("d", 1, False, "mat sat")]


def _rows(df, *columns):
    return sorted(map(str, df.select("dataset_name", "id_num", *columns).collect()))


@pytest.mark.parametrize("hot", [(20_000, 2_000), (2, 2), (8, 8)])
@pytest.mark.parametrize("rows", [TEXTS, TEXTS + REPEATED])
def test_place_counts(spark, monkeypatch, rows, hot):
    """As by the lookups, for words and pairs that are hot or not, and for repeated ids."""
    monkeypatch.setattr(places, "MAX_HOT_KEYS", hot[0])
    monkeypatch.setattr(places, "MAX_HOT_PAIRS", hot[1])
    items = spark.createDataFrame(rows, SCHEMA)
    found = language_model.lookup(items, language_model.fit(items))
    plain = language_model.token_logprobs(items, found)
    log = F.round(F.log(language_model.probability()), 12).alias("logprob")
    placed = places.place_counts(items, F.col("seen"), keep=("pos", F.col("tok").alias("token")))
    wanted = plain.withColumn("logprob", F.round("logprob", 12))
    assert _rows(placed.withColumn("logprob", log), "pos", "token", "logprob") == _rows(wanted, "pos", "token", "logprob")


def test_other_texts_and_cells(spark):
    items = spark.createDataFrame(TEXTS, SCHEMA)
    train = F.coalesce(F.col("dataset_name") == "d", F.lit(False))
    rest = items.where(~train)
    found = language_model.lookup(rest, language_model.fit(items.where(train)))
    columns = ["n", "n_prev", "c_pair", "c_prev", "bucket"]
    plain = language_model.model_cells(rest, found).withColumn("bucket", trajectory.pair_bucket())
    bucket = trajectory.pair_bucket().alias("bucket")
    cells = places.place_counts(items, train & F.col("seen"), ~train, keep=(bucket,), cells=True)
    assert cells.where("dataset_name IS NULL").count()
    assert _rows(cells, *columns) == _rows(plain, *columns)
    states = trajectory.trajectory(cells, dealt=True)
    places_of = ["step", F.round("loss", 12), F.round("grad_norm", 12)]
    assert _rows(states, *places_of) == _rows(trajectory.trajectory(plain), *places_of)


def test_dealt_scores(spark):
    items = spark.createDataFrame(TEXTS, SCHEMA)
    found = language_model.lookup(items, language_model.fit(items))
    plain = scores.score_table(items, language_model.sample_logprobs(items, found))
    dealt = scores.score_table(items, places.place_logprobs(places.place_counts(items, F.col("seen"))), dealt=True)
    columns = ["num_tokens", *[F.round(scores.min_k_name(r), 12) for r in scores.K_RATIOS], F.round("avg_nll", 12)]
    assert _rows(dealt, *columns) == _rows(plain, *columns)


def test_two_shuffles_of_places(spark):
    """Places are dealt by word and by sample; scores need no third shuffle of them."""
    items = spark.createDataFrame(TEXTS, SCHEMA)
    table = scores.sample_scores(places.place_logprobs(places.place_counts(items, F.col("seen"))), dealt=True)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2
    assert plan.count("Exchange hashpartitioning(dataset_name") == 1


@pytest.mark.parametrize("hot", [20_000, 4])
@pytest.mark.parametrize("rows", [TEXTS, TEXTS + REPEATED])
def test_order_three(spark, monkeypatch, rows, hot):
    monkeypatch.setattr(places, "MAX_HOT_KEYS", hot)
    items = spark.createDataFrame(rows, SCHEMA)
    plain = kneser_ney.token_logprobs(items, kneser_ney.lookup(items, kneser_ney.fit(items)))
    found = kneser_ney.place_logprobs(items, F.col("seen"))
    columns = ["pos", "token", F.round("logprob", 12)]
    assert _rows(found, *columns) == _rows(plain, *columns)
    assert found._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 2


def test_order_three_of_nothing(spark):
    items = spark.createDataFrame(TEXTS, SCHEMA).withColumn("seen", F.lit(False))
    assert kneser_ney.place_logprobs(items, F.col("seen")).where("logprob != 0").isEmpty()
