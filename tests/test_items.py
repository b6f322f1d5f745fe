"""Prompts, chat records, checks, samples and splits."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seenscope.functions import chat, prompts
from seenscope.operators import checks, features, sampling, tasks
from seenscope.sources import paths
from seenscope.sources.items import write_items
from seenscope.plans.materialize import scratch_path


def _one(spark, column, schema, values):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


def test_math_prompt(spark):
    text = _one(spark, prompts.math_prompt(F.col("p")), "p STRING", ("1+1?",))
    assert text == (
        "Solve the following math problem step by step. Show your work and provide the final "
        "answer in \\boxed{} format at the very end.\n\nProblem: 1+1?\n\nAnswer:"
    )


def test_labeled_prompt_with_fewer_texts_than_labels(spark):
    schema = "q STRING, c STRUCT<label: ARRAY<STRING>, text: ARRAY<STRING>>"
    column = prompts.labeled_choice_prompt(F.col("q"), F.col("c"))
    text = _one(spark, column, schema, ("Q?", (["1", "2", "3", "4"], ["a", "b", "c"])))
    assert text.endswith(
        "Question: Q?\n\nChoices:\n1. a\n2. b\n3. c\n\n"
        "Select the correct answer (1, 2, 3, 4).\n\nAnswer:"
    )


def test_fixed_prompt(spark):
    column = prompts.fixed_choice_prompt(F.col("q"), F.col("c"))
    text = _one(spark, column, "q STRING, c ARRAY<STRING>", ("Q?", ["a", "b", "c", "d"]))
    assert text.endswith(
        "Choices:\nA. a\nB. b\nC. c\nD. d\n\nSelect the correct answer (A, B, C, or D).\n\nAnswer:"
    )


def test_answer_letter(spark):
    column = chat.index_answer(F.col("a"))
    assert _one(spark, column, "a INT", (3,)) == "The correct answer is: D"
    for wrong in (4, -1):
        with pytest.raises(PySparkException, match="out of range"):
            _one(spark, column, "a INT", (wrong,))


def test_violations(spark):
    df = spark.createDataFrame(
        [("d", 1, "x", 0), ("d", 2, None, 4), ("d", None, "y", -1)],
        "dataset_name STRING, id_num LONG, instruction_text STRING, answer INT",
    )
    row = checks.violations(df, {"bad": ~chat.valid_answer_index(F.col("answer"))}).first()
    assert row.asDict() == {
        "dataset_name": "d",
        "n_rows": 3,
        "null_instruction_text": 1,
        "null_id_num": 1,
        "bad": 2,
    }
    with pytest.raises(ValueError, match="id_num"):
        checks.violations(df.drop("id_num"))


def test_keep_and_verify_seen(spark):
    df = spark.createDataFrame(
        [("d", 1, True), ("d", 2, False), ("d", 3, None)],
        "dataset_name STRING, id_num LONG, seen BOOLEAN",
    )
    with pytest.raises(ValueError, match="2 rows"):
        checks.verify_seen(df)
    checks.verify_seen(checks.keep_seen(df))
    assert checks.keep_seen(df, enabled=False).count() == 3
    assert checks.keep_seen(df.drop("seen")).count() == 3


@pytest.fixture(scope="module")
def numbered(spark):
    return spark.range(1011).select(
        F.when(F.col("id") < 700, "a").when(F.col("id") < 1000, "b").otherwise("c").alias(
            "dataset_name"
        ),
        F.col("id").alias("id_num"),
        F.concat(F.lit("Level "), (F.col("id") % 3).cast("string")).alias("level"),
    )


def test_split_half_sizes(spark, numbered):
    split = sampling.split_half(sampling.label_seen(numbered))
    rows = split.groupBy("dataset_name", "seen", "split").count().collect()
    sizes = {(r[0], r[1], r[2]): r[3] for r in rows}
    assert sizes["a", True, "train"] == sizes["a", False, "eval"] == 175
    assert sizes["b", True, "train"] == 75
    # 11 rows: 5 seen and 6 unseen; the odd row goes to eval.
    assert sizes["c", True, "train"] == 2
    assert sizes["c", True, "eval"] == 3
    assert sizes["c", False, "train"] == 3
    train, held_out = split.where("split = 'train'"), split.where("split = 'eval'")
    assert train.count() + held_out.count() == 1011
    assert sampling.without(split, train).count() == held_out.count()


def test_samples(spark, numbered):
    exact = sampling.sample_exact(numbered, 200, id_col="id_num")
    assert {r[0]: r[1] for r in exact.groupBy("dataset_name").count().collect()} == {
        "a": 200,
        "b": 200,
        "c": 11,
    }
    again = sampling.sample_exact(numbered.repartition(7), 200, id_col="id_num")
    assert exact.exceptAll(again).count() == 0
    other = sampling.sample_exact(numbered, 200, id_col="id_num", seed=43)
    assert exact.exceptAll(other).count() > 0
    strata = sampling.sample_stratified(numbered, 20, id_col="id_num")
    sizes = {(r[0], r[1]): r[2] for r in strata.groupBy("dataset_name", "level").count().collect()}
    assert sizes["a", "Level 0"] == 6
    # Short stratum: ids 1001, 1004, 1007 and 1010.
    assert sizes["c", "Level 2"] == 4


def test_positional_split(spark, numbered):
    rows = sampling.split_positional(
        numbered.withColumnRenamed("id_num", "src_id"), contam_rows=250
    ).collect()
    ids = sorted(r["id_num"] for r in rows if r["dataset_name"] == "b")
    assert ids == list(range(300))
    assert all((r["split"] == "contam") == (r["id_num"] < 250) for r in rows)


def test_union_and_fetch(spark):
    def items(name, ids):
        return spark.createDataFrame([(name, i) for i in ids], "dataset_name STRING, id_num LONG")

    # Ids with gaps, on both sides of a bucket edge.
    united = tasks.union_tasks(
        [items("z", [5, 99_999, 100_000, 250_000]), items("a", [0, 2]), items("m", [7])]
    )
    rows = sorted((r["global_index"], r["dataset_name"], r["id_num"]) for r in united.collect())
    assert rows == [
        (0, "z", 5),
        (1, "z", 99_999),
        (2, "z", 100_000),
        (3, "z", 250_000),
        (4, "a", 0),
        (5, "a", 2),
        (6, "m", 7),
    ]
    asked = spark.createDataFrame([(4,), (7,)], "global_index LONG")
    found = {r["global_index"]: r["found"] for r in tasks.fetch(united, asked).collect()}
    assert found == {4: True, 7: False}
    with pytest.raises(PySparkException, match="out of range: 7"):
        tasks.fetch_or_fail(united, asked).collect()


def test_label_join(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "id_num LONG")
    labels = spark.createDataFrame([(1, True), (2, False)], "id_num LONG, seen BOOLEAN")
    found = {r["id_num"]: r["seen"] for r in features.label_join(rows, labels, ["id_num"]).collect()}
    assert found == {1: True, 2: False, 3: False}
    with pytest.raises(PySparkException, match="more than one label"):
        features.label_join(rows, labels.union(labels), ["id_num"]).collect()
    nameless = spark.createDataFrame([(None, True)], "id_num LONG, seen BOOLEAN")
    assert features.label_join(nameless.select("id_num"), nameless, ["id_num"]).first()["seen"]


def test_paths_outside_a_data_folder_are_skipped(spark):
    root = scratch_path(spark, "tree")
    df = spark.createDataFrame([("en", "train", 1), ("en", "eval", 2)], "dataset_name STRING, split STRING, id_num LONG")
    df.drop("dataset_name", "split").write.parquet(f"{root}/data/math/probe/train.parquet")
    write_items(df, f"{root}/other")
    found = paths.read_with_path_columns(spark, root, "id_num LONG").collect()
    assert [(r["dataset_name"], r["level"], r["split"]) for r in found] == [
        ("math", "probe", "train")
    ] * 2
