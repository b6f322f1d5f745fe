"""Registered queries: name -> function of (session, table folder).

Every query runs over whole tables. Doubles are rounded to 6 places, and perplexity, whose
size varies widely, to single precision, so that results do not depend on the order of
summation. Scores and trajectories are rounded to 9 places here, so that equal texts tie in
what follows; the shift keeps them off the midpoint between two values of 6 places, which
Spark and DuckDB do not round alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from seenscope.catalog import fixtures
from seenscope.functions.chat import chat, index_answer, key_answer, valid_answer_index
from seenscope.operators import (
    blocks,
    checks,
    classifier,
    evaluate,
    features,
    gram_blocks,
    language_model,
    optimiser,
    report,
    sampling,
    scores,
    tasks,
    trajectory,
    word_vectors,
)
from seenscope.operators.places import has_repeated
from seenscope.plans.joins import null_safe_join
from seenscope.plans.materialize import materialize, scratch_path
from seenscope.sources import items as item_tables
from seenscope.sources import metrics as metric_tables
from seenscope.sources import paths, schemas, trajectories

OFF_MIDPOINT = 1e-10
DIGITS = 9
# Coefficients come from iterations, so their last digits depend on where these stop.
COEFFICIENT_DIGITS = 3

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

K_VALUES = [scores.k_percent(r) for r in scores.K_RATIOS]
SWEEP_K = [10, 20, 30, 40, 50]
REPORT_DATASETS = ["de", "en", "es", "fr", "it"]
METHODS = ("k20", "k30")
STRATIFIED_ROWS = 50
# Few enough for an SQL twin, which has a step per column and multiplication.
VECTOR_DIM = 4
SAMPLE_KEYS = ["dataset_name", "split", "id_num"]


def query(function: Query) -> Query:
    def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = function(spark, sf_dir)
        return df.select(
            *[
                F.round(F.col(f.name) + OFF_MIDPOINT, 6).alias(f.name)
                if isinstance(f.dataType, DoubleType)
                else f.name
                for f in df.schema
            ]
        )

    QUERIES[function.__name__] = rounded
    return function


# --- shared steps -----------------------------------------------------------------------


def _messages(items: DataFrame, name: str) -> DataFrame:
    answer = {
        "math": lambda: F.col("solution"),
        "choice_fixed": lambda: index_answer(F.col("answer")),
        "choice_labeled": lambda: key_answer(F.col("answerKey")),
    }[name]()
    return items.withColumn("messages", chat(F.col("instruction_text"), answer))


def _chat_columns(df: DataFrame, *keep: str) -> DataFrame:
    messages = F.col("messages")
    return df.select(
        *keep,
        messages[0]["role"].alias("first_role"),
        messages[0]["content"].alias("first_content"),
        messages[1]["role"].alias("second_role"),
        messages[1]["content"].alias("second_content"),
    )


def _numbered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sampling.split_positional(fixtures.prompted(spark, sf_dir, name))


def _all_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["dataset_name", "id_num", "messages"]
    numbered = {
        name: materialize(_numbered(spark, sf_dir, name), f"{name}-numbered")
        for name in ("math", "choice_fixed", "choice_labeled")
    }
    return tasks.union_tasks([_messages(t, name).select(*columns) for name, t in numbered.items()])


Model = dict[str, DataFrame | Column]


def _model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Model]:
    """Items to score, and the same with what marks fitted and wanted rows, for ``blocks``: here
    the model is fitted on the seen items, and all are wanted."""
    items = fixtures.split_documents(spark, sf_dir)
    return items, {"items": items, "fitted": F.col("seen")}


def _other_model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Model]:
    """The same of eval items and a model fitted on the train items alone."""
    items = fixtures.split_documents(spark, sf_dir)
    train = F.col("split") == "train"
    marks = {"items": items, "fitted": train & F.col("seen"), "wanted": ~train}
    return items.where("split = 'eval'"), marks


def _longer_model(spark: SparkSession, sf_dir: str, with_words: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items, and what the model of order three fitted on the seen ones says about their words."""
    items = fixtures.split_documents(spark, sf_dir)
    return items, gram_blocks.sample_logprobs(items, F.col("seen"), with_words=with_words)


def _longer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, listed = _longer_model(spark, sf_dir)
    table = scores.with_items(items, _listed_scores(items, listed))
    return _nine_places(table, [scores.min_k_name(r) for r in scores.K_RATIOS])


def _nine_places(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


def _sample_scores(items: DataFrame, model: Model) -> DataFrame:
    return _listed_scores(items, blocks.sample_logprobs(**model))


def _listed_scores(items: DataFrame, listed: DataFrame) -> DataFrame:
    if not has_repeated(items):
        return scores.listed_scores(listed)
    # Places of all rows with one id are one sample.
    each = listed.select("dataset_name", "id_num", F.explode("logprob").alias("logprob"), F.lit(1).cast("long").alias("n"))
    return scores.sample_scores(each)


def _score_table(items: DataFrame, model: Model) -> DataFrame:
    found = scores.with_items(items, _sample_scores(items, model))
    return _nine_places(found, [scores.min_k_name(r) for r in scores.K_RATIOS])


def _scores(items: DataFrame, model: Model) -> DataFrame:
    return materialize(_score_table(items, model), "scores")


def _long_scores(items: DataFrame, model: Model) -> DataFrame:
    return scores.by_k(_scores(items, model))


def _trajectories(items: DataFrame, model: Model) -> DataFrame:
    names = trajectory.sum_names()
    listed = blocks.listed_sums(sums=trajectory.cell_values, names=names, keep=("split",), **model)
    repeated = has_repeated(items)
    if repeated:
        # Cells of all rows with one id are one sample's.
        states = trajectory.from_sums(blocks.by_bucket(listed, names).repartition("dataset_name", "id_num"))
    else:
        states = trajectory.from_listed(listed, keep=("split",))
    states = _nine_places(states, ["loss", "grad_norm"])
    states = states.withColumn("embedding", F.transform("embedding", lambda x: F.round(x, DIGITS)))
    if repeated:
        return trajectory.with_split(states, items)
    return states.select("dataset_name", "split", "id_num", "step", "embedding", "loss", "grad_norm")


def _adam_trajectories(items: DataFrame) -> DataFrame:
    start = optimiser.fitted_state(items)
    states = _nine_places(optimiser.trajectory(items, start), ["loss", "grad_norm"])
    embedding = F.transform("embedding", lambda x: F.round(x, DIGITS))
    return trajectory.with_split(states.withColumn("embedding", embedding), items)


def _features(items: DataFrame, model: Model) -> DataFrame:
    return _labelled_features(items, _trajectories(items, model))


def _labelled_features(items: DataFrame, states: DataFrame) -> DataFrame:
    found = features.trace_features(states, SAMPLE_KEYS)
    labels = items.select("dataset_name", "id_num", "seen")
    return features.label_join(found, labels, ["dataset_name", "id_num"])


def _scaled(items: DataFrame, model: Model) -> DataFrame:
    return _scaled_features(_features(items, model))


def _scaled_features(found: DataFrame) -> DataFrame:
    found = materialize(found, "features")
    names = features.feature_names()
    parameters = features.scaler(found.where("split = 'train'"), names)
    return features.scale(found, parameters, names)


def _classified(items: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """Coefficients, and eval rows with probability and predicted class."""
    return _fitted(_scaled(items, model))


def _fitted(scaled: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = features.feature_names()
    scaled = materialize(scaled, "scaled")
    coefficients = classifier.fit_classifiers(scaled.where("split = 'train'"), names)
    return coefficients, classifier.predict(scaled.where("split = 'eval'"), coefficients, names)


def _trace_counts(predicted: DataFrame) -> DataFrame:
    # Evaluation takes a lower score as seen.
    scored = predicted.withColumn("score", -F.col("probability"))
    return evaluate.score_counts(scored, ["dataset_name"])


def _trace_results(predicted: DataFrame, counts: DataFrame) -> DataFrame:
    accuracy = predicted.groupBy("dataset_name").agg(
        F.avg((F.col("predicted") == F.col("seen")).cast("double")).alias("accuracy")
    )
    areas = evaluate.auc(counts, ["dataset_name"])
    return null_safe_join(areas, accuracy, ["dataset_name"], "inner")


def _eval_counts(long_scores: DataFrame) -> DataFrame:
    return evaluate.score_counts(long_scores.where("split = 'eval'"), evaluate.BY_K)


def _representative(long_scores: DataFrame) -> DataFrame:
    metrics = evaluate.metrics_summary(long_scores)
    return report.representative(_eval_counts(long_scores), metrics)


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = materialize(evaluate.metrics_summary(_long_scores(*_model(spark, sf_dir))), "metrics")
    a, b = (
        metrics.where(F.col("k") == k).select(
            "dataset_name",
            F.col("eval_auc").alias("auc"),
            F.col("eval_accuracy").alias("accuracy"),
        )
        for k in (20, 30)
    )
    return report.compare_methods(REPORT_DATASETS, a, b, METHODS)


# --- sources and sinks ------------------------------------------------------------------


@query
def scan_items(spark, sf_dir):
    return fixtures.documents(spark, sf_dir)


@query
def source_items(spark, sf_dir):
    math = fixtures.math_items(spark, sf_dir).select(
        F.lit("math").alias("dataset_name"),
        "src_id",
        F.col("problem").alias("question"),
        F.col("level").alias("choices"),
        F.col("solution").alias("answer"),
    )
    labeled = fixtures.labeled_items(spark, sf_dir).select(
        F.lit("choice_labeled").alias("dataset_name"),
        "src_id",
        "question",
        F.concat_ws("|", F.array_join("choices.label", ","), F.array_join("choices.text", ",")).alias(
            "choices"
        ),
        F.col("answerKey").alias("answer"),
    )
    fixed = fixtures.fixed_items(spark, sf_dir).select(
        F.lit("choice_fixed").alias("dataset_name"),
        "src_id",
        "question",
        F.array_join("choices", ",").alias("choices"),
        F.col("answer").cast("string").alias("answer"),
    )
    return tasks.concat(math, labeled, fixed)


@query
def roundtrip_partitions(spark, sf_dir):
    path = scratch_path(spark, "items")
    item_tables.write_items(fixtures.split_documents(spark, sf_dir), path)
    return item_tables.read_items(spark, path, schemas.ITEMS + ", split STRING").select(
        "dataset_name", "split", "id_num", "seen", "instruction_text"
    )


@query
def rewritten_parts(spark, sf_dir):
    """All items by dataset and split, then the train part of one dataset again, with other
    labels."""
    path, schema = scratch_path(spark, "parts"), schemas.ITEMS + ", split STRING"
    items = fixtures.split_documents(spark, sf_dir)
    item_tables.write_parts(items, path)
    again = items.where("dataset_name = 'en' AND split = 'train'").withColumn("seen", ~F.col("seen"))
    item_tables.write_parts(again.where("seen"), path)
    rows = item_tables.read_parts(spark, path, schema)
    return rows.select("dataset_name", "split", "id_num", "seen")


@query
def write_verified(spark, sf_dir):
    """What is counted while the seen items are written, and what is read of them."""
    path = scratch_path(spark, "verified")
    kept = checks.keep_seen(fixtures.labelled_documents(spark, sf_dir))
    rules = checks.item_rules() | {"long_text": F.length("instruction_text") > 1000}
    counts = checks.write_verified(kept, lambda rows: rows.write.parquet(path), rules)
    read = spark.read.schema(kept.schema).parquet(path)
    return read.groupBy("dataset_name").agg(F.count("*").alias("n_read")).select(
        "*", *[F.lit(n).cast("long").alias(name) for name, n in counts.items()]
    )


@query
def path_columns(spark, sf_dir):
    path = scratch_path(spark, "tree") + "/data"
    tree = fixtures.split_documents(spark, sf_dir).withColumn("level", F.lit("probe"))
    item_tables.write_items(tree, path, ["dataset_name", "level", "split"])
    found = paths.read_with_path_columns(spark, path, "id_num LONG, seen BOOLEAN")
    return found.groupBy("dataset_name", "level", "split").agg(
        F.count("*").alias("n_rows"), F.count_if("seen").alias("n_seen")
    )


@query
def paired_datasets(spark, sf_dir):
    # A dataset here is a source; only those with a labelled document have a train part.
    rows = fixtures.table(spark, sf_dir, "documents").select(
        F.concat_ws("-", "source", "lang").alias("dataset_name"), F.col("doc_id").alias("id_num")
    )
    labels = fixtures.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id_num"))
    train = rows.join(labels, "id_num", "left_semi")
    return paths.paired(sampling.without(rows, train), train)


@query
def trajectory_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "trajectory")
    trajectories.write_trajectory(_trajectories(*_model(spark, sf_dir)), path)
    found = trajectories.read_trajectory(spark, path)
    return found.select(
        *SAMPLE_KEYS, "step", "loss", "grad_norm", F.get("embedding", F.lit(0)).alias("e0")
    )


@query
def complete_datasets(spark, sf_dir):
    states = fixtures.stored_trajectory(spark, sf_dir)
    kept = trajectories.keep_complete(
        states, states.withColumn("part", F.col("step")), ["dataset_name", "id_num"], 6
    )
    return kept.groupBy("dataset_name").agg(
        F.count_distinct("id_num").alias("n_samples"), F.count("*").alias("n_states")
    )


@query
def complete_parts(spark, sf_dir):
    """States of the datasets whose train and eval trajectories hold all four parts."""
    states = _trajectories(*_model(spark, sf_dir))
    states = materialize(states, "states")
    both = trajectories.complete(
        trajectories.parts_present(states).withColumn("part", F.concat_ws("-", "split", "part")),
        ["dataset_name"],
        2 * len(trajectories.PARTS),
    )
    kept = null_safe_join(states, materialize(both, "complete"), ["dataset_name"], "left_semi")
    return kept.groupBy("dataset_name", "split").agg(F.count("*").alias("n_states"))


@query
def summary_of_nothing(spark, sf_dir):
    """The summary of a whole trajectory table, and of the part of it beyond the last step."""
    states = fixtures.stored_trajectory(spark, sf_dir).withColumns(
        {"loss": F.lit(None).cast("double"), "grad_norm": F.lit(None).cast("double")}
    )
    every = trajectories.summarize_all(states).withColumn("part", F.lit("all"))
    beyond = trajectories.summarize_all(states.where("step > 5")).withColumn("part", F.lit("beyond"))
    return every.unionByName(beyond)


@query
def trajectory_summary(spark, sf_dir):
    return trajectories.summarize(_trajectories(*_model(spark, sf_dir)))


@query
def metrics_json(spark, sf_dir):
    path = scratch_path(spark, "metrics-json")
    metric_tables.write_metrics(evaluate.metrics_summary(_long_scores(*_model(spark, sf_dir))), path)
    return metric_tables.read_metrics(spark, path)


# --- projections, filters, checks -------------------------------------------------------


@query
def filter_levels(spark, sf_dir):
    return checks.keep_levels(fixtures.math_items(spark, sf_dir)).select("src_id", "level")


@query
def keep_seen(spark, sf_dir):
    kept = checks.keep_seen(fixtures.labelled_documents(spark, sf_dir))
    return kept.select("dataset_name", "id_num")


@query
def verify_seen(spark, sf_dir):
    items = fixtures.labelled_documents(spark, sf_dir)
    kept = checks.keep_seen(items)
    checks.verify_seen(kept)
    before = checks.seen_report(items).withColumn("stage", F.lit("all"))
    return before.unionByName(checks.seen_report(kept).withColumn("stage", F.lit("kept")))


@query
def validate_items(spark, sf_dir):
    math = item_tables.with_prompt(
        fixtures.math_items(spark, sf_dir, complete=False), "math"
    ).withColumn("id_num", F.col("src_id"))
    fixed = fixtures.prompted(spark, sf_dir, "choice_fixed").withColumn("id_num", F.col("src_id"))
    return tasks.concat(
        checks.violations(math, {"bad_answer": F.col("solution").isNull()}),
        checks.violations(fixed, {"bad_answer": ~valid_answer_index(F.col("answer"))}),
    )


def _prompts(name: str) -> Query:
    def prompts(spark, sf_dir):
        return fixtures.prompted(spark, sf_dir, name).select("src_id", "instruction_text")

    return prompts


def _chats(name: str) -> Query:
    def chats(spark, sf_dir):
        return _chat_columns(_messages(fixtures.prompted(spark, sf_dir, name), name), "src_id")

    return chats


for _query_name, _build in {
    "prompt_math": _prompts("math"),
    "prompt_choice_labeled": _prompts("choice_labeled"),
    "prompt_choice_fixed": _prompts("choice_fixed"),
    "chat_math": _chats("math"),
    "chat_choice_index": _chats("choice_fixed"),
    "chat_choice_key": _chats("choice_labeled"),
}.items():
    _build.__name__ = _query_name
    query(_build)


@query
def assign_ids(spark, sf_dir):
    return _numbered(spark, sf_dir, "choice_fixed").select(
        "dataset_name", "src_id", "id_num", "split"
    )


@query
def tokens(spark, sf_dir):
    return language_model.word_pairs(fixtures.documents(spark, sf_dir)).select(
        "dataset_name", "id_num", "pos", F.col("tok").alias("token")
    )


@query
def tokens_max_length(spark, sf_dir):
    """The word limit of the reference run, which is an option here and off by default."""
    items = fixtures.documents(spark, sf_dir)
    limited = language_model.word_pairs(items, scores.MAX_LENGTH)
    return limited.groupBy("dataset_name", "id_num").agg(
        F.count("*").alias("n_tokens"), F.max("pos").alias("last_pos")
    )


# --- sampling, splitting, labelling -----------------------------------------------------


@query
def sample_exact(spark, sf_dir):
    rows = fixtures.labeled_items(spark, sf_dir).withColumn("dataset_name", F.lit("choice_labeled"))
    return sampling.sample_exact(rows).select("dataset_name", "src_id", "question")


@query
def split_positional(spark, sf_dir):
    rows = fixtures.labeled_items(spark, sf_dir).withColumn("dataset_name", F.lit("choice_labeled"))
    return sampling.split_positional(sampling.sample_exact(rows)).select(
        "dataset_name", "src_id", "id_num", "split"
    )


@query
def sample_stratified(spark, sf_dir):
    rows = materialize(fixtures.prompted(spark, sf_dir, "math"), "math")
    return sampling.sample_stratified(checks.keep_levels(rows), STRATIFIED_ROWS).select(
        "dataset_name", "src_id", "level"
    )


@query
def label_seen(spark, sf_dir):
    return fixtures.labelled_documents(spark, sf_dir).select("dataset_name", "id_num", "seen")


@query
def split_stratified_half(spark, sf_dir):
    return fixtures.split_documents(spark, sf_dir).select(
        "dataset_name", "id_num", "seen", "split"
    )


@query
def shuffle_key(spark, sf_dir):
    return sampling.shuffle_key(fixtures.documents(spark, sf_dir)).select(
        "dataset_name", "id_num", "shuffle_key"
    )


# --- joins and set operations -----------------------------------------------------------


@query
def label_join(spark, sf_dir):
    rows = fixtures.documents(spark, sf_dir).select("dataset_name", "id_num")
    labels = fixtures.table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id_num"), (F.col("quality") == 1).alias("seen")
    )
    return features.label_join(rows, labels, ["id_num"])


@query
def apply_thresholds(spark, sf_dir):
    wide = _scores(*_model(spark, sf_dir))
    train = scores.by_k(wide.where("split = 'train'"))
    thresholds = evaluate.learn_thresholds(evaluate.score_counts(train, evaluate.BY_K))
    applied = evaluate.apply_thresholds(wide.where("split = 'eval'"), thresholds, K_VALUES)
    return applied.drop("perplexity", "avg_nll", "split")


@query
def compare_methods(spark, sf_dir):
    return _comparison(spark, sf_dir)


@query
def eval_anti(spark, sf_dir):
    items = fixtures.split_documents(spark, sf_dir)
    return sampling.without(items, items.where("split = 'train'")).select(
        "dataset_name", "id_num", "seen"
    )


@query
def concat_strata(spark, sf_dir):
    items = fixtures.split_documents(spark, sf_dir).select("dataset_name", "id_num", "seen", "split")
    parts = [
        items.where((F.col("split") == split) & (F.col("seen") == seen)).withColumn(
            "stratum", F.lit(f"{split}-{'seen' if seen else 'unseen'}")
        )
        for split in ("train", "eval")
        for seen in (True, False)
    ]
    return tasks.concat(*parts).drop("seen", "split")


@query
def multi_task_union(spark, sf_dir):
    return _chat_columns(
        _all_tasks(spark, sf_dir), "global_index", "dataset_name", "id_num"
    ).drop("first_role", "second_role")


@query
def fetch_by_index(spark, sf_dir):
    requested = fixtures.table(spark, sf_dir, "benchmark").select(
        (F.col("item_id") * 450).alias("global_index")
    )
    path = scratch_path(spark, "indexed-tasks")
    tasks.write_indexed(_all_tasks(spark, sf_dir).drop("messages"), path)
    schema = "dataset_name STRING, id_num LONG, global_index LONG"
    found = tasks.fetch_indexed(spark, path, schema, requested)
    return found.select("global_index", "dataset_name", "id_num", "found")


# --- aggregations -----------------------------------------------------------------------


def _labelled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of all sources, numbered, split and labelled, without their texts."""
    columns = ["dataset_name", "id_num", "split", "seen"]
    return tasks.concat(
        *[
            sampling.label_seen(
                materialize(
                    sampling.split_positional(
                        fixtures.SOURCES[n](spark, sf_dir).select("src_id").withColumn("dataset_name", F.lit(n))
                    ),
                    f"{n}-numbered",
                ),
                ["dataset_name", "split"],
            ).select(*columns)
            for n in fixtures.SOURCES
        ]
    )


@query
def composition(spark, sf_dir):
    counts = tasks.composition(_labelled_sources(spark, sf_dir))
    return counts.withColumn("dataset_name", F.coalesce("dataset_name", F.lit("total")))


@query
def split_report(spark, sf_dir):
    return tasks.split_report(_labelled_sources(spark, sf_dir))


@query
def seen_means(spark, sf_dir):
    return evaluate.seen_means(_long_scores(*_model(spark, sf_dir)))


@query
def strata_quota(spark, sf_dir):
    items = fixtures.prompted(spark, sf_dir, "math")
    return sampling.strata_quota(checks.keep_levels(items))


# --- scoring ----------------------------------------------------------------------------


@query
def ngram_model(spark, sf_dir):
    return language_model.fitted_pairs(language_model.fit(fixtures.split_documents(spark, sf_dir)))


def _places(listed: DataFrame) -> DataFrame:
    """One row per word but the first of each sample, from arrays."""
    found = listed.select("dataset_name", "id_num", F.posexplode(F.arrays_zip("tok", "logprob")).alias("pos", "place"))
    return found.select(
        "dataset_name", "id_num", (F.col("pos") + 1).alias("pos"), F.col("place.tok").alias("token"), "place.logprob"
    )


@query
def token_logprobs(spark, sf_dir):
    _, model = _model(spark, sf_dir)
    return _places(blocks.sample_logprobs(**model, with_words=True))


@query
def token_logprobs_order3(spark, sf_dir):
    """Log-probabilities with two words of context and Kneser-Ney back-off."""
    _, listed = _longer_model(spark, sf_dir, with_words=True)
    return _places(listed)


@query
def score_table_order3(spark, sf_dir):
    """The score table from the model of order three."""
    return _longer_scores(spark, sf_dir).drop("perplexity")


@query
def metrics_order3(spark, sf_dir):
    """Metrics per dataset and k from the model of order three."""
    return evaluate.metrics_summary(scores.by_k(materialize(_longer_scores(spark, sf_dir), "scores")))


@query
def sample_perplexity(spark, sf_dir):
    found = _sample_scores(*_model(spark, sf_dir))
    perplexity = F.col("perplexity").cast("float").cast("double").alias("perplexity")
    # Rounding to 6 places would not hide the last digits of a large value.
    return found.select("dataset_name", "id_num", perplexity, "avg_nll", "num_tokens")


@query
def min_k_scores(spark, sf_dir):
    return _score_table(*_model(spark, sf_dir)).drop("perplexity", "avg_nll", "seen", "split")


@query
def score_table(spark, sf_dir):
    found = _score_table(*_model(spark, sf_dir))
    return found.withColumn("perplexity", F.col("perplexity").cast("float").cast("double"))


@query
def score_other_texts(spark, sf_dir):
    """Scores of texts that had no part in the model: unknown words and pairs count, too."""
    found = _score_table(*_other_model(spark, sf_dir))
    return found.drop("perplexity", "seen", "split")


@query
def trajectory_other_texts(spark, sf_dir):
    """Trajectories of texts that had no part in the model."""
    found = _trajectories(*_other_model(spark, sf_dir))
    return found.select(*SAMPLE_KEYS, "step", "loss", "grad_norm", F.get("embedding", F.lit(0)).alias("e0"))


@query
def last_content_token(spark, sf_dir):
    """Last content word of each document, with its vector from the pairs of the seen ones."""
    items = fixtures.split_documents(spark, sf_dir)
    vectors = word_vectors.fit(language_model.fit(items).pairs, VECTOR_DIM)
    found = scores.last_content_token(items, vectors, VECTOR_DIM)
    return found.select(
        "dataset_name", "id_num", "last_pos", "last_token",
        *[F.get("vector", F.lit(i)).alias(f"v{i}") for i in range(VECTOR_DIM)],
    )


@query
def trajectory_steps(spark, sf_dir):
    found = _trajectories(*_model(spark, sf_dir))
    return found.select(
        *SAMPLE_KEYS,
        "step",
        "loss",
        "grad_norm",
        *[F.get("embedding", F.lit(i)).alias(f"e{i}") for i in range(trajectory.DIM)],
    )


QUERIES["trajectory"] = QUERIES.pop("trajectory_steps")


@query
def adam_trajectory(spark, sf_dir):
    """Trajectories under optimiser steps on a log-linear model."""
    found = _adam_trajectories(fixtures.split_documents(spark, sf_dir))
    return found.select(
        *SAMPLE_KEYS,
        "step",
        "loss",
        "grad_norm",
        *[F.get("embedding", F.lit(i)).alias(f"e{i}") for i in range(optimiser.BUCKETS)],
    )


# --- evaluation -------------------------------------------------------------------------


@query
def auc_by_k(spark, sf_dir):
    counts = evaluate.score_counts(_long_scores(*_model(spark, sf_dir)), evaluate.BY_K)
    return evaluate.auc(counts, evaluate.BY_K)


@query
def best_threshold(spark, sf_dir):
    train = _long_scores(*_model(spark, sf_dir)).where("split = 'train'")
    return evaluate.learn_thresholds(evaluate.score_counts(train, evaluate.BY_K))


@query
def eval_accuracy(spark, sf_dir):
    long = _long_scores(*_model(spark, sf_dir))
    counts = evaluate.score_counts(long.where("split = 'train'"), evaluate.BY_K)
    thresholds = evaluate.learn_thresholds(counts)
    found = evaluate.accuracy(long.where("split = 'eval'"), thresholds)
    return found.select(*evaluate.BY_K, "eval_accuracy")


@query
def roc_points(spark, sf_dir):
    return evaluate.roc_points(_eval_counts(_long_scores(*_model(spark, sf_dir))), evaluate.BY_K)


@query
def roc_corners(spark, sf_dir):
    """ROC points without those between two equal steps."""
    counts = _eval_counts(_long_scores(*_model(spark, sf_dir)))
    return evaluate.roc_points(counts, evaluate.BY_K, drop_intermediate=True)


@query
def metrics_summary(spark, sf_dir):
    return evaluate.metrics_summary(_long_scores(*_model(spark, sf_dir)))


# --- features and classifier ------------------------------------------------------------


def _complete_states(spark, sf_dir):
    states = fixtures.stored_trajectory(spark, sf_dir)
    keys = ["dataset_name", "id_num"]
    kept = trajectories.keep_complete(states, states.withColumn("part", F.col("step")), keys, 6)
    return features.step_geometry(kept, keys)


@query
def step_l2(spark, sf_dir):
    return _complete_states(spark, sf_dir).select("dataset_name", "id_num", "step", "l2")


@query
def step_angle(spark, sf_dir):
    return _complete_states(spark, sf_dir).select("dataset_name", "id_num", "step", "angle")


@query
def trace_features(spark, sf_dir):
    return _features(*_model(spark, sf_dir))


@query
def scaled_features(spark, sf_dir):
    return _scaled(*_model(spark, sf_dir))


@query
def trace_coefficients(spark, sf_dir):
    coefficients, _ = _classified(*_model(spark, sf_dir))
    found = classifier.feature_coefficients(coefficients, features.feature_names())
    return found.withColumn("coefficient", F.round("coefficient", COEFFICIENT_DIGITS))


@query
def trace_eval(spark, sf_dir):
    _, predicted = _classified(*_model(spark, sf_dir))
    return _trace_results(predicted, _trace_counts(predicted))


@query
def adam_features(spark, sf_dir):
    """Features of the trajectories under optimiser steps."""
    items = fixtures.split_documents(spark, sf_dir)
    return _labelled_features(items, _adam_trajectories(items))


@query
def adam_eval(spark, sf_dir):
    """What classifiers on these features reach on the eval split."""
    items = fixtures.split_documents(spark, sf_dir)
    found = _labelled_features(items, _adam_trajectories(items))
    _, predicted = _fitted(_scaled_features(found))
    return _trace_results(predicted, _trace_counts(predicted))


@query
def top_coefficients(spark, sf_dir):
    coefficients, _ = _classified(*_model(spark, sf_dir))
    found = classifier.top_coefficients(coefficients, features.feature_names())
    return found.withColumn("coefficient", F.round("coefficient", COEFFICIENT_DIGITS))


# --- report tables ----------------------------------------------------------------------


@query
def roc_series(spark, sf_dir):
    items, model = _model(spark, sf_dir)
    _, predicted = _classified(items, model)
    at_k = _eval_counts(_long_scores(items, model)).where(F.col("k") == report.REPRESENTATIVE_K)
    return report.roc_series({"trace": _trace_counts(predicted), "min_k": at_k})


@query
def bar_series(spark, sf_dir):
    return report.bar_series(_comparison(spark, sf_dir), METHODS)


@query
def k_sweep(spark, sf_dir):
    metrics = materialize(evaluate.metrics_summary(_long_scores(*_model(spark, sf_dir))), "metrics")
    return report.k_sweep(metrics, SWEEP_K)


@query
def min_k_representative(spark, sf_dir):
    return _representative(_long_scores(*_model(spark, sf_dir)))


@query
def summary(spark, sf_dir):
    items, model = _model(spark, sf_dir)
    _, predicted = _classified(items, model)
    return report.summary(
        {
            "trace": _trace_results(predicted, _trace_counts(predicted)),
            "min_k": _representative(_long_scores(items, model)),
        }
    )
