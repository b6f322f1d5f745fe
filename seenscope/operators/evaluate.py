"""ROC-AUC, thresholds, accuracy and ROC points of scores against the seen label.

A **lower** score means seen. Every measure comes from counts per distinct score and their
running sums, so no group of scores is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.plans.carry import last_before
from seenscope.plans.histogram import ordered_sums
from seenscope.plans.joins import null_safe_join
from seenscope.plans.materialize import materialize

BY_K = ["dataset_name", "k"]


def score_counts(
    scores: DataFrame, groups: list[str], score: str = "score", label: str = "seen"
) -> DataFrame:
    """Seen and unseen rows per distinct score, with running sums by rising score."""
    counts = scores.groupBy(*groups, F.col(score).alias("score")).agg(
        F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg")
    )
    return ordered_sums(counts.withColumn("score", F.col("score").cast("double")), groups, "score", ["pos", "neg"])


def _auc() -> Column:
    """Share of (seen, unseen) pairs in which the seen one scores lower; ties count half."""
    above = F.col("total_neg") - F.col("cum_neg")
    won = F.sum(F.col("pos") * (above + F.col("neg") / F.lit(2.0)))
    pairs = F.max("total_pos").cast("double") * F.max("total_neg")
    return F.when(pairs > 0, won / pairs).otherwise(F.lit(0.5))


def auc(counts: DataFrame, groups: list[str]) -> DataFrame:
    return counts.groupBy(*groups).agg(_auc().alias("auc"))


def best_thresholds(counts: DataFrame, groups: list[str]) -> DataFrame:
    """The threshold ``v`` among the scores for which ``score < v`` agrees with the label
    most often (the smallest on ties, the median if none agrees at all), its accuracy, and
    the AUC."""
    rows = F.col("total_pos") + F.col("total_neg")
    right = (
        (F.col("cum_pos") - F.col("pos")) + F.col("total_neg") - (F.col("cum_neg") - F.col("neg"))
    )
    best = F.max(F.struct(right.alias("right"), (-F.col("score")).alias("minus_score")))
    upto = F.col("cum_pos") + F.col("cum_neg")
    lower = F.min(F.when(upto >= F.floor((rows + 1) / 2), F.col("score")))
    upper = F.min(F.when(upto >= F.floor(rows / 2) + 1, F.col("score")))
    found = counts.groupBy(*groups).agg(
        best.alias("best"),
        F.max(rows).alias("n_rows"),
        ((lower + upper) / 2).alias("median"),
        _auc().alias("auc"),
    )
    return found.select(
        *groups,
        F.when(F.col("best.right") > 0, -F.col("best.minus_score"))
        .otherwise(F.col("median"))
        .alias("threshold"),
        (F.col("best.right") / F.col("n_rows")).alias("accuracy"),
        "auc",
    )


def learn_thresholds(train_counts: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Threshold table from the counts of the train split, written: one row per group."""
    groups = BY_K if groups is None else groups
    found = best_thresholds(train_counts, groups)
    return materialize(
        found.select(
            *groups,
            "threshold",
            F.col("accuracy").alias("train_accuracy"),
            F.col("auc").alias("train_auc"),
        ),
        "thresholds",
    )


def accuracy(scores: DataFrame, thresholds: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Share of rows whose label agrees with ``score < threshold``, and the mean score of
    seen and of unseen rows."""
    groups = BY_K if groups is None else groups
    judged = null_safe_join(scores, thresholds.select(*groups, "threshold"), groups, "inner")
    agrees = (F.col("score") < F.col("threshold")) == F.col("seen")
    return judged.groupBy(*groups).agg(
        F.avg(agrees.cast("double")).alias("eval_accuracy"),
        F.avg(F.when(F.col("seen"), F.col("score"))).alias("seen_mean"),
        F.avg(F.when(~F.col("seen"), F.col("score"))).alias("unseen_mean"),
    )


def seen_means(scores: DataFrame, groups: list[str] | None = None) -> DataFrame:
    groups = BY_K if groups is None else groups
    return scores.groupBy(*groups).agg(
        F.avg(F.when(F.col("seen"), F.col("score"))).alias("seen_mean"),
        F.avg(F.when(~F.col("seen"), F.col("score"))).alias("unseen_mean"),
    )


def apply_thresholds(scores: DataFrame, thresholds: DataFrame, k_values: list[int]) -> DataFrame:
    """Add ``epsilon_k_X``, ``pred_k_X`` and ``auc_k_X`` to a wide score table."""

    def at(k: int, column: str) -> Column:
        return F.max(F.when(F.col("k") == k, F.col(column)))

    wide = thresholds.groupBy("dataset_name").agg(
        *[at(k, "threshold").alias(f"epsilon_k_{k}") for k in k_values],
        *[at(k, "train_auc").alias(f"auc_k_{k}") for k in k_values],
    )
    wide = materialize(wide, "wide-thresholds")
    joined = null_safe_join(scores, wide, ["dataset_name"], "left")
    for k in k_values:
        joined = joined.withColumn(f"pred_k_{k}", F.col(f"min_k_{k}") < F.col(f"epsilon_k_{k}"))
    return joined


def _corners(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Without the scores between two neighbours that rise by as many seen and unseen rows:
    their points are not needed to draw the curve.

    A score's neighbours are the next ones in rising order. They are found twice with
    :func:`last_before`, so a group of any size is spread over many tasks; groups are one
    text, nulls included.
    """
    key = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"})
    step = F.struct("pos", "neg")
    before = last_before(counts.withColumn("_group", key), "_group", F.col("score"), F.lit(1), "_before")
    after = last_before(before, "_group", -F.col("score"), step, "_after")
    same = (F.col("_after.pos") == F.col("pos")) & (F.col("_after.neg") == F.col("neg"))
    inner = F.col("_before").isNotNull() & F.col("_after").isNotNull()
    return after.where(~(inner & same)).drop("_group", "_before", "_after")


def roc_points(counts: DataFrame, groups: list[str], drop_intermediate: bool = False) -> DataFrame:
    """``(fpr, tpr)`` after each distinct score, with the starting point (0, 0).

    With ``drop_intermediate``, a point between two equal steps is left out, but for the
    first and the last point.
    """
    if drop_intermediate:
        counts = _corners(counts, groups)

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))

    points = counts.select(
        *groups,
        share("cum_neg", "total_neg").alias("fpr"),
        share("cum_pos", "total_pos").alias("tpr"),
    )
    origin = counts.select(*groups).distinct().select(
        *groups, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def metrics_summary(scores: DataFrame) -> DataFrame:
    """One row per dataset and k: what the train split teaches and how it does on eval.

    ``scores`` is in long form with both splits; one pass of running sums serves both.
    """
    counts = score_counts(scores, ["dataset_name", "split", "k"])
    thresholds = learn_thresholds(counts.where("split = 'train'"))
    eval_auc = auc(counts.where("split = 'eval'"), BY_K).withColumnRenamed("auc", "eval_auc")
    judged = accuracy(scores.where("split = 'eval'"), thresholds)
    return (
        null_safe_join(null_safe_join(thresholds, judged, BY_K, "inner"), eval_auc, BY_K, "inner")
        .select(
            *BY_K,
            "threshold",
            "train_accuracy",
            "eval_accuracy",
            "train_auc",
            "eval_auc",
            "seen_mean",
            "unseen_mean",
        )
    )
