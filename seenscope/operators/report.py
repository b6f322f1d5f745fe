"""Tables behind the report figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seenscope.operators.evaluate import auc, roc_points
from seenscope.plans.joins import null_safe_join
from seenscope.plans.materialize import materialize

# Fixed value: the k that stands for the lowest-k% method.
REPRESENTATIVE_K = 30


def dataset_list(df: DataFrame, datasets: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(d,) for d in datasets], "dataset_name STRING")


def representative(
    eval_counts: DataFrame, metrics: DataFrame, k: int = REPRESENTATIVE_K
) -> DataFrame:
    """AUC from the eval scores and accuracy from the metrics, at one k."""
    at_k = eval_counts.where(F.col("k") == k)
    accuracy = metrics.where(F.col("k") == k).select(
        "dataset_name", F.col("eval_accuracy").alias("accuracy")
    )
    return null_safe_join(auc(at_k, ["dataset_name"]), accuracy, ["dataset_name"], "inner")


def compare_methods(
    datasets: list[str], a: DataFrame, b: DataFrame, names: tuple[str, str]
) -> DataFrame:
    """One row per listed dataset; null where a method has no result.

    ``a`` and ``b`` have ``dataset_name``, ``auc`` and ``accuracy``.
    """
    table = dataset_list(a, datasets)
    for method, name in ((a, names[0]), (b, names[1])):
        table = table.join(
            method.select(
                "dataset_name",
                F.col("auc").alias(f"{name}_auc"),
                F.col("accuracy").alias(f"{name}_accuracy"),
            ),
            "dataset_name",
            "left",
        )
    return table.withColumn("dataset", F.upper("dataset_name")).drop("dataset_name")


def bar_series(comparison: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Bars per dataset, method and measure; a missing result is 0."""
    bars = F.array(
        *[
            F.struct(
                F.lit(name).alias("method"),
                F.lit(measure).alias("measure"),
                F.coalesce(F.col(f"{name}_{measure}"), F.lit(0.0)).alias("value"),
            )
            for measure in ("auc", "accuracy")
            for name in names
        ]
    )
    return comparison.select("dataset", F.inline(bars))


def k_sweep(metrics: DataFrame, k_values: list[int]) -> DataFrame:
    """Eval AUC and accuracy of each dataset, the null one too, at each listed k; a missing k
    is 0."""
    listed = (
        metrics.select("dataset_name")
        .distinct()
        .select("dataset_name", F.explode(F.array(*[F.lit(k) for k in k_values])).alias("k"))
    )
    values = metrics.select("dataset_name", "k", "eval_auc", "eval_accuracy")
    found = null_safe_join(listed, values, ["dataset_name", "k"], "left")
    return found.na.fill(0.0, ["eval_auc", "eval_accuracy"])


def roc_series(methods: dict[str, DataFrame]) -> DataFrame:
    """ROC points and AUC of several methods; each value is a table of score counts."""
    series = None
    for name, counts in methods.items():
        # Written: one row per dataset, so the points are not shuffled for it.
        areas = materialize(auc(counts, ["dataset_name"]), "areas")
        points = null_safe_join(
            roc_points(counts, ["dataset_name"]), areas, ["dataset_name"], "inner"
        ).withColumn("method", F.lit(name))
        series = points if series is None else series.unionByName(points)
    return series


def summary(methods: dict[str, DataFrame]) -> DataFrame:
    """AUC and accuracy per method and dataset."""
    table = None
    for name, results in methods.items():
        rows = results.select(F.lit(name).alias("method"), "dataset_name", "auc", "accuracy")
        table = rows if table is None else table.unionByName(rows)
    return table
