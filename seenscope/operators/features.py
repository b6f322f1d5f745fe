"""Trajectory features: losses, gradient norms, distances and angles by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seenscope.functions.vectors import angle, l2_distance
from seenscope.operators.trajectory import NUM_STEPS
from seenscope.plans.joins import null_safe_join
from seenscope.plans.materialize import materialize

# Feature name stems, in order.
STEMS = ["Loss", "GradNorm", "L2Dist", "Angle"]


def feature_names(num_steps: int = NUM_STEPS) -> list[str]:
    return [f"{stem}_Step{i}" for stem in STEMS for i in range(1, num_steps + 1)]


def label_join(rows: DataFrame, labels: DataFrame, keys: list[str], label: str = "seen") -> DataFrame:
    """Left join of a label; a row without one gets false, a null key has one like any other.

    Labels must have unique keys: the query fails where they have not.
    """
    message = F.concat_ws(" ", F.lit("more than one label for"), *[F.col(k).cast("string") for k in keys])
    one = labels.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(label).alias(label)).select(
        *keys, F.when(F.col("_n") == 1, F.col(label)).otherwise(F.raise_error(message)).alias(label)
    )
    return null_safe_join(rows, one, keys, "left").withColumn(
        label, F.coalesce(F.col(label), F.lit(False))
    )


def step_geometry(trajectories: DataFrame, keys: list[str]) -> DataFrame:
    """Distance and angle of each step's embedding to that of step 0."""
    start = F.max(F.when(F.col("step") == 0, F.col("embedding"))).over(Window.partitionBy(*keys))
    return (
        trajectories.withColumn("_start", start)
        .where("step > 0")
        .withColumn("l2", l2_distance(F.col("embedding"), F.col("_start")))
        .withColumn("angle", angle(F.col("embedding"), F.col("_start")))
        .drop("_start")
    )


def trace_features(
    trajectories: DataFrame, keys: list[str], num_steps: int = NUM_STEPS
) -> DataFrame:
    """One row per sample with ``Loss_Step1`` ... ``Angle_StepN``."""
    columns = dict(zip(STEMS, ["loss", "grad_norm", "l2", "angle"], strict=True))

    def at(stem: str, step: int) -> Column:
        value = F.max(F.when(F.col("step") == step, F.col(columns[stem])))
        return value.alias(f"{stem}_Step{step}")

    return (
        step_geometry(trajectories, keys)
        .groupBy(*keys)
        .agg(*[at(stem, i) for stem in STEMS for i in range(1, num_steps + 1)])
    )


def scaler(train: DataFrame, names: list[str]) -> DataFrame:
    """Mean and population deviation of each feature per dataset, written. A constant
    feature gets deviation 1."""
    found = train.groupBy("dataset_name").agg(
        *[F.avg(f).alias(f"_mean_{f}") for f in names],
        *[
            F.when(F.min(f) == F.max(f), F.lit(1.0)).otherwise(F.stddev_pop(f)).alias(f"_dev_{f}")
            for f in names
        ],
    )
    return materialize(found, "scaler")


def scale(features: DataFrame, parameters: DataFrame, names: list[str]) -> DataFrame:
    others = [c for c in features.columns if c not in names]
    return null_safe_join(features, parameters, ["dataset_name"], "inner").select(
        *others,
        *[((F.col(f) - F.col(f"_mean_{f}")) / F.col(f"_dev_{f}")).alias(f) for f in names],
    )
