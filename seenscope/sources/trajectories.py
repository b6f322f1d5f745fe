"""Trajectory tables: one row per sample and step, in place of parallel arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seenscope.plans.joins import null_safe_join
from seenscope.sources import schemas
from seenscope.sources.items import write_items

PARTS = ["embedding", "id_num", "loss", "grad_norm"]


def write_trajectory(df: DataFrame, path: str) -> None:
    write_items(df, path)


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRAJECTORY).parquet(path)


def parts_present(trajectory: DataFrame) -> DataFrame:
    """One row per dataset, split and part that holds any value."""
    present = trajectory.groupBy("dataset_name", "split").agg(
        *[F.bool_or(F.col(p).isNotNull()).alias(p) for p in PARTS]
    )
    return present.select(
        "dataset_name",
        "split",
        F.explode(
            F.filter(
                F.array(*[F.when(F.col(p), F.lit(p)) for p in PARTS]), lambda p: p.isNotNull()
            )
        ).alias("part"),
    )


def complete(parts: DataFrame, keys: list[str], wanted: int, part: str = "part") -> DataFrame:
    """Keys that have all ``wanted`` parts."""
    return (
        parts.groupBy(*keys)
        .agg(F.count_distinct(part).alias("_parts"))
        .where(F.col("_parts") == wanted)
        .drop("_parts")
    )


def keep_complete(df: DataFrame, parts: DataFrame, keys: list[str], wanted: int) -> DataFrame:
    """Rows whose key has all ``wanted`` parts; a null in the key is a value like any other."""
    return null_safe_join(df, complete(parts, keys, wanted), keys, "left_semi")


def summarize(trajectory: DataFrame) -> DataFrame:
    """Counts, shape and id range per dataset and split."""
    return trajectory.groupBy("dataset_name", "split").agg(
        F.count_if(F.col("step") == 0).alias("num_samples"),
        (F.max("step") + 1).cast("long").alias("num_states"),
        F.max(F.size("embedding")).cast("long").alias("dim"),
        F.min("id_num").alias("id_num_min"),
        F.max("id_num").alias("id_num_max"),
        F.bool_or(F.col("loss").isNotNull()).alias("has_losses"),
        F.bool_or(F.col("grad_norm").isNotNull()).alias("has_grad_norms"),
    )


def summarize_all(trajectory: DataFrame) -> DataFrame:
    """The same over the whole table; an empty table gives 0 for the id range."""
    return trajectory.agg(
        F.count_if(F.col("step") == 0).alias("num_samples"),
        F.coalesce(F.min("id_num"), F.lit(0)).alias("id_num_min"),
        F.coalesce(F.max("id_num"), F.lit(0)).alias("id_num_max"),
        F.coalesce(F.bool_or(F.col("loss").isNotNull()), F.lit(False)).alias("has_losses"),
        F.coalesce(F.bool_or(F.col("grad_norm").isNotNull()), F.lit(False)).alias(
            "has_grad_norms"
        ),
    )
