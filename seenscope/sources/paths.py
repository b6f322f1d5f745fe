"""Dataset, level and split from file paths; datasets present in both splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seenscope.plans.joins import null_safe_join
from seenscope.plans.materialize import materialize

# The three path parts after the first part named "data"; a part may be written as
# name=value, and the split may be a file or a folder ending in ".parquet".
_PART = r"(?:[^/=]+=)?([^/]+)"
DATA_PATH = rf"/data/{_PART}/{_PART}/(?:[^/=]+=)?([^/]+?)(?:\.parquet)?(?:/|$)"


def read_with_path_columns(
    spark: SparkSession, path: str, schema: str, pattern: str = DATA_PATH
) -> DataFrame:
    """Read all parquet files below ``path``; files outside a data folder are skipped."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    file_path = F.col("_metadata.file_path")
    return (
        df.where(file_path.rlike(pattern))
        .withColumn("dataset_name", F.regexp_extract(file_path, pattern, 1))
        .withColumn("level", F.regexp_extract(file_path, pattern, 2))
        .withColumn("split", F.regexp_extract(file_path, pattern, 3))
    )


def paired(eval_items: DataFrame, train_items: DataFrame) -> DataFrame:
    """Eval rows of those datasets that also have train rows. The names are written, so the
    eval rows are not shuffled for a few of them."""
    datasets = materialize(train_items.select("dataset_name").distinct(), "dataset-names")
    return null_safe_join(eval_items, datasets, ["dataset_name"], "left_semi")
