"""Metrics as JSON, one object per dataset and k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seenscope.sources import schemas


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRICS).json(path)
