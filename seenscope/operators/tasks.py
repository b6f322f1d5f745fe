"""Several datasets as one training table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seenscope.plans.ordering import number_rows

# Ids are unique within a dataset, so a bucket of this many ids never holds more rows.
IDS_PER_BUCKET = 100_000
# Rows of one range of a table written by index.
RANGE_ROWS = 100_000


def concat(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def union_tasks(tables: list[DataFrame]) -> DataFrame:
    """Union in the given order with a running ``global_index`` from 0."""
    ranked = [t.withColumn("_task", F.lit(i)) for i, t in enumerate(tables)]
    united = concat(*ranked).withColumn("_all", F.lit(0))
    id_range: Column = F.floor(F.col("id_num") / IDS_PER_BUCKET).cast("long")
    bucket = F.struct(F.col("_task"), id_range)
    numbered = number_rows(
        united, ["_all"], bucket, [F.col("_task"), F.col("id_num")], "global_index"
    )
    return numbered.drop("_all", "_task")


def _range(rows: int) -> Column:
    return F.floor(F.col("global_index") / rows).cast("long").alias("index_range")


def write_indexed(tasks: DataFrame, path: str, range_rows: int = RANGE_ROWS) -> None:
    """Write a numbered table as one folder per range of ``global_index``, sorted in it, so
    that a fetch reads the ranges it needs and, by their statistics, few row groups of these."""
    ranged = tasks.select("*", _range(range_rows)).repartition("index_range")
    ranged.sortWithinPartitions("index_range", "global_index").write.partitionBy("index_range").parquet(path)


def fetch_indexed(
    spark: SparkSession, path: str, schema: str, requested: DataFrame, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """:func:`fetch` from a table that :func:`write_indexed` has written with as many
    ``range_rows``; nothing is numbered again.

    Which folders are read is known only when the requested ranges are: the join on
    ``index_range`` prunes partitions at run time while the requested side is small enough to
    broadcast, and is an ordinary join beyond that.
    """
    written = spark.read.schema(f"{schema}, index_range LONG").parquet(path)
    asked = requested.select("global_index").distinct().where("global_index >= 0")
    hits = written.join(asked.select("global_index", _range(range_rows)), ["index_range", "global_index"])
    return fetch(hits.drop("index_range"), requested)


def fetch(tasks: DataFrame, requested: DataFrame) -> DataFrame:
    """Rows for the requested ``global_index`` values; ``found`` is false out of range."""
    return requested.join(
        tasks.withColumn("found", F.lit(True)), "global_index", "left"
    ).withColumn("found", F.coalesce("found", F.lit(False)))


def fetch_or_fail(tasks: DataFrame, requested: DataFrame) -> DataFrame:
    """Like :func:`fetch`, but an index out of range is an error."""
    found = fetch(tasks, requested)
    message = F.concat(F.lit("index out of range: "), F.col("global_index").cast("string"))
    return found.where(F.when(F.col("found"), True).otherwise(F.raise_error(message))).drop("found")


def composition(tasks: DataFrame) -> DataFrame:
    """Rows per dataset, and in all (null ``dataset_name``)."""
    return tasks.rollup("dataset_name").agg(F.count("*").alias("n_rows"))


def split_report(items: DataFrame) -> DataFrame:
    return items.groupBy("dataset_name", "split").agg(
        F.count("*").alias("n_rows"), F.count_if("seen").alias("n_seen")
    )
