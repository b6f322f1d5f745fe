"""The last value before each row, in groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seenscope.plans.joins import slot
from seenscope.plans.materialize import materialize


def last_before(rows: DataFrame, group: str, order: Column, value: Column, name: str) -> DataFrame:
    """Add ``name``: the last non-null ``value`` among the rows of the group that come before
    the row in rising ``order``, which must be unique in a group.

    Rows are range-partitioned and written with their partition number; a window works inside
    a partition, and one row per group and partition carries values on, so a group that holds
    most of the rows is spread over many tasks.
    """
    ordered = rows.withColumns({"_order": order, "_value": value})
    # Range bounds come from a sample, so the partition number is stored.
    ranged = ordered.repartitionByRange(group, "_order").withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged.withColumn("_slot", slot(F.col(group), F.col("_part"))), "carried-rows")
    known = F.col("_value").isNotNull()
    parts = ranged.groupBy(group, "_part", "_slot").agg(
        F.max_by(F.when(known, F.col("_value")), F.when(known, F.col("_order"))).alias("_last")
    )
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_slot", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    carried = materialize(carried.where("_carried IS NOT NULL"), "carried-values")
    inside = (
        Window.partitionBy("_slot").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    )
    found = ranged.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
    joined = found.join(carried, "_slot", "left")
    return joined.withColumn(name, F.coalesce("_inside", "_carried")).drop(
        "_order", "_value", "_part", "_slot", "_inside", "_carried"
    )
