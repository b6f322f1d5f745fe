"""Running sums over groups of any size.

Rows are range-partitioned by group and value and written with their partition number.
Sums per partition give each partition's starting point, so that a group that holds most
of the data is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seenscope.plans.joins import slot
from seenscope.plans.materialize import materialize


def running_sums(
    rows: DataFrame,
    groups: list[str],
    order: str,
    sums: list[str],
    partitions: int | None = None,
) -> DataFrame:
    """Add ``cum_x`` (inclusive, by rising ``order``) and ``total_x`` for each ``x`` in ``sums``.

    ``order`` must be unique within a group. Without ``partitions``, adaptive execution joins
    small neighbouring ranges.
    """
    columns = [*groups, order]
    by_range = (
        rows.repartitionByRange(*columns)
        if partitions is None
        else rows.repartitionByRange(partitions, *columns)
    )
    # Range bounds come from a sample, so the partition number is stored: both uses below
    # must see the same one.
    ranged = by_range.withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged.withColumn("_slot", slot(*[F.col(g) for g in groups], F.col("_part"))), "ranged")
    # At most one row per partition and group.
    parts = ranged.groupBy(*groups, "_part", "_slot").agg(*[F.sum(x).alias(x) for x in sums])
    group = Window.partitionBy(*groups)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_slot",
        *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_before_{x}") for x in sums],
        *[F.sum(x).over(group).alias(f"total_{x}") for x in sums],
    )
    offsets = materialize(offsets, "offsets")
    local = (
        Window.partitionBy("_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = ranged.join(offsets, "_slot")
    for x in sums:
        joined = joined.withColumn(f"cum_{x}", F.col(f"_before_{x}") + F.sum(x).over(local))
    return joined.drop("_part", "_slot", *[f"_before_{x}" for x in sums])
