"""Running sums by rising numbers, from a histogram over the numbers' leading bits.

Two doubles compare like their sign, exponent and mantissa, so the exponent with the first
bits of the mantissa is a bucket that never falls as numbers rise. Sums per bucket give each
bucket's starting point, and only inside a bucket rows are sorted. There are at most as many
buckets in a group as there are such bits, whatever its size; no bounds are sampled, and
nothing is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seenscope.plans.joins import slot

# Bits of the mantissa: numbers of one bucket differ by less than 1/65,536 of their size.
BITS = 16
# The least exponent of a double, and buckets beyond those of all numbers.
LEAST_EXPONENT = -1074
INFINITE = 1 << 60


def leading_bits(number: Column, bits: int = BITS) -> Column:
    """A whole number that never falls as ``number`` rises; NaN comes last, null stays null."""
    size = F.abs(number)
    guess = F.floor(F.log2(size))
    # The logarithm may be off at a power of two; powers of two are exact.
    exponent = (
        F.when(F.pow(F.lit(2.0), guess) > size, guess - 1)
        .when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1)
        .otherwise(guess)
    )
    mantissa = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * (1 << bits))
    place = (exponent - LEAST_EXPONENT) * (1 << bits) + mantissa + 1
    sign = F.when(number < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    return (
        F.when(number.isNull(), F.lit(None).cast("long"))
        .when(F.isnan(number), F.lit(INFINITE + 1))
        .when(size == float("inf"), sign * F.lit(INFINITE))
        .when(number == 0, F.lit(0))
        .otherwise(sign * place.cast("long"))
    )


def ordered_sums(rows: DataFrame, groups: list[str], order: str, sums: list[str]) -> DataFrame:
    """Add ``cum_x`` (inclusive, by rising ``order``) and ``total_x`` for each ``x`` in ``sums``.

    ``order`` is a double, unique within a group; null is lowest. Rows are shuffled once more
    than ``rows`` already are: by group and bucket, for the join and the window alike.
    """
    placed = rows.withColumn("_bucket", leading_bits(F.col(order)))
    placed = placed.withColumn("_slot", slot(*[F.col(g) for g in groups], F.col("_bucket")))
    buckets = placed.groupBy(*groups, "_bucket", "_slot").agg(*[F.sum(x).alias(x) for x in sums])
    group = Window.partitionBy(*groups)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        "_slot",
        *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_before_{x}") for x in sums],
        *[F.sum(x).over(group).alias(f"total_{x}") for x in sums],
    )
    local = (
        Window.partitionBy("_slot").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = placed.join(offsets, "_slot")
    for x in sums:
        joined = joined.withColumn(f"cum_{x}", F.col(f"_before_{x}") + F.sum(x).over(local))
    return joined.drop("_bucket", "_slot", *[f"_before_{x}" for x in sums])
