"""Ranks in a seeded hash order, without a global sort.

The order key is an md5 text, so its first digits split any group into 65,536 buckets of
nearly equal size. Bucket counts give the bucket in which the wanted rank falls; only
that bucket is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seenscope.plans.joins import null_safe_join, slot
from seenscope.plans.materialize import materialize

# Fixed value: the seed of all hash orders.
SEED = 42
BUCKET_DIGITS = 4
# Spark's own bound on ranks that it limits before the shuffle, and its default.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
DEFAULT_GROUP_LIMIT = "1000"


def order_key(purpose: str, *columns: str, seed: int = SEED) -> Column:
    """md5 of ``seed:purpose:columns``; each purpose gives an independent order."""
    parts = [F.col(c).cast("string") for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *parts))


def cutoffs(rows: DataFrame, groups: list[str], key: Column, tie: str, quota: Column) -> DataFrame:
    """The key and tie value of the row with rank ``quota`` in each group.

    ``quota`` may use the column ``group_rows``. A group with quota 0 has no row here; a
    quota above the group's size gives its last row.
    """
    keyed = rows.select(*groups, key.alias("_key"), F.col(tie).alias("_tie")).withColumn(
        "_bucket", F.substring("_key", 1, BUCKET_DIGITS)
    )
    counts = keyed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_rows"))
    group = Window.partitionBy(*groups)
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = (
        counts.withColumn("_upto", F.sum("_rows").over(upto))
        .withColumn("group_rows", F.sum("_rows").over(group))
        .withColumn("_quota", F.least(quota, F.col("group_rows")))
        .where("_quota > _upto - _rows AND _quota <= _upto")
        .select(*groups, "_bucket", (F.col("_quota") - F.col("_upto") + F.col("_rows")).alias("_at"))
    )
    edges = materialize(edges, "edges")
    in_bucket = Window.partitionBy(*groups).orderBy("_key", "_tie")
    last = (
        null_safe_join(keyed, edges, [*groups, "_bucket"], "inner")
        .withColumn("_rank", F.row_number().over(in_bucket))
        .where("_rank = _at")
        .select(*groups, F.col("_key").alias("cut_key"), F.col("_tie").alias("cut_tie"))
    )
    return materialize(last, "cutoffs")


def mark_first(
    df: DataFrame, groups: list[str], key: Column, tie: str, quota: Column, flag: str
) -> DataFrame:
    """Add a boolean ``flag``: is the row among the first ``quota`` of its group?

    The rows themselves are not shuffled: they meet one cut-off per group.
    """
    marked = null_safe_join(df, cutoffs(df, groups, key, tie, quota), groups, "left")
    first = (key < F.col("cut_key")) | (
        (key == F.col("cut_key")) & (F.col(tie) <= F.col("cut_tie"))
    )
    return marked.withColumn(flag, F.coalesce(first, F.lit(False))).drop("cut_key", "cut_tie")


def limits_ranks(df: DataFrame, most: int) -> bool:
    """Would Spark keep only the first ``most`` rows of each group before it shuffles?"""
    return most <= int(df.sparkSession.conf.get(GROUP_LIMIT, DEFAULT_GROUP_LIMIT))


def take_first(
    df: DataFrame, groups: list[str], key: Column, tie: str, quota: Column, most: int
) -> DataFrame:
    """The first ``quota`` rows of each group; ``most`` is the largest quota.

    A small one is a limit on the rank: each task hands on at most ``most`` rows per group,
    and the table is read once. A larger one compares rows with a cut-off per group, so that
    no task sorts a group.
    """
    if not limits_ranks(df, most):
        marked = mark_first(df, groups, key, tie, quota, "_chosen")
        return marked.where("_chosen").drop("_chosen")
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(key, F.col(tie)))
    ranked = df.withColumn("_rank", rank).where(F.col("_rank") <= most)
    return ranked.where(F.col("_rank") <= quota).drop("_rank")


def number_rows(
    df: DataFrame, groups: list[str], bucket: Column, order: list[Column], name: str
) -> DataFrame:
    """Add a 0-based running number per group in the given order.

    ``bucket`` must never fall as ``order`` rises, and must keep its rows few; the numbers
    are then a bucket's offset plus the place within the bucket.
    """
    bucketed = df.withColumn("_bucket", bucket).withColumn(
        "_slot", slot(*[F.col(g) for g in groups], F.col("_bucket"))
    )
    counts = bucketed.groupBy(*groups, "_bucket", "_slot").agg(F.count("*").alias("_rows"))
    # One row per bucket, not per item.
    before = (
        Window.partitionBy(*groups)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select("_slot", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    # Written, so that a small table is broadcast; a large one is dealt like the window.
    offsets = materialize(offsets, "offsets")
    in_bucket = Window.partitionBy("_slot").orderBy(*order)
    return (
        bucketed.join(offsets, "_slot")
        .withColumn(name, F.col("_offset") + F.row_number().over(in_bucket) - 1)
        .drop("_bucket", "_slot", "_offset")
    )


def number_by_hash(df: DataFrame, groups: list[str], key: Column, tie: str, name: str) -> DataFrame:
    """0-based place of each row in its group's hash order."""
    keyed = df.withColumn("_key", key)
    numbered = number_rows(
        keyed,
        groups,
        F.substring("_key", 1, BUCKET_DIGITS),
        [F.col("_key"), F.col(tie)],
        name,
    )
    return numbered.drop("_key")
