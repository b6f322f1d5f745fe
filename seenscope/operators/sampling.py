"""Exact samples, labels and splits in seeded hash orders.

Each purpose has its own hash order, so the choices are independent of each other and the
same on every run. A row is chosen by comparing its hash with one cut-off per group
(:mod:`seenscope.plans.ordering`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.plans.joins import null_safe_join
from seenscope.plans.materialize import materialize
from seenscope.plans.ordering import SEED, mark_first, number_by_hash, order_key, take_first

# Rows asked for per dataset, and how many of them are not validation rows.
SAMPLE_ROWS = 1100
CONTAM_ROWS = 1000


def half(rows: str = "group_rows") -> Column:
    return F.floor(F.col(rows) / 2)


def sample_exact(
    df: DataFrame,
    n: int = SAMPLE_ROWS,
    groups: list[str] | None = None,
    id_col: str = "src_id",
    seed: int = SEED,
) -> DataFrame:
    """``n`` rows of each group without replacement (all rows of a smaller group)."""
    groups = ["dataset_name"] if groups is None else groups
    key = order_key("sample", *groups, id_col, seed=seed)
    return take_first(df, groups, key, id_col, F.lit(n), n)


def strata_quota(df: DataFrame, stratum: str = "level", n: int = SAMPLE_ROWS) -> DataFrame:
    """Number of strata in each dataset and rows to draw from each."""
    return df.groupBy("dataset_name").agg(
        F.count_distinct(stratum).alias("n_strata"),
        F.floor(F.lit(n) / F.count_distinct(stratum)).cast("long").alias("quota"),
    )


def sample_stratified(
    df: DataFrame,
    n: int = SAMPLE_ROWS,
    stratum: str = "level",
    id_col: str = "src_id",
    seed: int = SEED,
) -> DataFrame:
    """An equal share of ``n`` from each stratum, all rows of a stratum that is short."""
    quotas = materialize(strata_quota(df, stratum, n), "quotas")
    with_quota = null_safe_join(df, quotas.select("dataset_name", "quota"), ["dataset_name"], "inner")
    # The quota is constant in a dataset; it groups the strata without changing them.
    groups = ["dataset_name", stratum, "quota"]
    key = order_key("sample", "dataset_name", id_col, seed=seed)
    most = quotas.agg(F.coalesce(F.max("quota"), F.lit(0))).first()[0]
    return take_first(with_quota, groups, key, id_col, F.col("quota"), most).drop("quota")


def split_positional(
    df: DataFrame, contam_rows: int = CONTAM_ROWS, id_col: str = "src_id", seed: int = SEED
) -> DataFrame:
    """Number the rows of each dataset from 0 in hash order; the first ``contam_rows`` are
    the ``contam`` split, and ``val`` goes on counting."""
    key = order_key("position", "dataset_name", id_col, seed=seed)
    numbered = number_by_hash(df, ["dataset_name"], key, id_col, "id_num")
    return numbered.withColumn(
        "split", F.when(F.col("id_num") < contam_rows, "contam").otherwise("val")
    )


def label_seen(
    df: DataFrame, groups: list[str] | None = None, id_col: str = "id_num", seed: int = SEED
) -> DataFrame:
    """Mark exactly half of each group as seen (rounded down)."""
    groups = ["dataset_name"] if groups is None else groups
    key = order_key("seen", "dataset_name", id_col, seed=seed)
    return mark_first(df, groups, key, id_col, half(), "seen")


def split_half(df: DataFrame, id_col: str = "id_num", seed: int = SEED) -> DataFrame:
    """Half of the seen and half of the unseen rows of each dataset to ``train``, the rest,
    with the odd row, to ``eval``."""
    key = order_key("split", "dataset_name", id_col, seed=seed)
    marked = mark_first(df, ["dataset_name", "seen"], key, id_col, half(), "_train")
    split = F.when(F.col("_train"), "train").otherwise("eval")
    return marked.withColumn("split", split).drop("_train")


def shuffle_key(df: DataFrame, id_col: str = "id_num", seed: int = SEED) -> DataFrame:
    """Add the key that puts a table in random order; sort by it only when writing."""
    return df.withColumn("shuffle_key", order_key("shuffle", "dataset_name", id_col, seed=seed))


def without(df: DataFrame, chosen: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` that are not in ``chosen``."""
    keys = ["dataset_name", "id_num"] if keys is None else keys
    return null_safe_join(df, chosen.select(*keys), keys, "left_anti")
