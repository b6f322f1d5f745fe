"""How a sample's loss, gradient norm and embedding move under repeated updates on it.

Update ``s`` adds the sample's own pair counts to the model ``s`` times:

    p_s(t | u) = (c(u, t) + s*w*n(u, t) + base(t)) / (c(u) + s*w*n(u) + 1)

Loss is the mean of ``-ln p_s`` over the sample's words, the gradient norm is that of the
mean loss with respect to the logits of the sample's own cells, and the embedding sums
``ln p_s`` in 16 buckets of pairs. Each sample starts from the fitted model, so samples do
not depend on each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.operators.language_model import SAMPLE, probability
from seenscope.plans.joins import null_safe_join

# Fixed value: updates per sample.
NUM_STEPS = 5
DIM = 16


def pair_bucket() -> Column:
    """The bucket of a word pair: one hex digit of its hash, so one of 16."""
    pair_hash = F.md5(F.concat_ws(" ", "prev", "tok"))
    return F.conv(F.substring(pair_hash, 1, 1), 16, 10).cast("int")


def trajectory(
    model_cells: DataFrame, num_steps: int = NUM_STEPS, weight: float = 1.0, dealt: bool = False
) -> DataFrame:
    """Rows ``(sample, step)`` for step 0 to ``num_steps``: the embedding after ``step``
    updates, and the loss and gradient norm just before the last of them (none at step 0).

    Cells (``language_model.model_cells``) are shuffled by sample with their counts only;
    the step values are computed after that, summed to 16 rows per sample, and spread over
    one row per step, all without another shuffle. Cells that are ``dealt`` by sample already
    have their ``bucket`` (:func:`pair_bucket`) in place of their words.
    """
    steps = range(num_steps + 1)
    p = [
        probability(F.lit(s * weight) * F.col("n"), F.lit(s * weight) * F.col("n_prev"))
        for s in steps
    ]
    by_sample = model_cells
    if not dealt:
        by_sample = model_cells.select(
            *SAMPLE, "n", "n_prev", "c_pair", "c_prev", "base", pair_bucket().alias("bucket")
        ).repartition(*SAMPLE)
    per_cell = by_sample.select(
        *SAMPLE,
        "n",
        "bucket",
        *[(F.col("n") * F.log(p[s])).alias(f"ll_{s}") for s in steps],
        *[F.pow(F.col("n_prev") * p[s] - F.col("n"), 2).alias(f"g_{s}") for s in steps[:-1]],
    )
    return from_sums(per_cell, num_steps)


def sum_names(num_steps: int = NUM_STEPS) -> list[str]:
    return [f"ll_{s}" for s in range(num_steps + 1)] + [f"g_{s}" for s in range(num_steps)]


def cell_values(
    n: np.ndarray,
    n_prev: np.ndarray,
    c_pair: np.ndarray,
    c_prev: np.ndarray,
    base: np.ndarray,
    num_steps: int = NUM_STEPS,
    weight: float = 1.0,
) -> dict[str, np.ndarray]:
    """Each cell's share of the log-likelihood and of the squared gradient norm by step."""
    found = {}
    for s in range(num_steps + 1):
        p = (c_pair + base + s * weight * n) / (c_prev + 1.0 + s * weight * n_prev)
        found[f"ll_{s}"] = n * np.log(p)
        if s < num_steps:
            found[f"g_{s}"] = (n_prev * p - n) ** 2
    return found


def from_sums(rows: DataFrame, num_steps: int = NUM_STEPS) -> DataFrame:
    """:func:`trajectory` from the sums (:func:`sum_names`) of parts of a sample's buckets; no
    shuffle if rows are dealt by sample."""
    steps = range(num_steps + 1)
    per_bucket = rows.groupBy(*SAMPLE, "bucket").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sum_names(num_steps)]
    )
    spread = per_bucket.select(
        *SAMPLE,
        "bucket",
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("step"),
                        F.col(f"ll_{s}").alias("ll"),
                        (F.col(f"ll_{s - 1}") if s else F.lit(None).cast("double")).alias("prior_ll"),
                        (F.col(f"g_{s - 1}") if s else F.lit(None).cast("double")).alias("prior_g"),
                    )
                    for s in steps
                ]
            )
        ),
    )
    tokens = F.sum("n")
    component = [
        F.coalesce(F.sum(F.when(F.col("bucket") == i, F.col("ll"))), F.lit(0.0)) / tokens
        for i in range(DIM)
    ]
    return spread.groupBy(*SAMPLE, "step").agg(
        F.array(*component).alias("embedding"),
        (-F.sum("prior_ll") / tokens).alias("loss"),
        (F.sqrt(F.sum("prior_g")) / tokens).alias("grad_norm"),
    )


def from_listed(rows: DataFrame, num_steps: int = NUM_STEPS, keep: tuple = ()) -> DataFrame:
    """:func:`trajectory` from one row per sample with its sums (:func:`sum_names`) and counts
    ``n`` as arrays by bucket; found within the row, without a shuffle."""

    def total(values: str, zero: Column) -> Column:
        return F.aggregate(values, zero, lambda s, x: s + x)

    tokens, nothing = F.col("_tokens"), F.lit(None).cast("double")
    states = [
        F.struct(
            F.lit(s).alias("step"),
            F.transform(f"ll_{s}", lambda x: x / tokens).alias("embedding"),
            (-total(f"ll_{s - 1}", F.lit(0.0)) / tokens if s else nothing).alias("loss"),
            (F.sqrt(total(f"g_{s - 1}", F.lit(0.0))) / tokens if s else nothing).alias("grad_norm"),
        )
        for s in range(num_steps + 1)
    ]
    counted = rows.withColumn("_tokens", total("n", F.lit(0).cast("long")))
    return counted.select(*SAMPLE, *keep, F.inline(F.array(*states)))


def with_split(trajectories: DataFrame, items: DataFrame) -> DataFrame:
    """Add each sample's split from the item table."""
    return null_safe_join(trajectories, items.select(*SAMPLE, "split"), SAMPLE, "inner").select(
        "dataset_name", "split", "id_num", "step", "embedding", "loss", "grad_norm"
    )
