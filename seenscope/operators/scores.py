"""Scores per sample: perplexity and lowest-k% log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seenscope.functions.words import is_special, words
from seenscope.operators import word_vectors
from seenscope.operators.language_model import SAMPLE
from seenscope.plans.joins import null_safe_join

# The shares of lowest log-probabilities, and the word limit of the option.
K_RATIOS = [0.1, 0.2, 0.3, 0.5]
MAX_LENGTH = 2048


def k_percent(ratio: float) -> int:
    return int(ratio * 100)


def min_k_name(ratio: float) -> str:
    return f"min_k_{k_percent(ratio)}"


def sample_scores(
    logprobs: DataFrame, k_ratios: list[float] | None = None, dealt: bool = False
) -> DataFrame:
    """Mean negative log-likelihood, perplexity, word count and, for each ratio, minus the
    mean of the lowest ``max(1, int(num_tokens * ratio))`` log-probabilities. ``logprobs`` has
    distinct pairs with their counts ``n``.

    One shuffle by sample, none if they are ``dealt`` by it already. There, equal values are
    merged, unless dealt, and the rest sorted in a window that can spill, so whole texts of any
    length are scored.
    """
    k_ratios = K_RATIOS if k_ratios is None else k_ratios
    values = logprobs
    if not dealt:
        values = logprobs.repartition(*SAMPLE).groupBy(*SAMPLE, "logprob").agg(F.sum("n").alias("n"))
    sample = Window.partitionBy(*SAMPLE[::-1])
    upto = sample.orderBy("logprob").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = values.withColumn("_upto", F.sum("n").over(upto)).withColumn(
        "_tokens", F.sum("n").over(sample)
    )

    def lowest(ratio: float) -> Column:
        wanted = F.greatest(F.lit(1), F.floor(F.col("_tokens") * F.lit(ratio)))
        before = F.col("_upto") - F.col("n")
        taken = F.greatest(F.lit(0), F.least(F.col("n"), wanted - before))
        return -F.sum(taken * F.col("logprob")) / F.sum(taken)

    nll = -F.sum(F.col("n") * F.col("logprob")) / F.sum("n")
    return placed.groupBy(*SAMPLE).agg(
        F.exp(nll).alias("perplexity"),
        nll.alias("avg_nll"),
        F.sum("n").alias("num_tokens"),
        *[lowest(r).alias(min_k_name(r)) for r in k_ratios],
    )


def listed_scores(listed: DataFrame, k_ratios: list[float] | None = None) -> DataFrame:
    """The same from one row per sample with its log-probabilities as an array ``logprob``;
    found within the row, without a shuffle."""
    k_ratios = K_RATIOS if k_ratios is None else k_ratios
    size = F.size("logprob")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    def lowest(ratio: float) -> Column:
        wanted = F.greatest(F.lit(1), F.floor(size * F.lit(ratio)).cast("int"))
        return -total(F.slice("logprob", F.lit(1), wanted)) / wanted

    ordered = listed.where(size > 0).select(*SAMPLE, F.sort_array("logprob").alias("logprob"))
    placed = ordered.withColumn("avg_nll", -total(F.col("logprob")) / size)
    return placed.select(
        *SAMPLE,
        F.exp("avg_nll").alias("perplexity"),
        "avg_nll",
        size.cast("long").alias("num_tokens"),
        *[lowest(r).alias(min_k_name(r)) for r in k_ratios],
    )


def score_table(
    items: DataFrame, logprobs: DataFrame, k_ratios: list[float] | None = None, dealt: bool = False
) -> DataFrame:
    """One row per item: scores, with the label and split columns the item has.

    A text of fewer than two words has no log-probability: 0 words, every lowest-k% score
    0, no perplexity.
    """
    return with_items(items, sample_scores(logprobs, k_ratios, dealt), k_ratios)


def with_items(items: DataFrame, found: DataFrame, k_ratios: list[float] | None = None) -> DataFrame:
    """A score table from the scores of samples."""
    k_ratios = K_RATIOS if k_ratios is None else k_ratios
    labels = [c for c in ("split", "seen") if c in items.columns]
    joined = null_safe_join(items.select(*SAMPLE, *labels), found, SAMPLE, "left")
    return joined.select(
        *SAMPLE,
        *labels,
        "perplexity",
        "avg_nll",
        F.coalesce("num_tokens", F.lit(0)).alias("num_tokens"),
        *[
            F.coalesce(min_k_name(r), F.lit(0.0)).alias(min_k_name(r))
            for r in k_ratios
        ],
    )


def by_k(scores: DataFrame, k_ratios: list[float] | None = None) -> DataFrame:
    """Long form: one row per item and k."""
    k_ratios = K_RATIOS if k_ratios is None else k_ratios
    labels = [c for c in ("split", "seen") if c in scores.columns]
    pairs = F.array(
        *[
            F.struct(F.lit(k_percent(r)).alias("k"), F.col(min_k_name(r)).alias("score"))
            for r in k_ratios
        ]
    )
    return scores.select(*SAMPLE, *labels, F.inline(pairs))


def last_content_token(
    items: DataFrame, vectors: DataFrame | None = None, dim: int = word_vectors.DIM
) -> DataFrame:
    """Position and text of each sample's last word that is not special, or of its last word
    if all are special; found within the row. Samples without words are left out.

    With the ``vectors`` of ``word_vectors.fit``, of dimension ``dim``, also that word's
    ``vector``: zeros for a word that the model has not met after another one.
    """
    places = F.sequence(F.lit(0), F.size("_words") - 1)
    content = F.filter(places, lambda i: ~is_special(F.get("_words", i)))
    last = F.coalesce(F.get(content, F.size(content) - 1), F.size("_words") - 1)
    listed = items.select(*SAMPLE, words(F.col("instruction_text")).alias("_words"))
    placed = listed.where(F.size("_words") > 0).withColumn("last_pos", last)
    found = placed.select(*SAMPLE, "last_pos", F.get("_words", F.col("last_pos")).alias("last_token"))
    return found if vectors is None else word_vectors.with_vectors(found, "last_token", vectors, dim)
