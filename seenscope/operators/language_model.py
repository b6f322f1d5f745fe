"""A bigram language model fitted on the seen rows, and word log-probabilities.

Everything starts from *word pairs*: each word with the word before it. The first word of
a sample follows the empty word.

    base(t)   = (c(t) + 1) / (N + V + 1)
    p(t | u)  = (c(u, t) + base(t)) / (c(u) + 1)

``c`` counts on seen rows, ``N`` words and ``V`` distinct words there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seenscope.functions.words import words
from seenscope.plans.joins import lookup_join
from seenscope.plans.materialize import materialize

SAMPLE = ["dataset_name", "id_num"]
START = ""


def word_pairs(items: DataFrame, max_length: int | None = None, keep: tuple = ()) -> DataFrame:
    """One row per word: its 0-based ``pos``, the word before it (``prev``) and the word."""
    listed = items.select(*SAMPLE, *keep, words(F.col("instruction_text"), max_length).alias("tok"))
    shifted = listed.withColumn("prev", F.concat(F.array(F.lit(START)), F.col("tok")))
    pairs = shifted.select(
        *SAMPLE, *keep, F.posexplode(F.arrays_zip("prev", "tok")).alias("pos", "pair")
    )
    # prev has one entry more than tok.
    return pairs.select(*SAMPLE, *keep, "pos", "pair.prev", "pair.tok").where("tok IS NOT NULL")


def sample_cells(items: DataFrame, max_length: int | None = None) -> DataFrame:
    """Counts per sample and word pair, with the count of the pair's first word in that
    sample (``n_prev``).

    All pairs of a sample come from one row, so they are counted on the map side; only cells
    are shuffled.
    """
    pairs = word_pairs(items, max_length).where("pos > 0")
    cells = pairs.groupBy(*SAMPLE, "prev", "tok").agg(F.count("*").alias("n"))
    return cells.withColumn("n_prev", F.sum("n").over(Window.partitionBy(*SAMPLE, "prev")))


@dataclass(frozen=True)
class Model:
    """Counts on the seen rows: of word pairs, of first words as contexts, and of words.

    The tables are written and hold nothing of other rows. ``mass`` is N + V + 1, which is
    the reciprocal of an unknown word's share.
    """

    pairs: DataFrame
    contexts: DataFrame
    unigrams: DataFrame
    mass: int


def fit(items: DataFrame, max_length: int | None = None) -> Model:
    """The model of the rows marked seen."""
    pairs = materialize(
        word_pairs(items.where("seen"), max_length)
        .groupBy("prev", "tok")
        .agg(F.count("*").alias("c_pair")),
        "pairs",
    )
    contexts = pairs.groupBy("prev").agg(F.sum("c_pair").alias("c_prev"))
    unigrams = materialize(pairs.groupBy("tok").agg(F.sum("c_pair").alias("c_tok")), "unigrams")
    mass = unigrams.agg(F.coalesce(F.sum("c_tok"), F.lit(0)) + F.count("*") + 1).first()[0]
    return Model(pairs, materialize(contexts, "contexts"), unigrams, mass)


def lookup(items: DataFrame, model: Model, max_length: int | None = None) -> DataFrame:
    """What the model says about the word pairs of any items: one row per distinct pair.

    A pair, context or word that the model has not met has count 0. ``uses`` is the number of
    places in the items that will look the pair up, so they need one join instead of three.
    """
    wanted = materialize(
        word_pairs(items, max_length).groupBy("prev", "tok").agg(F.count("*").alias("uses")),
        "wanted-pairs",
    )
    counted = wanted.join(model.pairs, ["prev", "tok"], "left").na.fill(0, ["c_pair"])
    contexts, unigrams = _shared(counted)
    contexts = contexts.join(model.contexts, "prev", "left")
    unigrams = unigrams.join(model.unigrams, "tok", "left")
    return _found(counted, contexts, unigrams, F.lit(model.mass))


def _shared(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First words and words that distinct pairs share; ``uses`` tells which are hot."""
    return (
        counted.groupBy("prev").agg(F.count("*").alias("uses")),
        counted.groupBy("tok").agg(F.count("*").alias("uses")),
    )


def _found(counted: DataFrame, contexts: DataFrame, unigrams: DataFrame, mass: Column) -> DataFrame:
    contexts, unigrams = materialize(contexts, "wanted-contexts"), materialize(unigrams, "wanted-words")
    joined = lookup_join(lookup_join(counted, contexts, ["prev"]), unigrams, ["tok"])
    known = joined.na.fill(0, ["c_prev", "c_tok"])
    return materialize(known.withColumn("base", (F.col("c_tok") + F.lit(1.0)) / mass), "lookup")


def probability(extra_pair: Column | None = None, extra_prev: Column | None = None) -> Column:
    """p(tok | prev), with extra counts of the pair and of its first word if given."""
    pair, prev = F.col("c_pair") + F.col("base"), F.col("c_prev") + F.lit(1.0)
    if extra_pair is not None:
        pair, prev = pair + extra_pair, prev + extra_prev
    return pair / prev


def fitted_pairs(model: Model) -> DataFrame:
    """The pairs of the seen rows with all counts."""
    contexts = model.contexts.withColumn("uses", F.col("c_prev"))
    unigrams = model.unigrams.withColumn("uses", F.col("c_tok"))
    joined = lookup_join(lookup_join(model.pairs, contexts, ["prev"]), unigrams, ["tok"])
    return joined.select("prev", "tok", "c_pair", "c_prev", "c_tok")


def _pair_logprobs(found: DataFrame) -> DataFrame:
    # One value per pair travels through the join instead of its counts.
    return found.select("prev", "tok", "uses", F.log(probability()).alias("logprob"))


def token_logprobs(
    items: DataFrame, found: DataFrame, max_length: int | None = None
) -> DataFrame:
    """Log-probability of each word but the first of each sample; ``found`` is a
    :func:`lookup` of these items."""
    following = word_pairs(items, max_length).where("pos > 0")
    return lookup_join(following, _pair_logprobs(found), ["prev", "tok"]).select(
        *SAMPLE, "pos", F.col("tok").alias("token"), "logprob"
    )


def sample_logprobs(
    items: DataFrame, found: DataFrame, max_length: int | None = None
) -> DataFrame:
    """The pairs of each sample with log-probability and count ``n``, which is what scores
    need. Every place is looked up, so pairs are shuffled once by pair and once by sample;
    equal values of a sample are merged after that."""
    pairs = word_pairs(items, max_length).where("pos > 0")
    joined = lookup_join(pairs, _pair_logprobs(found), ["prev", "tok"])
    return joined.select(*SAMPLE, "logprob", F.lit(1).cast("long").alias("n"))


def model_cells(items: DataFrame, found: DataFrame, max_length: int | None = None) -> DataFrame:
    """Cells with the model's counts."""
    counts = found.select("prev", "tok", "uses", "c_pair", "c_prev", "base")
    return lookup_join(sample_cells(items, max_length), counts, ["prev", "tok"])
