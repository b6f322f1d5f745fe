"""A word model of order three with interpolated Kneser-Ney back-off.

    p(t | s, u) = max(c(s, u, t) - D, 0) / c(s, u) + D * k(s, u) / c(s, u) * p(t | u)
    p(t | u)    = max(k(u, t) - D, 0) / c'(u)      + D * k(u) / c'(u)      * p(t)
    p(t)        = max(k(t) - D, 0) / c'            + D * V / c'            / (V + 1)

``c`` counts on seen rows, ``k`` counts different words: ``k(s, u)`` after the pair, ``k(u, t)``
and ``k(t)`` before them, ``k(u)`` after ``u``; ``c'`` are sums of those before. ``V`` are the
model's words, and all unknown words together are one more. A context that the model has not
met leaves the shorter one's probability. Words before the first one are empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seenscope.functions.words import words
from seenscope.operators import places
from seenscope.operators.language_model import SAMPLE, START
from seenscope.plans.joins import lookup_join
from seenscope.plans.materialize import materialize

# Fixed value: what is taken from each count.
DISCOUNT = 0.75
GRAM = ["prev2", "prev", "tok"]


def word_triples(items: DataFrame, max_length: int | None = None) -> DataFrame:
    """One row per word: its 0-based ``pos``, the two words before it and the word."""
    listed = items.select(*SAMPLE, words(F.col("instruction_text"), max_length).alias("tok"))
    shifted = listed.withColumns(
        {
            "prev": F.concat(F.array(F.lit(START)), F.col("tok")),
            "prev2": F.concat(F.array(F.lit(START), F.lit(START)), F.col("tok")),
        }
    )
    rows = shifted.select(*SAMPLE, F.posexplode(F.arrays_zip(*GRAM)).alias("pos", "gram"))
    # The shifted arrays are longer than tok.
    return rows.select(*SAMPLE, "pos", *[f"gram.{c}" for c in GRAM]).where("tok IS NOT NULL")


@dataclass(frozen=True)
class Model:
    """Counts of the seen rows, written: of triples, and of what comes before and after.

    ``n_pairs`` and ``n_words`` are the numbers of different pairs and words.
    """

    triples: DataFrame
    pairs: DataFrame
    unigrams: DataFrame
    contexts: DataFrame
    short_contexts: DataFrame
    n_pairs: int
    n_words: int


def fit(items: DataFrame, max_length: int | None = None) -> Model:
    """The model of the rows marked seen."""
    triples = materialize(
        word_triples(items.where("seen"), max_length).groupBy(*GRAM).agg(F.count("*").alias("c")), "triples"
    )
    pairs = materialize(triples.groupBy("prev", "tok").agg(F.count("*").alias("k")), "pairs")
    unigrams = materialize(pairs.groupBy("tok").agg(F.count("*").alias("k")), "unigrams")
    contexts = triples.groupBy("prev2", "prev").agg(F.sum("c").alias("c_context"), F.count("*").alias("k_context"))
    short = pairs.groupBy("prev").agg(F.sum("k").alias("c_context"), F.count("*").alias("k_context"))
    n_pairs, n_words = unigrams.agg(F.coalesce(F.sum("k"), F.lit(0)), F.count("*")).first()
    return Model(
        triples, pairs, unigrams, materialize(contexts, "contexts"), materialize(short, "contexts"), n_pairs, n_words
    )


def _interpolated(count: Column, lower: Column, discount: float) -> Column:
    """The probability from a count in its context and the shorter context's probability."""
    total = F.col("c_context").cast("double")
    own = F.greatest(F.coalesce(count, F.lit(0)) - F.lit(discount), F.lit(0.0)) / total
    return F.when(total > 0, own + F.lit(discount) * F.col("k_context") / total * lower).otherwise(lower)


def lookup(
    items: DataFrame, model: Model, max_length: int | None = None, discount: float = DISCOUNT
) -> DataFrame:
    """What the model says about the triples of any items: one row per distinct triple with
    its ``logprob`` and the number of places that ``uses`` it, written.

    Probabilities are found from the shortest context up, once per distinct word, pair and
    triple; each longer one takes its shorter one by a join that spreads hot keys.
    """
    wanted = materialize(
        word_triples(items, max_length).groupBy(*GRAM).agg(F.count("*").alias("uses")), "wanted-triples"
    )
    wanted_pairs = materialize(wanted.groupBy("prev", "tok").agg(F.count("*").alias("uses")), "wanted-pairs")

    def needed(rows: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
        return materialize(rows.groupBy(*keys).agg(F.count("*").alias("uses")).join(found, keys, "left"), "wanted")

    spread = discount * model.n_words / (model.n_words + 1)
    lowest = F.lit(1.0)
    if model.n_pairs:
        lowest = (F.greatest(F.coalesce("k", F.lit(0)) - F.lit(discount), F.lit(0.0)) + F.lit(spread)) / F.lit(model.n_pairs)
    words = needed(wanted_pairs, ["tok"], model.unigrams)
    words = words.select("tok", lowest.cast("double").alias("p"), "uses")
    pairs = wanted_pairs.join(model.pairs, ["prev", "tok"], "left")
    pairs = lookup_join(pairs, needed(wanted_pairs, ["prev"], model.short_contexts), ["prev"])
    pairs = lookup_join(pairs, words, ["tok"]).select(
        "prev", "tok", _interpolated(F.col("k"), F.col("p"), discount).alias("p"), "uses"
    )
    pairs = materialize(pairs, "pair-probabilities")
    triples = wanted.join(model.triples, GRAM, "left")
    triples = lookup_join(triples, needed(wanted, ["prev2", "prev"], model.contexts), ["prev2", "prev"])
    triples = lookup_join(triples, pairs, ["prev", "tok"]).select(
        *GRAM, F.log(_interpolated(F.col("c"), F.col("p"), discount)).alias("logprob"), "uses"
    )
    return materialize(triples, "triple-probabilities")


def token_logprobs(items: DataFrame, found: DataFrame, max_length: int | None = None) -> DataFrame:
    """Log-probability of each word but the first of each sample; ``found`` is a
    :func:`lookup` of these items."""
    following = word_triples(items, max_length).where("pos > 0")
    return lookup_join(following, found, GRAM).select(*SAMPLE, "pos", F.col("tok").alias("token"), "logprob")


def sample_logprobs(items: DataFrame, found: DataFrame, max_length: int | None = None) -> DataFrame:
    """Distinct triples of each sample with log-probability and count ``n``, which is what
    scores need."""
    following = word_triples(items, max_length).where("pos > 0")
    counted = following.groupBy(*SAMPLE, *GRAM).agg(F.count("*").alias("n"))
    return lookup_join(counted, found, GRAM).select(*SAMPLE, "logprob", "n")


def _word_model(triples: DataFrame) -> DataFrame:
    """Per word: different words before it (``k``), and as a context the sum of these of the
    words after it (``c_short``) and the number of words after it (``k_short``); written."""
    pairs = triples.repartition("prev", "tok").groupBy("prev", "tok").agg(F.count_distinct("prev2").alias("k"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def part(word: str, k: Column, c_short: Column, k_short: Column) -> Column:
        return F.struct(F.col(word).alias("tok"), k.alias("k"), c_short.alias("c_short"), k_short.alias("k_short"))

    parts = F.array(part("tok", one, zero, zero), part("prev", zero, F.col("k"), one))
    sums = [F.sum(x).alias(x) for x in ("k", "c_short", "k_short")]
    return materialize(pairs.select(F.inline(parts)).groupBy("tok").agg(*sums), "word-model")


def place_logprobs(items: DataFrame, fitted: Column, discount: float = DISCOUNT) -> DataFrame:
    """``token_logprobs(items, lookup(items, fit(items)))`` with ``n`` of 1, for a model of the
    ``fitted`` ones among the items, from two shuffles of places as in
    :mod:`seenscope.operators.places`; dealt by sample.

    Where places are dealt by their word, those of a pair and of a triple meet, and as each
    place knows the next word, a pair's counts as a context are found there, too. A place takes
    the counts of its contexts from the place before.
    """
    repeated = places.has_repeated(items)
    row = [*places.BY_SAMPLE, "_copy"] if repeated else places.BY_SAMPLE
    listed = places.listed_words(items, repeated, fitted, None, None)
    start = F.array(F.lit(START))
    grams = listed.withColumns(
        {
            "prev": F.concat(start, F.col("tok")),
            "prev2": F.concat(start, start, F.col("tok")),
            "next": F.slice("tok", 2, F.greatest(F.size("tok"), F.lit(1))),
        }
    )
    rows = grams.select(*row, "_fitted", F.posexplode(F.arrays_zip(*GRAM, "next")).alias("pos", "gram"))
    rows = rows.select(*row, "_fitted", "pos", *[f"gram.{c}" for c in (*GRAM, "next")]).where("tok IS NOT NULL")
    counts = places.word_counts(listed)
    known = _word_model(rows.where("_fitted").select(*GRAM))
    n_pairs, n_words = known.agg(F.coalesce(F.sum("k"), F.lit(0)), F.count_if(F.col("k") > 0)).first()
    total = counts.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    salts = places.hot_words(counts, total)
    salt = F.pmod(F.xxhash64("prev"), F.coalesce("_salts", F.lit(1)))
    by_word = (
        rows.join(salts, "tok", "left")
        .withColumn("_word", places.salted(salt))
        .withColumn("_place", F.col("pos").cast("long") * 2 + F.col("_fitted").cast("long"))
        .select(*row, "_place", "prev2", "prev", "next", "_word")
        .repartition("_word")
        .withColumn("_own", F.col("_place") % 2)
    )
    pair = Window.partitionBy("_word", "prev")
    triple, follower = Window.partitionBy("_word", "prev", "prev2"), Window.partitionBy("_word", "prev", "next")

    def different(group) -> Column:
        """One row of each group that has a fitted place."""
        first = F.row_number().over(group.orderBy("_own")) == 1
        return (first & (F.sum("_own").over(group) > 0)).cast("long")

    found = by_word.withColumns({"c": F.sum("_own").over(triple), "_triple": different(triple)})
    inside = F.when(F.col("next").isNotNull(), F.col("_own")).otherwise(F.lit(0))
    found = found.withColumns({"k_pair": F.sum("_triple").over(pair), "_c": F.sum(inside).over(pair)})
    found = found.withColumn("_follower", F.when(F.col("next").isNotNull(), different(follower)).otherwise(F.lit(0)))
    found = found.withColumn("_k", F.sum("_follower").over(pair))
    values = ["k", "c_short", "k_short"]
    every = counts.select("tok", "uses").join(known, "tok", "left").na.fill(0, values)
    joined = found.join(places.by_salt(every, salts, *values), "_word").select(
        *row, F.shiftright("_place", 1).cast("int").alias("pos"), F.substring_index("_word", " ", 1).alias("token"),
        "c", "k_pair", "_c", "_k", *values,
    )
    order = Window.partitionBy(*row).orderBy("pos")
    placed = joined.repartition(*SAMPLE).withColumns(
        {f"{x}_before": F.lag(x).over(order) for x in ("_c", "_k", "c_short", "k_short")}
    )
    spread = discount * n_words / (n_words + 1)
    lowest = F.lit(1.0)
    if n_pairs:
        lowest = (F.greatest(F.col("k") - F.lit(discount), F.lit(0.0)) + F.lit(spread)) / F.lit(n_pairs)

    def within(df: DataFrame, context: str, followers: str) -> DataFrame:
        return df.withColumns({"c_context": F.col(context), "k_context": F.col(followers)})

    placed = within(placed.where("pos > 0").withColumn("p", lowest.cast("double")), "c_short_before", "k_short_before")
    placed = placed.withColumn("p", _interpolated(F.col("k_pair"), F.col("p"), discount))
    placed = within(placed, "_c_before", "_k_before")
    logprob = F.log(_interpolated(F.col("c"), F.col("p"), discount))
    return placed.select(*SAMPLE, "pos", "token", logprob.alias("logprob"), F.lit(1).cast("long").alias("n"))
