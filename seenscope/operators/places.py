"""Every word of the samples with what the model says about it, from one shuffle by word and
one by sample.

The bigram model (:mod:`seenscope.operators.language_model`) needs three counts for a place:
of the pair, of its word, and of the word before as a context. Places are dealt by their word.
There, all places of a pair meet, so they are counted where they stand, and the word's own two
counts are joined without moving a place. Dealt by sample, a place then takes the context count
of the word before from the place before. So texts are split into places once for all
that follows, no table of pairs is written, and only counts travel back.

Places of a hot word are spread by the word before, so that the places of a pair stay
together; those of a hot pair, which is counted beforehand, are spread by sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seenscope.functions.words import words
from seenscope.operators.language_model import SAMPLE, START, probability
from seenscope.plans.joins import MAX_HOT_KEYS
from seenscope.plans.materialize import materialize

# A pair is hot if it holds more than 1/2,000 of the places, so fewer than 2,000 pairs are, and
# their words hold as many.
MAX_HOT_PAIRS = 2_000
# Places that one task splits and sorts where texts are dealt by sample.
TASK_PLACES = 1 << 20


# The number is what sorts a task's samples apart fastest.
BY_SAMPLE = SAMPLE[::-1]


def has_repeated(items: DataFrame) -> bool:
    """Do rows share a sample's key? If so, ``_copy`` tells them apart."""
    rows = items.groupBy(*SAMPLE).agg(F.count("*").alias("_rows"))
    return not rows.where("_rows > 1").isEmpty()


def listed_words(
    items: DataFrame, repeated: bool, fitted: Column, wanted: Column | None, max_length: int | None
) -> DataFrame:
    """Samples with their words, if any place of them is fitted or wanted."""
    marked = items.select(
        *SAMPLE,
        *([F.monotonically_increasing_id().alias("_copy")] if repeated else []),
        F.coalesce(fitted, F.lit(False)).alias("_fitted"),
        *([] if wanted is None else [F.coalesce(wanted, F.lit(False)).alias("_wanted")]),
        words(F.col("instruction_text"), max_length).alias("tok"),
    )
    return marked if wanted is None else marked.where("_fitted OR _wanted")


def _places(listed: DataFrame) -> DataFrame:
    shifted = listed.withColumn("prev", F.concat(F.array(F.lit(START)), F.col("tok")))
    rows = [c for c in listed.columns if c != "tok"]
    pairs = shifted.select(*rows, F.posexplode(F.arrays_zip("prev", "tok")).alias("pos", "pair"))
    # prev has one entry more than tok.
    return pairs.select(*rows, "pos", "pair.prev", "pair.tok").where("tok IS NOT NULL")


def word_counts(listed: DataFrame) -> DataFrame:
    """Per word: its places in fitted rows, those of them that end a text, and all places."""
    rows = listed.select("_fitted", F.size("tok").alias("_size"), F.posexplode("tok").alias("pos", "tok"))
    ends = F.col("_fitted") & (F.col("pos") == F.col("_size") - 1)
    counts = rows.groupBy("tok").agg(
        F.count_if("_fitted").alias("c_tok"), F.count_if(ends).alias("c_end"), F.count("*").alias("uses")
    )
    return materialize(counts, "word-counts")


def _hot_pairs(places: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Count on fitted rows of the pairs with more than 1/``MAX_HOT_PAIRS`` of the places.
    Their words have as many, so only pairs of such words are counted."""
    share = F.col("uses") * F.lit(MAX_HOT_PAIRS) > F.lit(total)
    often = F.broadcast(counts.where(share).select("tok"))
    found = places.select("_fitted", "prev", "tok").join(often, "tok", "left_semi")
    found = found.join(often.withColumnRenamed("tok", "prev"), "prev", "left_semi")
    pairs = found.groupBy("prev", "tok").agg(F.count_if("_fitted").alias("_c_hot"), F.count("*").alias("uses"))
    return materialize(pairs.where(share).drop("uses"), "hot-pairs")


def _with_cells(places: DataFrame, row: list[str]) -> DataFrame:
    """Add ``n``, the places of the pair in the sample at the first of them and 0 at others, and
    ``n_prev``, those of its first word as a context. The first place of a text has no pair."""
    cell, context = Window.partitionBy(*row, "prev", "tok"), Window.partitionBy(*row, "prev")
    first = (F.min("pos").over(cell) == F.col("pos")) & (F.col("pos") > 0)
    counted = places.withColumn("n", F.when(first, F.count("*").over(cell)).otherwise(F.lit(0)))
    return counted.withColumn("n_prev", F.count("*").over(context))


def hot_words(counts: DataFrame, total: int) -> DataFrame:
    """The words with more than 1/``MAX_HOT_KEYS`` of the places, with a salt for each such
    share; for a broadcast."""
    share = F.col("uses") * F.lit(MAX_HOT_KEYS) / F.lit(total)
    salts = counts.where(share > 1).select("tok", F.ceil(share).cast("int").alias("_salts"))
    return F.broadcast(materialize(salts, "hot-words"))


def by_salt(counts: DataFrame, salts: DataFrame, *values: str) -> DataFrame:
    """The row of each word, repeated for each salt of a hot one."""
    every = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    rows = counts.join(salts, "tok", "left").select("tok", *values, F.explode(every).alias("_salt"))
    return rows.select(salted(F.col("_salt")).alias("_word"), *values)


def salted(salt: Column) -> Column:
    """The word with its salt; words hold no blanks."""
    return F.when(salt > 0, F.concat_ws(" ", "tok", salt.cast("string"))).otherwise(F.col("tok"))


def place_counts(
    items: DataFrame,
    fitted: Column,
    wanted: Column | None = None,
    max_length: int | None = None,
    keep: tuple[Column, ...] = (),
    cells: bool = False,
) -> DataFrame:
    """One row per place but the first of each ``wanted`` sample, with ``c_pair``, ``c_prev`` and
    ``base`` from the ``fitted`` rows; dealt by sample, so what groups by it needs no shuffle.

    ``keep`` are columns of ``prev``, ``tok`` and ``pos`` to take along. With ``cells`` there is
    one row per distinct pair of a sample instead, with its count ``n`` and that of its first
    word, ``n_prev``.
    """
    repeated = has_repeated(items)
    row = [*BY_SAMPLE, "_copy"] if repeated else BY_SAMPLE
    listed = listed_words(items, repeated, fitted, wanted, max_length)
    counts = word_counts(listed)
    mass, total = counts.agg(
        F.coalesce(F.sum("c_tok"), F.lit(0)) + F.count_if(F.col("c_tok") > 0) + 1,
        F.coalesce(F.sum("uses"), F.lit(0)),
    ).first()
    hot_pairs = _hot_pairs(_places(listed), counts, total)

    if cells:
        tasks = max(items.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_PLACES))
        dealt = listed_words(items.repartition(tasks, *SAMPLE), repeated, fitted, wanted, max_length)
        places = _with_cells(_places(dealt), row)
    else:
        places = _places(listed)

    salts = hot_words(counts, total)
    number = F.coalesce("_salts", F.lit(1))
    hot_pairs = F.broadcast(hot_pairs)
    spread = F.when(F.col("_c_hot").isNull(), F.xxhash64("prev")).otherwise(F.xxhash64(*row))
    # Two columns fewer to shuffle: the salt is part of the word, and the label of the place.
    by_word = (
        places.join(hot_pairs, ["prev", "tok"], "left")
        .join(salts, "tok", "left")
        .withColumn("_word", salted(F.pmod(spread, number)))
        .withColumn("_place", F.col("pos").cast("long") * 2 + F.col("_fitted").cast("long"))
        .drop("_salts", "_c_hot", "_fitted", "pos", "tok")
        .repartition("_word")
        .withColumn("pos", F.shiftright("_place", 1).cast("int"))
        .withColumn("tok", F.substring_index("_word", " ", 1))
    )
    counted = F.sum(F.col("_place") % 2).over(Window.partitionBy("_word", "prev"))
    paired = by_word.withColumn("_counted", counted)
    if wanted is not None:
        paired = paired.where("_wanted")
    paired = paired.join(hot_pairs, ["prev", "tok"], "left").withColumn("c_pair", F.coalesce("_c_hot", "_counted"))
    joined = paired.join(by_salt(counts, salts, "c_tok", "c_end"), "_word")
    by_sample = joined.select(
        *row, F.col("pos").alias("_pos"), "c_pair", "c_tok", "c_end", *(("n", "n_prev") if cells else ()), *keep
    ).repartition(*SAMPLE)
    context = F.lag(F.col("c_tok") - F.col("c_end")).over(Window.partitionBy(*row).orderBy("_pos"))
    base = (F.col("c_tok") + F.lit(1.0)) / F.lit(mass)
    found = by_sample.withColumns({"c_prev": context, "base": base})
    found = found.where((F.col("n") > 0) if cells else (F.col("_pos") > 0))
    return found.drop("_copy", "_pos", "c_tok", "c_end")


def place_logprobs(found: DataFrame) -> DataFrame:
    """Log-probability of each place and its count ``n``, which is what scores need."""
    return found.select(*SAMPLE, F.log(probability()).alias("logprob"), F.lit(1).cast("long").alias("n"))
