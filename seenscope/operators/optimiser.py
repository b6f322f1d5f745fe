"""Trajectories under an optimiser: a log-linear bigram model and Adam steps on one sample.

Words are hashed to 16 buckets. The model's parameters are the logits ``w(u, j)`` of the next
word's bucket ``j`` after a word of bucket ``u``:

    p(j | u) = exp(w(u, j)) / sum of exp(w(u, i)) over i

The start state is fitted to the pairs of the seen rows, where the likelihood has its maximum
in closed form (with one more pair of each kind). Each sample then takes a number of AdamW
steps on its own mean loss, always from the start state and with moments of zero. A step works
on each ``w`` alone, given the sample's size, so a sample's state is one row per bucket ``u``
with arrays of logits and moments; only loss and gradient norm are sums over these rows. The
embedding is the row of logits at the sample's last content word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seenscope.functions.words import words
from seenscope.operators.language_model import SAMPLE, START
from seenscope.operators.scores import last_content_token
from seenscope.operators.trajectory import NUM_STEPS
from seenscope.plans.materialize import materialize

BUCKETS = 16
# The optimiser's usual settings, but for a rate that suits logits.
RATE = 0.1
BETAS = (0.9, 0.999)
EPSILON = 1e-8
DECAY = 0.01


def bucket(word: str | Column) -> Column:
    """One hex digit of the word's md5."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(word), 1, 1)) - 1


def _counts(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Per key the ``value`` of each second bucket ``j``, as the array ``n``."""
    return rows.groupBy(*keys).agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("j") == i, value)), F.lit(0)).cast("double") for i in range(BUCKETS)]).alias("n")
    )


def start_state(pairs: DataFrame) -> DataFrame:
    """``(u, w)``: the logits of every first bucket, from fitted pairs; 16 rows, written."""
    inner = pairs.where(F.col("prev") != START).select(bucket("prev").alias("u"), bucket("tok").alias("j"), "c_pair")
    return _start(inner)


def fitted_state(items: DataFrame) -> DataFrame:
    """The same from the places of the rows marked seen; only counts per pair of buckets are
    shuffled, so no distinct word pair is counted."""
    return _start(_bucket_pairs(items.where("seen")).groupBy("u", "j").agg(F.count("*").alias("c_pair")))


def _start(inner: DataFrame) -> DataFrame:
    counts = _counts(inner, ["u"], F.col("c_pair"))
    every = inner.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("u"))
    n = F.coalesce("n", F.array_repeat(F.lit(0.0), BUCKETS))
    known = every.join(counts, "u", "left").select("u", n.alias("n"))
    total = F.aggregate("n", F.lit(0.0), lambda s, x: s + x) + F.lit(float(BUCKETS))
    w = F.zip_with("n", F.array_repeat(total, BUCKETS), lambda x, t: F.log((x + 1.0) / t))
    return materialize(known.select("u", w.alias("w")), "start-state")


def _bucket_pairs(items: DataFrame) -> DataFrame:
    """``(u, j)`` of every place that follows a word; a word's bucket is found once for both."""
    digit = F.transform(words(F.col("instruction_text")), lambda w: bucket(w))
    listed = items.select(*SAMPLE, digit.alias("_b")).where(F.size("_b") > 1)
    size = F.size("_b") - 1
    pairs = F.arrays_zip(F.slice("_b", F.lit(1), size).alias("u"), F.slice("_b", F.lit(2), size).alias("j"))
    return listed.select(*SAMPLE, F.inline(pairs))


def _rows(items: DataFrame) -> DataFrame:
    """Per sample and first bucket: counts ``n``, whether it is that of the last content word,
    and the sample's number of pairs. Samples of fewer than two words have none."""
    pairs = _bucket_pairs(items)
    last = materialize(last_content_token(items), "last-words").select(
        *SAMPLE, bucket("last_token").alias("u"), F.lit(None).cast("int").alias("j")
    )
    both = pairs.withColumn("last", F.lit(False)).unionByName(last.withColumn("last", F.lit(True)))
    counts = both.groupBy(*SAMPLE, "u").agg(
        F.array(*[F.count_if(F.col("j") == i).cast("double") for i in range(BUCKETS)]).alias("n"),
        F.count("j").cast("double").alias("n_u"),
        F.bool_or("last").alias("last"),
    )
    return counts.withColumn("size", F.sum("n_u").over(Window.partitionBy(*SAMPLE))).where("size > 0")


def _same(value: Column) -> Column:
    """The value for every bucket, found once."""
    return F.array_repeat(value, BUCKETS)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def trajectory(
    items: DataFrame,
    start: DataFrame,
    num_steps: int = NUM_STEPS,
    rate: float = RATE,
    decay: float = DECAY,
) -> DataFrame:
    """Rows ``(sample, step)`` like those of ``trajectory.trajectory``: the embedding after
    ``step`` updates, loss and gradient norm just before the last of them (none at step 0).

    ``start`` is a :func:`start_state`. Counts are shuffled by sample and bucket, then by
    sample; all steps are taken in between, within the rows. A null text has no rows.
    """
    first, second = BETAS
    rows = _rows(items).join(start, "u")
    rows = rows.withColumns({"m": _same(F.lit(0.0)), "v": _same(F.lit(0.0))})
    steps = [F.struct(F.lit(0).alias("step"), *[F.lit(None).cast("double").alias(x) for x in ("l", "g2")], F.col("w0").alias("w"))]
    rows = rows.withColumnRenamed("w", "w0")
    for s in range(1, num_steps + 1):
        w = F.col(f"w{s - 1}")
        rows = rows.withColumn("top", F.log(_total(F.transform(w, F.exp))))
        # ln p, and from it the gradient of the mean loss.
        rows = rows.withColumn("ln_p", F.zip_with(w, _same(F.col("top")), lambda x, t: x - t))
        wanted = F.zip_with("n", _same(F.col("n_u")), lambda x, n: F.struct(x.alias("x"), n.alias("n")))
        rest = F.zip_with("ln_p", wanted, lambda p, c: c["n"] * F.exp(p) - c["x"])
        rows = rows.withColumn("g", F.zip_with(rest, _same(F.col("size")), lambda x, n: x / n))
        rows = rows.withColumns(
            {
                f"l{s}": -_total(F.zip_with("n", "ln_p", lambda n, p: n * p)),
                f"g{s}": _total(F.transform("g", lambda g: g * g)),
                "m": F.zip_with("m", "g", lambda m, g: m * first + g * (1 - first)),
                "v": F.zip_with("v", "g", lambda v, g: v * second + g * g * (1 - second)),
            }
        )
        even, spread = 1 - first**s, 1 - second**s
        move = F.zip_with("m", "v", lambda m, v: m / even / (F.sqrt(v / spread) + EPSILON))  # noqa: B023
        rows = rows.withColumn(f"w{s}", F.zip_with(w, move, lambda x, d: x * (1 - rate * decay) - d * rate))
        steps.append(F.struct(F.lit(s).alias("step"), F.col(f"l{s}").alias("l"), F.col(f"g{s}").alias("g2"), F.col(f"w{s}").alias("w")))
    spread_out = rows.select(*SAMPLE, "size", "last", F.inline(F.array(*steps)))
    return spread_out.groupBy(*SAMPLE, "step").agg(
        F.max(F.when(F.col("last"), F.col("w"))).alias("embedding"),
        (F.sum("l") / F.max("size")).alias("loss"),
        F.sqrt(F.sum("g2")).alias("grad_norm"),
    )
