"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Features are character n-grams of one to three code points, lower case, with everything that
is not a letter read as a word boundary; they are hashed into a fixed number of buckets and
weighted by ``(1 + ln tf) * idf`` with unit length. Document frequencies cover all training
documents. The weights are learned by follow-the-regularised-leader with elastic-net
penalties on a sample of at most about ``SAMPLE`` labelled training documents: shards of the
sample are trained apart, in a fixed order, and averaged. One part of the sample is held back
to fit a temperature, by which the class probabilities are calibrated.

Only counts per bucket, weights and the class scores of the calibration documents reach the
driver; all are bounded by the number of buckets, classes and ``SAMPLE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.llm.words import mix, pieces, reachable, text_bytes
from seenscope.plans.materialize import materialize

UNKNOWN = "und"
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SAMPLE = 4096
SHARDS = 8
CALIBRATION = 5  # one in so many sampled documents is used for the temperature only
EPOCHS = 3
# Follow the regularised leader: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
CHUNK_BYTES = 1 << 19
_SALTS = mix(np.arange(1, 1 + 3, dtype=np.uint64))  # one per n-gram length


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case code point, and whether it is a letter."""
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, bool)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            letter[c] = True
            y = x.lower()
            if len(y) == 1:
                lower[c] = ord(y)
    return lower, letter


@dataclass
class Features:
    """Sparse rows of some texts: ``doc``, ``bucket`` and ``tf`` of each entry, by document."""

    first: int
    n_docs: int
    has_letter: np.ndarray
    doc: np.ndarray
    bucket: np.ndarray
    tf: np.ndarray


def features(texts: pa.Array) -> Iterator[Features]:
    lower, letter = _letters()
    data, offsets = text_bytes(texts)
    for first, last in pieces(offsets, CHUNK_BYTES):
        n = last - first
        raw = data[offsets[first] : offsets[last]]
        # Code points begin at bytes that do not continue another.
        begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ends = begins[offsets[first + 1 : last + 1] - offsets[first]]
        code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        is_letter = letter[code]
        doc = np.repeat(np.arange(n), np.diff(ends, prepend=0))
        has = np.bincount(doc[is_letter], minlength=n) > 0
        # A boundary before the first and after the last letter of every text.
        x = np.zeros(len(code) + 2, np.uint64)
        x[1:-1] = np.where(is_letter, lower[code], np.uint32(0))
        keys = []
        here, before, after = x[1:-1], x[:-2].copy(), x[2:].copy()
        starts = np.concatenate([[0], ends[:-1]])
        starts = starts[starts < ends]
        before[starts] = 0
        after[ends[ends > 0] - 1] = 0
        shift = np.uint64(BUCKET_BITS)
        at = doc.astype(np.uint64) << shift
        for gram in (here, here | before << np.uint64(21), here | after << np.uint64(21) | before << np.uint64(42)):
            top = mix(gram[is_letter] + _SALTS[len(keys)])
            keys.append(at[is_letter] | top >> (np.uint64(64) - shift))
        key = np.sort(np.concatenate(keys))
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        tf = np.diff(np.append(begin, len(key)))
        key = key[begin]
        yield Features(first, n, has, (key >> shift).astype(np.int64), (key & np.uint64(BUCKETS - 1)).astype(np.int64), tf)


def tf_idf(found: Features, idf: np.ndarray) -> np.ndarray:
    """The value of each entry; rows have unit length."""
    value = (1 + np.log(found.tf)) * idf[found.bucket]
    norm = np.sqrt(np.bincount(found.doc, value * value, found.n_docs))
    return value / np.maximum(norm[found.doc], 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket x language
    temperature: float = 1.0

    def scores(self, found: Features) -> np.ndarray:
        """Uncalibrated class scores, document x language."""
        value = tf_idf(found, self.idf)
        columns = [
            np.bincount(found.doc, value * self.weights[found.bucket, c], found.n_docs)
            for c in range(len(self.languages))
        ]
        return np.stack(columns, 1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Per-coordinate FTRL-proximal for the multinomial log loss; rows are
    ``(buckets, values, class)``, taken in order."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def leader(z, n):
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    for _ in range(epochs):
        for buckets, values, label in rows:
            w = leader(z[buckets], n[buckets])
            p = softmax(values @ w)
            p[label] -= 1
            g = values[:, None] * p
            squared = n[buckets] + g * g
            z[buckets] += g - (np.sqrt(squared) - np.sqrt(n[buckets])) / ALPHA * w
            n[buckets] = squared
    return leader(z, n)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the smallest log loss, by golden-section search."""
    if not len(labels):
        return 1.0

    def loss(log_t):
        p = softmax(scores / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean()

    a, b, ratio = np.log(0.01), np.log(100.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(key: str = "doc_id") -> Column:
    """Is the document kept out of training? A row without an id is."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def train(
    docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", sample: int = SAMPLE
) -> Model:
    """Learn from rows that are not held out and have a label; null texts count as empty.

    Without such rows the model knows no language and every prediction is unknown.
    """
    spark = docs.sparkSession
    reachable(spark)
    rows = docs.where(~held_out(key) & F.col(label).isNotNull()).select(
        F.xxhash64(F.col(key).cast("string")).alias("order"), F.col(label).cast("string").alias("lang"), F.col(text).alias("text")
    )

    def frequencies(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        counts: dict[str, int] = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)):
                counts[x["values"].as_py()] = counts.get(x["values"].as_py(), 0) + x["counts"].as_py()
            for found in features(batch.column(1)):
                df += np.bincount(found.bucket, minlength=BUCKETS)
        hit = np.flatnonzero(df)
        bucket = [*hit.tolist(), *[-1] * len(counts)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bucket, pa.int32()),
                pa.array([None] * len(hit) + list(counts), pa.string()),
                pa.array([*df[hit].tolist(), *counts.values()], pa.int64()),
            ],
            ["bucket", "lang", "n"],
        )

    counted = (
        rows.select("lang", "text")
        .mapInArrow(frequencies, "bucket INT, lang STRING, n LONG")
        .groupBy("bucket", "lang")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    of_language = counted[counted["bucket"] < 0].sort_values("lang")
    languages, total = of_language["lang"].tolist(), int(of_language["n"].sum())
    df = np.zeros(BUCKETS)
    of_bucket = counted[counted["bucket"] >= 0]
    df[of_bucket["bucket"].to_numpy(int)] = of_bucket["n"].to_numpy(float)
    idf = np.log((1 + total) / (1 + df)) + 1
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0)))

    def sparse(batches):
        for batch in batches:
            for found in features(batch.column(2)):
                value = tf_idf(found, idf).astype(np.float32)
                at = pa.array(np.searchsorted(found.doc, np.arange(found.n_docs + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(found.first, found.n_docs),
                        batch.column(1).slice(found.first, found.n_docs),
                        pa.ListArray.from_arrays(at, pa.array(found.bucket.astype(np.int32))),
                        pa.ListArray.from_arrays(at, pa.array(value)),
                    ],
                    ["order", "lang", "buckets", "values"],
                )

    share = int(min(1.0, sample / total) * (1 << 32))
    chosen = rows.where(F.pmod("order", F.lit(1 << 32)) < share)
    found = chosen.mapInArrow(sparse, "order LONG, lang STRING, buckets ARRAY<INT>, values ARRAY<FLOAT>")
    # The sample is bounded, so a fixed number of files holds it.
    sampled = materialize(found.repartition(SHARDS), "language-sample")
    part = F.pmod(F.shiftright("order", 32), F.lit(CALIBRATION * SHARDS))
    sampled = sampled.withColumn("part", part.cast("int"))
    number = {x: i for i, x in enumerate(languages)}

    def fit(table):
        table = table.sort_by([("order", "ascending"), ("lang", "ascending")])
        data = [
            (np.array(b, np.int64), np.array(v, float), number[x])
            for b, v, x in zip(*(table.column(c).to_pylist() for c in ("buckets", "values", "lang")), strict=True)
        ]
        w = ftrl(data, len(languages))
        at, of = np.nonzero(w)
        columns = [pa.array(at.astype(np.int32)), pa.array(of.astype(np.int32)), pa.array(w[at, of])]
        return pa.Table.from_arrays(columns, ["bucket", "class", "w"])

    fitted = (
        sampled.where(f"part % {CALIBRATION} > 0")
        .withColumn("shard", F.floor(F.col("part") / CALIBRATION))
        .groupBy("shard")
        .applyInArrow(fit, "bucket INT, class INT, w DOUBLE")
        .groupBy("bucket", "class")
        .agg((F.sum("w") / SHARDS).alias("w"))
        .toPandas()
    )
    weights = np.zeros((BUCKETS, len(languages)))
    weights[fitted["bucket"].to_numpy(int), fitted["class"].to_numpy(int)] = fitted["w"]
    model = Model(languages, idf, weights)

    def score(batches):
        for batch in batches:
            out = []
            for b, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out.append((np.array(v, float) @ weights[np.array(b, np.int64)]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["lang", "scores"])

    kept_back = sampled.where(f"part % {CALIBRATION} = 0").select("lang", "buckets", "values")
    scored = kept_back.mapInArrow(score, "lang STRING, scores ARRAY<DOUBLE>").toPandas()
    if len(scored):
        labels = np.array([number[x] for x in scored["lang"]])
        model.temperature = temperature(np.array(scored["scores"].tolist()), labels)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and the calibrated probability ``score`` of that language.

    A text that is null or has no letter is unknown, with score 0. Columns of these names are
    replaced; nothing but the text is read.
    """
    reachable(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches):
        fitted = held.value
        names = np.array(fitted.languages or [UNKNOWN], object)
        for batch in batches:
            best, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            for found in features(batch.column(at)) if fitted.languages else ():
                p = softmax(fitted.scores(found) / fitted.temperature)
                rows = slice(found.first, found.first + found.n_docs)
                best[rows] = np.where(found.has_letter, names[p.argmax(axis=1)], UNKNOWN)
                score[rows] = np.where(found.has_letter, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), pa.array(score)], names=schema.names
            )

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs(doc_id, text, lang)``."""
    model = train(docs)
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
