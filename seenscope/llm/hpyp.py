"""Language-model scores from a hierarchical Pitman-Yor model, sampled by Gibbs.

Each context has a restaurant whose customers are the words that follow it; every table sends
one customer to the restaurant all contexts share, whose base is uniform over the known words
and one unknown. Contexts are the words with the largest counts, the beginning of a text, and
classes of all other words by a hash; so totals by context are small tables of fixed size,
while the counts of words within contexts grow with the corpus and stay distributed.

Words are dealt to buckets by hash; the number of buckets grows with the training tokens, so
that neither memory nor the result depends on how rows lie in files or on a setting of the
session. A bucket holds all contexts of its words and hence the
customers and tables of its words in the shared restaurant, too; a Gibbs sweep seats the
customers of every word in every context anew, given the totals of the contexts. In the first
pass buckets estimate the totals of the others from their own; it counts all training tokens
and yields totals and discounts. In the second, sweeps use those, and the predictive
probabilities of several samples are averaged. A word's customers in a context are seated
one after the other up to ``ONE_BY_ONE``, and then in stretches that grow with their number.

What is shuffled: first counts per (word, context) of a part of the texts, so hot words and
contexts arrive summed; then the occurrences of all but the frequent words, packed by part and
bucket, and sums per text back to the part. Frequent words, which are bounded in number, are
scored where the text is. Nothing that grows with the corpus reaches the driver.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.llm.words import Words, mix, reachable, split_words
from seenscope.plans.materialize import materialize

FREQUENT = 511  # words that are contexts of their own, the end token among them
CLASSES = 64  # of all other words as contexts
CONTEXTS = 1 + FREQUENT + CLASSES  # and the beginning of a text
BUCKET_TOKENS = 4 << 20  # training tokens per bucket, about
STRENGTH = 2.0  # of a context's restaurant
SHARED_STRENGTH = 10.0
FIRST_SWEEPS, BURN_IN, SAMPLES = 4, 2, 4
ONE_BY_ONE = 64
PART_BYTES = 4 << 20  # of text that is counted and sent together
HELD = 2_000_000  # counts that a task adds up before it sends them
STRETCH = 0.1
SEED = 11

_CONTEXT_BITS = np.uint64(10)
_CONTEXT_MASK = np.uint64((1 << 10) - 1)
END = int(mix(np.array([0x454E44], np.uint64))[0]) & ~1023


def training(key: str = "doc_id") -> Column:
    """Is the document learned from? A row without an id is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 != 1, F.lit(False))


def bundle(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for x in arrays:
        np.save(out, x, allow_pickle=False)
    raw = out.getvalue()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unbundle(data: bytes) -> list[np.ndarray]:
    size = int.from_bytes(data[:8], "little")
    source = io.BytesIO(pa.Codec("zstd").decompress(data[8:], size, asbytes=True))
    out = []
    while source.tell() < size:
        out.append(np.load(source, allow_pickle=False))
    return out


def planes(keys: np.ndarray) -> np.ndarray:
    """Differences of rising keys, by byte, which compresses well."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy()


def keys_of(found: np.ndarray) -> np.ndarray:
    return np.cumsum(found.T.copy().reshape(-1).view(np.uint64), dtype=np.uint64)


def tokens(words: Words, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``(word, doc)`` of all tokens in order, with an end token after each text. A word is
    its hash with room for a context in the lowest bits."""
    counts = words.counts
    at = np.cumsum(counts + 1) - 1  # of the end tokens
    word = np.empty(len(words.doc) + words.n_docs, np.uint64)
    doc = np.repeat(np.arange(words.n_docs), counts + 1)
    is_end = np.zeros(len(word), bool)
    is_end[at] = True
    word[~is_end] = words.hashes() & ~_CONTEXT_MASK
    word[is_end] = np.uint64(END)
    return word, doc


def contexts(word: np.ndarray, doc: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place in the frequent words or -1, context)`` of each token; ``frequent`` rises."""
    place = np.searchsorted(frequent, word)
    place[(place == len(frequent)) | (frequent[np.minimum(place, len(frequent) - 1)] != word)] = -1
    own = np.where(place >= 0, 1 + place, 1 + FREQUENT + ((word >> _CONTEXT_BITS) % np.uint64(CLASSES)).astype(np.int64))
    context = np.zeros(len(word), np.int64)
    context[1:] = np.where(doc[1:] == doc[:-1], own[:-1], 0)
    return place, context


def seat(rng: np.random.Generator, customers: np.ndarray, a: np.ndarray, d: float, order: np.ndarray | None = None) -> np.ndarray:
    """Tables of one dish after ``customers`` (1 or more) were seated one by one: a new table
    with weight ``a``, a known one with the number seated less ``d`` per table."""
    order = np.argsort(-customers, kind="stable") if order is None else order
    c, a = customers[order], a[order]
    t = np.ones(len(c))
    active = len(c)
    for i in range(1, ONE_BY_ONE):
        active = int(np.searchsorted(-c[:active], -i, "left"))  # those with more than i
        if not active:
            break
        new = rng.random(active) * (a[:active] + i - d * t[:active]) < a[:active]
        t[:active] += new
    large = int(np.searchsorted(-c, -ONE_BY_ONE, "left"))
    at = np.full(large, float(ONE_BY_ONE))
    while large and (at < c[:large]).any():
        step = np.minimum(np.ceil(at * STRETCH), c[:large] - at)
        p = a[:large] / (a[:large] + at + (step - 1) / 2 - d * t[:large])
        t[:large] += rng.binomial(step.astype(np.int64), np.clip(p, 0, 1))
        at += step
    out = np.empty(len(c))
    out[order] = t
    return out


@dataclass
class Totals:
    """What all buckets share: small, whatever the corpus."""

    n: float  # training tokens
    v: float  # distinct ones
    customers: np.ndarray  # by context
    tables: np.ndarray
    shared_customers: float
    shared_tables: float
    discount: float
    shared_discount: float

    @property
    def uniform(self) -> float:
        return 1 / (self.v + 1)

    @property
    def novelty(self) -> np.ndarray:
        """Weight of the shared restaurant in each context."""
        return (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers)

    def shared(self, customers: np.ndarray | float, tables: np.ndarray | float) -> np.ndarray | float:
        """Probability of words in the shared restaurant."""
        fresh = (SHARED_STRENGTH + self.shared_discount * self.shared_tables) * self.uniform
        return (customers - self.shared_discount * tables + fresh) / (SHARED_STRENGTH + self.shared_customers)

    def base(self, count: np.ndarray | float) -> np.ndarray | float:
        return np.log10((count + 0.5) / (self.n + 0.5 * (self.v + 1)))


def discount(once: float, twice: float) -> float:
    """From how many cells have one and two customers."""
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5


@dataclass
class Cells:
    """Training counts of a bucket: one cell per word and context, words in order."""

    key: np.ndarray
    count: np.ndarray
    word: np.ndarray  # distinct words
    of: np.ndarray  # place of each cell's word

    @staticmethod
    def make(key: np.ndarray, count: np.ndarray) -> Cells:
        word, of = np.unique(key & ~_CONTEXT_MASK, return_inverse=True)
        return Cells(key, count, word, of)

    @property
    def context(self) -> np.ndarray:
        return (self.key & _CONTEXT_MASK).astype(np.int64)

    def sweeps(self, n: int, rng: np.random.Generator, totals: Totals | None, share: float) -> Iterator[tuple]:
        """Tables per cell, and customers and tables per word in the shared restaurant, after
        each of ``n`` Gibbs sweeps. Without totals they are estimated: the bucket is taken for
        ``share`` of all."""
        context, order = self.context, np.argsort(-self.count, kind="stable")
        t = np.ones(len(self.key))
        c0 = np.bincount(self.of, t, len(self.word))
        t0 = np.ones(len(self.word))
        for _ in range(n):
            now = totals or self.estimate(context, t, c0, t0, share)
            p = now.shared(c0, t0)
            a = (STRENGTH + now.discount * now.tables)[context] * p[self.of]
            t = seat(rng, self.count, a, now.discount, order)
            c0 = np.bincount(self.of, t, len(self.word))
            fresh = (SHARED_STRENGTH + now.shared_discount * now.shared_tables) * now.uniform
            t0 = seat(rng, c0, np.full(len(c0), fresh), now.shared_discount)
            yield t, c0, t0

    def estimate(self, context, t, c0, t0, share) -> Totals:
        by_context = [np.bincount(context, x, CONTEXTS) / share for x in (self.count, t)]
        d = discount((self.count == 1).sum(), (self.count == 2).sum())
        d0 = discount((c0 == 1).sum(), (c0 == 2).sum())
        return Totals(self.count.sum() / share, len(self.word) / share, *by_context, c0.sum() / share, t0.sum() / share, d, d0)


def _bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among rising keys; a bucket is a range of hashes."""
    edges = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """``(word, n)``: hash and count of every token of the texts, added up in the tasks first."""

    def run(batches):
        held: list[tuple] = []

        def send():
            word, n = _summed(np.concatenate([w for w, _ in held]), np.concatenate([n for _, n in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

        for batch in batches:
            for words in split_words(batch.column(0), PART_BYTES):
                held.append(np.unique(tokens(words)[0], return_counts=True))
                if sum(len(w) for w, _ in held) > HELD:
                    yield send()
        if held:
            yield send()

    counted = docs.select(text).mapInArrow(run, "word LONG, n LONG")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> np.ndarray:
    """Hashes of the words with the largest counts (ties by hash), rising, with the end token."""
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    found = [w for w in (r["word"] % (1 << 64) for r in top) if w != END]
    return np.array(sorted([*found[: FREQUENT - 1], END]), np.uint64)


def bucket_number(tokens: int) -> int:
    """A power of two, so that buckets of a larger table are parts of those of a smaller one."""
    return 1 << max(0, (tokens - 1) // BUCKET_TOKENS).bit_length()


_TOTAL, _SCALAR, _WORD, _SHARED, _CELL = range(5)


def learn(docs: DataFrame, frequent: np.ndarray, buckets: int, text: str) -> tuple[Totals, np.ndarray, np.ndarray]:
    """First pass over the training texts: ``(totals, log10 probability by context and
    frequent word, training count by frequent word)``."""

    def count(batches):
        # Counts of several parts are joined before they are sent.
        held: list[tuple] = []

        def send():
            key, n = _summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            at = _bucket_bounds(key, buckets)
            rows = [(b, bundle(planes(key[i:j]), n[i:j].astype(np.uint32))) for b, (i, j) in enumerate(zip(at, at[1:], strict=False)) if j > i]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "cells"]
            )

        for batch in batches:
            for words in split_words(batch.column(0), PART_BYTES):
                word, doc = tokens(words)
                _, context = contexts(word, doc, frequent)
                key, n = np.unique(word | context.astype(np.uint64), return_counts=True)
                held.append((key, n))
                if sum(len(k) for k, _ in held) > HELD:
                    yield send()
        if held:
            yield send()

    def sample(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = sorted(table.column("cells").to_pylist())
        parts = [unbundle(x) for x in parts]
        cells = Cells.make(*_summed(np.concatenate([keys_of(k) for k, _ in parts]), np.concatenate([n.astype(np.int64) for _, n in parts])))
        rng = np.random.default_rng([SEED, bucket])
        context = cells.context
        runs = list(cells.sweeps(FIRST_SWEEPS, rng, None, 1 / buckets))[FIRST_SWEEPS // 2 :]
        t, c0, t0 = (np.mean([r[i] for r in runs], axis=0) for i in range(3))
        last = runs[-1][1]
        ones = lambda x: [(x == 1).sum(), (x == 2).sum()]
        rows = [(_TOTAL, 0, u, x, y) for u, (x, y) in enumerate(zip(np.bincount(context, cells.count, CONTEXTS), np.bincount(context, t, CONTEXTS), strict=True)) if x]
        scalars = [[cells.count.sum(), len(cells.word)], [c0.sum(), t0.sum()], ones(cells.count), ones(last)]
        rows += [(_SCALAR, 0, i, float(x), float(y)) for i, (x, y) in enumerate(scalars)]
        sums = np.bincount(cells.of, cells.count, len(cells.word))
        for w in np.flatnonzero(np.isin(cells.word, frequent)):
            name = int(cells.word[w].view(np.int64))
            rows += [(_WORD, name, 0, sums[w], 0.0), (_SHARED, name, 0, c0[w], t0[w])]
        for i in np.flatnonzero(np.isin(cells.word, frequent)[cells.of]):
            rows.append((_CELL, int(cells.word[cells.of[i]].view(np.int64)), int(context[i]), float(cells.count[i]), t[i]))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "word", "context", "x", "y"]
        )

    counted = docs.select(text).mapInArrow(count, "bucket INT, cells BINARY")
    found = (
        counted.groupBy("bucket")
        .applyInArrow(sample, "kind INT, word LONG, context INT, x DOUBLE, y DOUBLE")
        .groupBy("kind", "word", "context")
        .agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
        .toPandas()
    )
    of = lambda kind: found[found["kind"] == kind]
    by_context = np.zeros((2, CONTEXTS))
    rows = of(_TOTAL)
    by_context[:, rows["context"].to_numpy(int)] = rows[["x", "y"]].to_numpy().T
    scalar = np.zeros((4, 2))
    rows = of(_SCALAR)
    scalar[rows["context"].to_numpy(int)] = rows[["x", "y"]].to_numpy()
    totals = Totals(*scalar[0], *by_context, *scalar[1], discount(*scalar[2]), discount(*scalar[3]))
    place = lambda rows: np.searchsorted(frequent, rows["word"].to_numpy(np.int64).view(np.uint64))
    count, shared, cell = np.zeros(len(frequent)), np.zeros((2, len(frequent))), np.zeros((CONTEXTS, len(frequent)))
    count[place(of(_WORD))] = of(_WORD)["x"]
    shared[:, place(of(_SHARED))] = of(_SHARED)[["x", "y"]].to_numpy().T
    rows = of(_CELL)
    context = rows["context"].to_numpy(int)
    cell[context, place(rows)] = (rows["x"] - totals.discount * rows["y"]).to_numpy() / (STRENGTH + totals.customers[context])
    p = cell + totals.novelty[:, None] * totals.shared(*shared)
    return totals, np.log10(p), count


def score(docs: DataFrame, totals: Totals, log_p: np.ndarray, count: np.ndarray, frequent: np.ndarray, buckets: int) -> DataFrame:
    """Second pass, over rows ``(doc_id, train, text)``: sums per text."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((totals, log_p, count, frequent))
    part_schema = "bucket INT, part LONG, docs ARRAY<LONG>, train ARRAY<BOOLEAN>, data BINARY"
    part_names = [f.split()[0] for f in part_schema.split(", ")]
    part_types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary()]

    def deal(batches):
        totals, log_p, count, frequent = held.value
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for words in split_words(batch.column(2), PART_BYTES):
                n, rows = words.n_docs, []
                word, doc = tokens(words)
                train = np.array(batch.column(1).slice(words.first, n).to_pylist(), bool)
                place, context = contexts(word, doc, frequent)
                often = place >= 0
                f, d = place[often], doc[often]
                sums = [np.bincount(d, x, n) for x in (log_p[context[often], f], totals.base(count)[f], (count > 0)[f])]
                info = bundle(*sums, np.bincount(doc, minlength=n))
                ids = batch.column(0).slice(words.first, n).to_pylist()
                rows.append((buckets + part % buckets, part, ids, train.tolist(), info))
                key, d = (word | context.astype(np.uint64))[~often], doc[~often]
                order = np.argsort(key, kind="stable")
                key, d = key[order], d[order].astype(np.uint16 if n < 1 << 16 else np.uint32)
                begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
                times = np.diff(np.append(begin, len(key)))
                learned = np.add.reduceat(train[d].astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
                distinct = key[begin]
                at = _bucket_bounds(distinct, buckets)
                first = np.append(begin, len(key))
                for b, (i, j) in enumerate(zip(at, at[1:], strict=False)):
                    if j > i:
                        data = bundle(planes(distinct[i:j]), times[i:j].astype(np.uint32), learned[i:j].astype(np.uint32), d[first[i] : first[j]])
                        rows.append((b, part, None, None, data))
                part += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), part_types, strict=True)], part_names
                )

    def look_up(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        if bucket >= buckets:
            return table
        totals = held.value[0]
        table = table.sort_by("part")
        parts = [unbundle(x) for x in table.column("data").to_pylist()]
        keys = [keys_of(p[0]) for p in parts]
        key, which = np.unique(np.concatenate(keys), return_inverse=True)
        learned = np.bincount(which, np.concatenate([p[2] for p in parts]), len(key)).astype(np.int64)
        word, of = np.unique(key & ~_CONTEXT_MASK, return_inverse=True)
        known = np.bincount(of, learned, len(word))
        cells = Cells.make(key[learned > 0], learned[learned > 0])
        own, shared = np.zeros(len(key)), np.full(len(word), totals.shared(0.0, 0.0))
        if len(cells.key):
            rng = np.random.default_rng([SEED + 1, bucket])
            runs = list(cells.sweeps(BURN_IN + SAMPLES, rng, totals, 1.0))[BURN_IN:]
            tables = np.mean([r[0] for r in runs], axis=0)
            own[learned > 0] = (cells.count - totals.discount * tables) / (STRENGTH + totals.customers[cells.context])
            shared[known > 0] = np.mean([totals.shared(r[1], r[2]) for r in runs], axis=0)
        p = own + totals.novelty[(key & _CONTEXT_MASK).astype(np.int64)] * shared[of]
        log_p, base, is_known = np.log10(p), totals.base(known)[of], (known > 0)[of]
        rows, first = [], 0
        for number, (_, times, _, doc) in zip(table.column("part").to_pylist(), parts, strict=True):
            at = np.repeat(which[first : first + len(times)], times)
            first += len(times)
            present, where = np.unique(doc, return_inverse=True)
            sums = [np.bincount(where, x[at], len(present)) for x in (log_p, base, is_known)]
            rows.append((bucket, number, None, None, bundle(present, sums[0], sums[1], sums[2].astype(np.uint32))))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), part_types, strict=True)], part_names)

    schema = "doc_id LONG, train BOOLEAN, n_tokens LONG, n_known LONG, base_score DOUBLE, score DOUBLE"

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        (info,) = table.filter(pa.compute.is_valid(table.column("docs"))).to_pylist()
        log_p, base, known, n = unbundle(info["data"])
        for data in table.filter(pa.compute.is_null(table.column("docs"))).column("data").to_pylist():
            present, x, y, z = unbundle(data)
            log_p[present] += x
            base[present] += y
            known[present] += z
        columns = [
            pa.array(info["docs"], pa.int64()), pa.array(info["train"], pa.bool_()), pa.array(n.astype(np.int64)),
            pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(log_p),
        ]
        return pa.Table.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    dealt = docs.mapInArrow(deal, part_schema)
    return dealt.groupBy("bucket").applyInArrow(look_up, part_schema).groupBy("part").applyInArrow(gather, schema)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    A null text counts as an empty one, which has the end token only. Rows may repeat an id;
    further columns are ignored; an empty table gives an empty result. Without training texts
    every word is unknown, with probability 1. The scores depend on the rows only, but for the
    order in which parts of sums are added.
    """
    reachable(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), training(key).alias("train"), F.col(text).alias("text"))
    learned = rows.where("train").select("text")
    counts = materialize(count_words(learned, "text"), "word-counts")
    frequent = frequent_words(counts)
    buckets = bucket_number(counts.agg(F.sum("n")).first()[0] or 0)
    totals, log_p, count = learn(learned, frequent, buckets, "text")
    found = score(rows, totals, log_p, count, frequent, buckets)
    return found.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(totals.n)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token by ``held_out``; null for no tokens."""
    mean = F.try_divide(F.sum("score"), F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.pow(F.lit(10.0), -mean).alias("perplexity"))
