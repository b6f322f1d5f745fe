"""What the model of order three says about every word of the samples, from counts per block.

The model (:mod:`seenscope.operators.kneser_ney`) counts triples and different words before and
after. As in :mod:`seenscope.operators.blocks`, samples are dealt to blocks, and a block asks
buckets once for each of its distinct triples, pairs and words; no place is shuffled.

- First, a bucket has all triples of a context ``(s, u)``: it adds up ``c(s, u, t)`` and finds
  ``c(s, u)`` and ``k(s, u)``. The end of a text is a word here, so that each pair is a context.
  It also tells which of the asking blocks has each fitted triple and pair *new*: exactly one.
- Then each block counts its new triples and pairs, so different words are plain sums over
  blocks: ``k(u, t)`` by pair, ``c'(u)``, ``k(u)`` and ``k(t)`` by word. Pairs have numbers in
  their buckets by now, in the order of their words, so that steps from one to the next are sent.
- Where samples are dealt to their blocks a third time, places take all these counts.

No word is hot: however frequent it is, its triples are dealt by their contexts. What a
frequent context has in one task are its distinct next words in each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.operators import blocks
from seenscope.operators.blocks import (
    DEALT,
    _by_block,
    _column,
    _deal,
    _lists,
    _packed,
    _packed_words,
    _samples,
    _schema,
    _total,
    _unpacked,
    _unpacked_words,
)
from seenscope.operators.kneser_ney import DISCOUNT
from seenscope.operators.language_model import SAMPLE
from seenscope.plans.materialize import materialize
from seenscope.plans.workers import reachable

TRIPLES_ASKED = "bucket INT, block INT, first BINARY, runs BINARY, second BINARY, after BINARY, third BINARY, c BINARY"
TRIPLES = "bucket INT, block INT, c BINARY, c_context BINARY, k_context BINARY, new_triple BINARY, new_pair BINARY, step BINARY"
WORDS_ASKED = "bucket INT, block INT, tok BINARY, k BINARY, c_short BINARY, k_short BINARY, step BINARY, k_pair BINARY"
WORDS = "bucket INT, block INT, k BINARY, c_short BINARY, k_short BINARY, k_pair BINARY, n_pairs LONG, n_words LONG"

NOTHING = blocks._squeeze(b"")
# About two million words: larger than for order two, as more of a block's triples are different.
BLOCK_CHARS = 12 << 20


class Grams:
    """The entries of a block: its places, and an end after each text that has words. Code 0 is
    the empty word, which stands before a text and at its end; others are places in
    ``vocabulary`` plus one.

    ``pairs`` and ``triples`` are distinct contexts and triples, as codes ``first`` and ``second``,
    and ``of`` (the context) and ``third``; ``context`` and ``triple`` are each entry's own. A
    place's own pair is the context of the next entry. ``at`` are the places that follow a word."""

    def __init__(self, texts: pa.Array, number: int):
        self.vocabulary, code, _, self.size = blocks.coded_words(texts)
        filled = np.flatnonzero(self.size)
        lengths = self.size[filled] + 1
        begin = np.cumsum(lengths) - lengths
        self.row = np.repeat(filled, lengths)
        place = np.ones(len(self.row), bool)
        place[begin + lengths - 1] = False
        tok, prev, prev2 = (np.zeros(len(place), np.int64) for _ in range(3))
        tok[place] = code + 1
        # Before a text's first word stands the end of another one, which is the empty word, too.
        prev[1:], prev2[2:] = tok[:-1], tok[:-2]
        prev2[begin] = 0
        self.wide = len(self.vocabulary) + 1
        pairs, self.context = np.unique(prev2 * self.wide + prev, return_inverse=True)
        triples, self.triple = np.unique(self.context * self.wide + tok, return_inverse=True)
        self.pairs, self.first, self.second = pairs, pairs // self.wide, pairs % self.wide
        self.of, self.third = triples // self.wide, triples % self.wide
        place[begin] = False
        self.at, self.tok, self.prev = np.flatnonzero(place), tok, prev
        self.words = pa.concat_arrays([pa.array([""], self.vocabulary.type), self.vocabulary])
        hashed = np.append(np.uint64(0), blocks.word_hashes(self.vocabulary))
        self.word_bucket = blocks.bucket_of(hashed[1:], number)
        self.pair_bucket = blocks.bucket_of(blocks.mixed_hashes(hashed[self.first], hashed[self.second]), number)
        self.word_order = blocks.by_bucket_number(self.word_bucket, number)
        self.pair_order = blocks.by_bucket_number(self.pair_bucket, number)
        self.triple_bucket = self.pair_bucket[self.of]
        self.triple_order = blocks.by_bucket_number(self.triple_bucket, number)

    def packed_words(self, codes: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return _packed_words(self.words.take(pa.array(codes)), sizes)

    def answers(self, table: pa.Table, name: str, order: np.ndarray) -> np.ndarray:
        """Counts in the order of what was asked for."""
        found = np.empty(len(order), np.int64)
        found[order] = _unpacked(_column(table, name))[0]
        return found


def _numbered(number: int, block: int) -> dict[str, pa.Array]:
    return {"bucket": pa.array(np.arange(number), pa.int32()), "block": pa.array(np.full(number, block), pa.int32())}


def _ask_triples(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    """A block's triples with their counts in fitted rows: one row per bucket."""
    for block, dealt in _by_block(batches):
        rows = _samples(_column(dealt, "samples"))
        b = Grams(_column(rows, "text"), number)
        fitted = rows.column("fitted").to_numpy().astype(bool)
        c = np.bincount(b.triple[fitted[b.row]], minlength=len(b.of))
        p, q = b.pair_order, b.triple_order
        n_p, n_t = (np.bincount(x, minlength=number) for x in (b.pair_bucket, b.triple_bucket))
        # The pairs of a bucket stand in the order of their first word, which is sent once.
        head = np.ones(len(p), bool)
        head[1:] = (np.diff(b.first[p]) != 0) | (np.diff(b.pair_bucket[p]) != 0)
        heads = np.flatnonzero(head)
        n_h = np.bincount(b.pair_bucket[p][heads], minlength=number)
        asked = _numbered(number, block) | {
            "first": b.packed_words(b.first[p][heads], n_h),
            "runs": _packed(np.diff(np.append(heads, len(p))), n_h),
            "second": b.packed_words(b.second[p], n_p),
        }
        asked["after"] = _packed(np.bincount(b.of, minlength=len(p))[p], n_p)
        asked["third"] = b.packed_words(b.third[q], n_t)
        asked["c"] = _packed(c[q], n_t)
        yield from pa.table(asked).filter(pa.array(n_p > 0)).to_batches(max_chunksize=4096)


def _asked_words(*listed: pa.Array) -> tuple[list[np.ndarray], int]:
    """Codes of words in the order of the words, the empty one first, and how many there are."""
    both = pc.dictionary_encode(pa.concat_arrays([pa.array([""], listed[0].type), *listed]))
    rank = np.empty(len(both.dictionary), np.int64)
    rank[pc.sort_indices(both.dictionary).to_numpy()] = np.arange(len(rank))
    codes = rank[both.indices.to_numpy()][1:]
    return np.split(codes, np.cumsum([len(x) for x in listed])[:-1]), len(rank)


def _steps(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The differences of rising numbers; each row's first number stays."""
    steps = np.diff(numbers, prepend=0)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[starts] = numbers[starts]
    return steps


def _sums_of_steps(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers again."""
    sums = np.cumsum(steps)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    return sums - np.repeat(sums[starts] - steps[starts], sizes[sizes > 0])


def _new(asked: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 where a code is first asked for with a count, and 0 elsewhere."""
    counted = np.flatnonzero(counts)
    found = np.zeros(len(asked), np.int64)
    found[counted[np.unique(asked[counted], return_index=True)[1]]] = 1
    return found


def _answer_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums over all blocks for each row that asks, and which triples and pairs are new with it."""
    held = list(batches)
    if not held:
        return
    asked = pa.Table.from_batches(held)
    after, n_p = _unpacked(_column(asked, "after"))
    own, n_t = _unpacked(_column(asked, "c"))
    runs, n_h = _unpacked(_column(asked, "runs"))
    listed = [_unpacked_words(_column(asked, x), n) for x, n in (("first", n_h), ("second", n_p), ("third", n_t))]
    (first, second, third), wide = _asked_words(*listed)
    pairs, pair = np.unique(np.repeat(first, runs) * wide + second, return_inverse=True)
    triples, triple = np.unique(np.repeat(pair, after) * wide + third, return_inverse=True)
    of, inside = triples // wide, triples % wide > 0
    c = _total(triple, own, len(triples)) * inside
    fitted = _total(np.repeat(np.arange(len(pair)), after), own, len(pair))
    answered = pa.table(
        {
            "bucket": asked.column("bucket"),
            "block": asked.column("block"),
            "c": _packed(c[triple], n_t),
            "c_context": _packed(_total(of, c, len(pairs))[pair], n_p),
            "k_context": _packed(_total(of, c > 0, len(pairs))[pair], n_p),
            "new_triple": _packed(_new(triple, own) * inside[triple], n_t),
            "new_pair": _packed(_new(pair, fitted), n_p),
            "step": _packed(_steps(pair, n_p), n_p),
        }
    )
    yield from answered.to_batches(max_chunksize=4096)


def _ask_words(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
    """A block's words and pairs with their counts among what is new with it: one row per bucket."""
    for block, rows in _by_block(batches):
        dealt = pc.is_null(rows.column("bucket"))
        answers = rows.filter(pc.invert(dealt)).sort_by("bucket")
        b = Grams(_column(_samples(_column(rows.filter(dealt), "samples")), "text"), number)
        triple = np.flatnonzero(b.answers(answers, "new_triple", b.triple_order))
        pair = np.flatnonzero(b.answers(answers, "new_pair", b.pair_order))
        pair = pair[b.second[pair] > 0]
        middle = b.second[b.of[triple]]
        own = np.searchsorted(b.pairs, middle * b.wide + b.third[triple])
        w, p = b.word_order, b.pair_order
        n_w, n_p = (np.bincount(x, minlength=number) for x in (b.word_bucket, b.pair_bucket))
        answered = dict(zip(answers.column("bucket").to_pylist(), answers.column("step").to_pylist(), strict=True))
        steps = [answered.get(i, NOTHING) for i in range(number)]
        asked = _numbered(number, block) | {"tok": b.packed_words(w + 1, n_w)}
        for name, codes in (("k", b.second[pair]), ("c_short", middle), ("k_short", b.first[pair])):
            asked[name] = _packed(np.bincount(codes, minlength=b.wide)[1:][w], n_w)
        asked["step"] = pa.array(steps, pa.binary())
        asked["k_pair"] = _packed(np.bincount(own, minlength=len(p))[p], n_p)
        yield from pa.table(asked).filter(pa.array((n_w > 0) | (n_p > 0))).to_batches(max_chunksize=4096)


def _answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums over all blocks for each row that asks."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    buckets = table.column("bucket").to_numpy()
    for bucket in np.unique(buckets):
        asked = table.filter(pa.array(buckets == bucket))
        own, n_w = _unpacked(_column(asked, "k"))
        tok = pc.dictionary_encode(_unpacked_words(_column(asked, "tok"), n_w))
        code, n_tok = tok.indices.to_numpy(), len(tok.dictionary)
        k = _total(code, own, n_tok)
        sums = {"k": k} | {x: _total(code, _unpacked(_column(asked, x))[0], n_tok) for x in ("c_short", "k_short")}
        pair = _sums_of_steps(*_unpacked(_column(asked, "step")))
        own_pair, n_p = _unpacked(_column(asked, "k_pair"))
        n_pairs, n_words = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        n_pairs[0], n_words[0] = k.sum(), np.count_nonzero(k)
        answered = pa.table(
            {
                "bucket": asked.column("bucket"),
                "block": asked.column("block"),
                **{x: _packed(counts[code], n_w) for x, counts in sums.items()},
                "k_pair": _packed(_total(pair, own_pair, 0)[pair], n_p),
                "n_pairs": n_pairs,
                "n_words": n_words,
            }
        )
        yield from answered.to_batches(max_chunksize=4096)


def _interpolated(count: np.ndarray, total: np.ndarray, followers: np.ndarray, lower: np.ndarray, discount: float) -> np.ndarray:
    """As :func:`kneser_ney._interpolated`."""
    some = np.maximum(total, 1).astype(float)
    found = np.maximum(count - discount, 0.0) / some + discount * followers / some * lower
    return np.where(total > 0, found, lower)


def _logprobs(
    batches: Iterator[pa.RecordBatch], number: int, n_pairs: int, n_words: int, discount: float, with_words: bool
) -> Iterator[pa.RecordBatch]:
    spread = discount * n_words / (n_words + 1)
    for _, rows in _by_block(batches):
        triples, words = (rows.filter(pc.is_valid(rows.column(x))).sort_by("bucket") for x in ("c", "k_pair"))
        rows = _samples(_column(rows.filter(pc.is_null(rows.column("bucket"))), "samples"))
        b = Grams(_column(rows, "text"), number)
        tok, prev, context = b.tok[b.at], b.prev[b.at], b.context[b.at]
        by_word = {x: np.append(0, b.answers(words, x, b.word_order)) for x in ("k", "c_short", "k_short")}
        k_pair = b.answers(words, "k_pair", b.pair_order)[b.context[b.at + 1]]
        value = np.ones(len(b.at))
        if n_pairs:
            value = (np.maximum(by_word["k"][tok] - discount, 0.0) + spread) / n_pairs
        value = _interpolated(k_pair, by_word["c_short"][prev], by_word["k_short"][prev], value, discount)
        c = b.answers(triples, "c", b.triple_order)[b.triple[b.at]]
        c_context, k_context = (b.answers(triples, x, b.pair_order)[context] for x in ("c_context", "k_context"))
        value = np.log(_interpolated(c, c_context, k_context, value, discount))
        columns = {c: rows.column(c) for c in SAMPLE}
        sizes = np.maximum(b.size - 1, 0)
        if with_words:
            columns["tok"] = _lists(b.words.take(pa.array(tok)), sizes)
        columns["logprob"] = _lists(value, sizes)
        yield from pa.table(columns).filter(pa.array(b.size > 1)).to_batches(max_chunksize=4096)


def sample_logprobs(
    items: DataFrame, fitted: Column, discount: float = DISCOUNT, with_words: bool = False
) -> DataFrame:
    """Per sample of two words or more the log-probabilities of its words but the first, by the
    model of the ``fitted`` rows, as an array ``logprob``; with the words as ``tok``. The same
    values as :func:`kneser_ney.place_logprobs`."""
    reachable(items.sparkSession)
    number = blocks.block_number(items, BLOCK_CHARS)
    marked = items.select(
        *SAMPLE,
        F.coalesce(fitted, F.lit(False)).alias("fitted"),
        F.pmod(F.xxhash64(*SAMPLE, "instruction_text"), F.lit(number)).cast("int").alias("block"),
        F.lower("instruction_text").alias("text"),
    )

    def dealt(*columns: str) -> DataFrame:
        return marked.select("block", *columns, "text").mapInArrow(_deal, DEALT)

    def together(samples: DataFrame, *answers: DataFrame) -> DataFrame:
        for x in answers:
            samples = samples.unionByName(x, allowMissingColumns=True)
        return samples.repartitionById(number, "block")

    asked = dealt("fitted").repartitionById(number, "block").mapInArrow(partial(_ask_triples, number=number), TRIPLES_ASKED)
    triples = materialize(asked.repartitionById(number, "bucket").mapInArrow(_answer_triples, TRIPLES), "triples")
    new = triples.select("bucket", "block", "new_triple", "new_pair", "step")
    asked = together(dealt(), new).mapInArrow(partial(_ask_words, number=number), WORDS_ASKED)
    words = materialize(asked.repartitionById(number, "bucket").mapInArrow(_answer_words, WORDS), "words")
    n_pairs, n_words = words.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n_pairs", "n_words")]).first()
    rows = together(dealt(*SAMPLE), triples.drop("new_triple", "new_pair", "step"), words.drop("n_pairs", "n_words"))
    found = partial(_logprobs, number=number, n_pairs=n_pairs, n_words=n_words, discount=discount, with_words=with_words)
    schema = _schema(items, SAMPLE, *(["tok ARRAY<STRING>"] if with_words else []), "logprob ARRAY<DOUBLE>")
    return rows.mapInArrow(found, schema)
