"""What the model says about every word of the samples, from counts per block of samples.

The bigram model (:mod:`seenscope.operators.language_model`) needs three counts for a place:
of the pair, of its word, and of the word before as a context. Samples are dealt to blocks of
about ``BLOCK_CHARS`` characters. A block counts its distinct words and pairs and deals these
to buckets by a hash of the words; a bucket adds the counts of all blocks and sends each block
its sums back, in the order of its question. So a distinct word or pair travels once per
block, and no place is shuffled: texts are dealt to their blocks a second time, where the
places take their counts.

What travels is packed: a block's samples as Arrow streams, words as text and counts by their
bytes, lowest first, all compressed.

No key is hot: however frequent a word or pair is, a block asks for it once. A block and a
bucket hold about as many words whatever the size of the input; there are more of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.operators.language_model import SAMPLE
from seenscope.plans.materialize import materialize
from seenscope.plans.workers import reachable

# About a million words.
BLOCK_CHARS = 6 << 20
# A cell's bucket travels in the last bits of its pair's count.
CELL_BUCKETS = 16
# A task deals samples to blocks when it holds so many bytes of them.
DEAL_BYTES = 32 << 20
CODEC = pa.Codec("zstd", 1)
BLANK = np.isin(np.arange(256), [ord(c) for c in " \t\n\r\f"])

DEALT = "block INT, samples BINARY"
ASKED = "bucket INT, block INT, tok BINARY, c_tok BINARY, c_end BINARY, prev BINARY, runs BINARY, next BINARY, c_pair BINARY"
ANSWERED = "bucket INT, block INT, c_tok BINARY, c_prev BINARY, c_pair BINARY, mass LONG"


def _lists(values: np.ndarray | pa.Array, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + CODEC.compress(data, asbytes=True)


def _widen(data: bytes) -> bytes:
    return CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _packed(counts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Counts of each bucket: their lowest bytes, then the next ones, and so on."""
    parts = np.split(counts.astype("<i8"), np.cumsum(sizes)[:-1])
    return pa.array([_squeeze(x.view(np.uint8).reshape(-1, 8).T.tobytes()) for x in parts], pa.binary())


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All counts, and how many there are in each row."""
    parts = [np.frombuffer(_widen(x), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel() for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.array([len(x) for x in parts], np.int64)


def _packed_words(words: pa.Array, sizes: np.ndarray) -> pa.Array:
    joined = pc.binary_join(_lists(words, sizes), " ").cast(pa.binary())
    return pa.array([_squeeze(x) for x in joined.to_pylist()], pa.binary())


def _unpacked_words(column: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The words of all rows; an empty text has none."""
    texts = pa.array([_widen(x) for x in column.to_pylist()], pa.binary()).cast(pa.string())
    return pc.list_flatten(pc.split_pattern(texts.filter(pa.array(sizes > 0)), " "))


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-case texts, as :func:`seenscope.functions.words.words` finds them, and
    the row of each. Blanks are single bytes, which are part of no other character."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    chars = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~BLANK[chars]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(chars)]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    kept = chars[inside]
    starts = np.append(np.cumsum(inside)[at] - 1, len(kept)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(at), pa.py_buffer(starts), pa.py_buffer(kept))
    return found, np.searchsorted(ends, at, side="right") - 1


def coded_words(texts: pa.Array, max_length: int | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of lower-case texts in rising order, each place's word there and its row, and the places of each row."""
    listed, row = _words(texts)
    size = np.bincount(row, minlength=len(texts))
    if max_length is not None:
        place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
        listed, row = listed.filter(pa.array(place < max_length)), row[place < max_length]
        size = np.minimum(size, max_length)
    encoded = pc.dictionary_encode(listed)
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return encoded.dictionary.take(pa.array(order)), rank[encoded.indices.to_numpy()], row, size


def word_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def mixed_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xD6E8FEB86659FD93)


def bucket_of(hashes: np.ndarray, number: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(number)).astype(np.int64)


def by_bucket_number(buckets: np.ndarray, number: int) -> np.ndarray:
    """A stable order by bucket; few buckets are sorted by their digits."""
    return np.argsort(buckets.astype(np.uint16 if number < 1 << 16 else np.int64), kind="stable")


class Block:
    """The places of a block: ``vocabulary`` is its distinct words in rising order, ``code``
    each place's word there, ``at`` the places that follow a word, ``pairs`` and ``pair`` the
    distinct pairs and those places' own. Words and pairs have buckets, of ``number``, and an
    order by bucket; all of these depend on the words alone, not on the order of the rows."""

    def __init__(self, rows: pa.Table, number: int, max_length: int | None):
        self.vocabulary, self.code, self.row, self.size = coded_words(_column(rows, "text"), max_length)
        start = np.cumsum(self.size) - self.size
        follows = np.ones(len(self.code), bool)
        follows[start[self.size > 0]] = False
        self.at = np.flatnonzero(follows)
        self.last = (start + self.size - 1)[self.size > 0]
        wide = max(1, len(self.vocabulary))
        key = self.code[self.at - 1] * wide + self.code[self.at]
        self.pairs, self.pair = np.unique(key, return_inverse=True)
        self.prev, self.next = self.pairs // wide, self.pairs % wide
        hashed = word_hashes(self.vocabulary)
        self.word_bucket = bucket_of(hashed, number)
        self.pair_bucket = bucket_of(mixed_hashes(hashed[self.prev], hashed[self.next]), number)
        self.word_order = by_bucket_number(self.word_bucket, number)
        self.pair_order = by_bucket_number(self.pair_bucket, number)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The samples of each block together, as far as a task holds them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= DEAL_BYTES:
            yield _dealt(held)
            held, size = [], 0
    if held:
        yield _dealt(held)


def _dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    block = table.column("block").to_numpy()
    order = np.argsort(block, kind="stable")
    rows = table.drop_columns(["block"]).take(pa.array(order)).combine_chunks()
    blocks, starts = np.unique(block[order], return_index=True)
    streams = []
    for start, end in zip(starts, np.append(starts[1:], len(order))):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(rows.slice(start, end - start))
        streams.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(streams, pa.binary())], ["block", "samples"])


def _samples(column: pa.Array) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in column.to_pylist()]).combine_chunks()


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each block of a task."""
    held = list(batches)
    if held:
        table = pa.Table.from_batches(held)
        blocks = table.column("block").to_numpy()
        for block in np.unique(blocks):
            yield int(block), table.filter(pa.array(blocks == block))


def _ask(batches: Iterator[pa.RecordBatch], number: int, max_length: int | None) -> Iterator[pa.RecordBatch]:
    """A block's words and pairs with their counts in fitted rows: one row per bucket."""
    for block, dealt in _by_block(batches):
        rows = _samples(_column(dealt, "samples"))
        b = Block(rows, number, max_length)
        fitted = rows.column("fitted").to_numpy().astype(bool)
        n_words, n_pairs = len(b.vocabulary), len(b.pairs)
        c_tok = np.bincount(b.code[fitted[b.row]], minlength=n_words)
        c_end = np.bincount(b.code[b.last[fitted[b.row[b.last]]]], minlength=n_words)
        c_pair = np.bincount(b.pair[fitted[b.row[b.at]]], minlength=n_pairs)
        w, p = b.word_order, b.pair_order
        n_w, n_p = np.bincount(b.word_bucket, minlength=number), np.bincount(b.pair_bucket, minlength=number)

        # Pairs stand in the order of their first word, which is sent once a bucket.
        head = np.ones(n_pairs, bool)
        head[1:] = (np.diff(b.prev[p]) != 0) | (np.diff(b.pair_bucket[p]) != 0)
        heads = np.flatnonzero(head)
        n_h = np.bincount(b.pair_bucket[p][heads], minlength=number)

        def words(codes, sizes, b=b):
            return _packed_words(b.vocabulary.take(pa.array(codes)), sizes)

        asked = pa.table(
            {
                "bucket": pa.array(np.arange(number), pa.int32()),
                "block": pa.array(np.full(number, block), pa.int32()),
                "tok": words(w, n_w),
                "c_tok": _packed(c_tok[w], n_w),
                "c_end": _packed(c_end[w], n_w),
                "prev": words(b.prev[p][heads], n_h),
                "runs": _packed(np.diff(np.append(heads, n_pairs)), n_h),
                "next": words(b.next[p], n_p),
                "c_pair": _packed(c_pair[p], n_p),
            }
        )
        yield from asked.filter(pa.array((n_w > 0) | (n_p > 0))).to_batches(max_chunksize=4096)


def _total(codes: np.ndarray, counts: np.ndarray, number: int) -> np.ndarray:
    """Sum of the counts of each code."""
    # As doubles, which are exact up to 2^53.
    return np.bincount(codes, weights=counts, minlength=number).astype(np.int64)


def _answer(batches: Iterator[pa.RecordBatch], cells: bool) -> Iterator[pa.RecordBatch]:
    """The sums over all blocks for each row that asks."""
    held = list(batches)
    if not held:
        return
    asked = pa.Table.from_batches(held)
    asked_tok, n_w = _unpacked(_column(asked, "c_tok"))
    asked_pair, n_p = _unpacked(_column(asked, "c_pair"))
    tok = pc.dictionary_encode(_unpacked_words(_column(asked, "tok"), n_w))
    code, n_tok = tok.indices.to_numpy(), len(tok.dictionary)
    c_tok = _total(code, asked_tok, n_tok)
    c_end = _total(code, _unpacked(_column(asked, "c_end"))[0], n_tok)
    runs, n_h = _unpacked(_column(asked, "runs"))
    heads, after = _unpacked_words(_column(asked, "prev"), n_h), _unpacked_words(_column(asked, "next"), n_p)
    both = pc.dictionary_encode(pa.concat_arrays([heads, after]))
    codes = both.indices.to_numpy().astype(np.int64)
    prev, after = np.repeat(codes[: len(heads)], runs), codes[len(heads) :]
    key = prev * max(1, len(both.dictionary)) + after
    pairs, first, pair = np.unique(key, return_index=True, return_inverse=True)
    c_pair = _total(pair, asked_pair, len(pairs))
    if cells:
        text = pc.binary_join_element_wise(*[both.dictionary.take(pa.array(x[first])) for x in (prev, after)], " ")
        digits = [hashlib.md5(t).digest()[0] >> 4 for t in text.cast(pa.binary()).to_numpy(zero_copy_only=False)]
        c_pair = c_pair * CELL_BUCKETS + np.array(digits, np.int64)
    mass = np.zeros(len(asked), np.int64)
    mass[0] = c_tok.sum() + np.count_nonzero(c_tok)
    answered = pa.table(
        {
            "bucket": asked.column("bucket"),
            "block": asked.column("block"),
            "c_tok": _packed(c_tok[code], n_w),
            "c_prev": _packed((c_tok - c_end)[code], n_w),
            "c_pair": _packed(c_pair[pair], n_p),
            "mass": mass,
        }
    )
    yield from answered.to_batches(max_chunksize=4096)


def _counted(
    batches: Iterator[pa.RecordBatch], number: int, max_length: int | None
) -> Iterator[tuple[pa.Table, Block, np.ndarray, np.ndarray, np.ndarray]]:
    """Samples of a block, their places, and per place that follows a word the counts of its
    pair, of the word before as a context, and of its word."""
    for _, rows in _by_block(batches):
        dealt = pc.is_null(rows.column("bucket"))
        answers = rows.filter(pc.invert(dealt)).sort_by("bucket")
        rows = _samples(_column(rows.filter(dealt), "samples"))
        b = Block(rows, number, max_length)
        found = {}
        for name, order in (("c_tok", b.word_order), ("c_prev", b.word_order), ("c_pair", b.pair_order)):
            found[name] = np.empty(len(order), np.int64)
            found[name][order] = _unpacked(_column(answers, name))[0]
        prev, tok = b.code[b.at - 1], b.code[b.at]
        yield rows, b, found["c_pair"][b.pair], found["c_prev"][prev], found["c_tok"][tok]


def _logprobs(
    batches: Iterator[pa.RecordBatch], number: int, mass: int, max_length: int | None, with_words: bool, keys: list[str]
) -> Iterator[pa.RecordBatch]:
    for rows, b, c_pair, c_prev, c_tok in _counted(batches, number, max_length):
        value = np.log((c_pair + (c_tok + 1.0) / mass) / (c_prev + 1.0))
        columns = {c: rows.column(c) for c in keys}
        if with_words:
            columns["tok"] = _lists(b.vocabulary.take(pa.array(b.code[b.at])), np.maximum(b.size - 1, 0))
        columns["logprob"] = _lists(value, np.maximum(b.size - 1, 0))
        wanted = pc.and_(rows.column("wanted"), pa.array(b.size > 1))
        yield from pa.table(columns).filter(wanted).to_batches(max_chunksize=4096)


def _cell_sums(
    batches: Iterator[pa.RecordBatch], number: int, mass: int, max_length: int | None, sums, names: list[str], keys: list[str]
) -> Iterator[pa.RecordBatch]:
    """Per sample and bucket of cells: their count ``n`` and what ``sums`` gives of them, as lists by bucket."""
    for rows, b, c_pair, c_prev, c_tok in _counted(batches, number, max_length):
        # A cell is a distinct pair of a sample; contexts are counted within the sample, too.
        sample, wide = b.row[b.at], max(1, len(b.pairs))
        _, first, n = np.unique(sample * wide + b.pair, return_index=True, return_counts=True)
        context = sample * max(1, len(b.vocabulary)) + b.code[b.at - 1]
        _, own, uses = np.unique(context, return_inverse=True, return_counts=True)
        bucket = sample[first] * CELL_BUCKETS + c_pair[first] % CELL_BUCKETS
        values = sums(n, uses[own[first]], c_pair[first] // CELL_BUCKETS, c_prev[first], (c_tok[first] + 1.0) / mass)
        size, buckets = len(rows) * CELL_BUCKETS, np.full(len(rows), CELL_BUCKETS)
        columns = {c: rows.column(c) for c in keys}
        columns["n"] = _lists(np.bincount(bucket, weights=n, minlength=size).astype(np.int64), buckets)
        columns |= {c: _lists(np.bincount(bucket, weights=values[c], minlength=size), buckets) for c in names}
        wanted = pc.and_(rows.column("wanted"), pa.array(b.size > 1))
        yield from pa.table(columns).filter(wanted).to_batches(max_chunksize=2048)


def block_number(items: DataFrame, block_chars: int | None = None) -> int:
    """How many blocks of ``block_chars`` characters, ``BLOCK_CHARS`` if not given, there are."""
    chars = items.agg(F.coalesce(F.sum(F.length("instruction_text")), F.lit(0))).first()[0]
    return max(items.sparkSession.sparkContext.defaultParallelism, -(-chars // (block_chars or BLOCK_CHARS)))


def _answered(
    items: DataFrame, fitted: Column, wanted: Column | None, max_length: int | None, cells: bool, keys: list[str]
) -> tuple[DataFrame, int, int]:
    """Samples and the answers to their blocks, dealt by block; the number of blocks; N + V + 1."""
    reachable(items.sparkSession)
    number = block_number(items)
    marked = items.select(
        *keys,
        F.coalesce(fitted, F.lit(False)).alias("fitted"),
        F.coalesce(F.lit(True) if wanted is None else wanted, F.lit(False)).alias("wanted"),
        F.pmod(F.xxhash64(*SAMPLE, "instruction_text"), F.lit(number)).cast("int").alias("block"),
        F.lower("instruction_text").alias("text"),
    ).where("fitted OR wanted")
    texts = marked.select("block", "fitted", "text").mapInArrow(_deal, DEALT).repartitionById(number, "block")
    asked = texts.mapInArrow(partial(_ask, number=number, max_length=max_length), ASKED)
    answers = asked.repartitionById(number, "bucket").mapInArrow(partial(_answer, cells=cells), ANSWERED)
    answers = materialize(answers, "answers")
    mass = answers.agg(F.coalesce(F.sum("mass"), F.lit(0)) + 1).first()[0]
    samples = marked.drop("fitted").mapInArrow(_deal, DEALT)
    dealt = samples.unionByName(answers.drop("mass"), allowMissingColumns=True).repartitionById(number, "block")
    return dealt, number, mass


def _schema(items: DataFrame, keys: list[str], *columns: str) -> str:
    return ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in items.select(*keys).schema], *columns])


def sample_logprobs(
    items: DataFrame,
    fitted: Column,
    wanted: Column | None = None,
    max_length: int | None = None,
    with_words: bool = False,
) -> DataFrame:
    """Per ``wanted`` sample of two words or more the log-probabilities of its words but the
    first, by the model of the ``fitted`` rows, as an array ``logprob``; with the words as ``tok``."""
    rows, number, mass = _answered(items, fitted, wanted, max_length, False, SAMPLE)
    schema = _schema(items, SAMPLE, *(["tok ARRAY<STRING>"] if with_words else []), "logprob ARRAY<DOUBLE>")
    found = partial(_logprobs, number=number, mass=mass, max_length=max_length, with_words=with_words, keys=SAMPLE)
    return rows.mapInArrow(found, schema)


def listed_sums(
    items: DataFrame,
    fitted: Column,
    sums,
    names: list[str],
    wanted: Column | None = None,
    max_length: int | None = None,
    keep: tuple = (),
) -> DataFrame:
    """Per ``wanted`` row of two words or more, by bucket of its cells (``trajectory.pair_bucket``):
    an array ``n`` of their counts, and under ``names`` arrays of the sums of the values that
    ``sums`` gives from the cells' ``n``, ``n_prev``, ``c_pair``, ``c_prev`` and ``base``. Columns
    to ``keep`` come along."""
    keys = [*SAMPLE, *keep]
    rows, number, mass = _answered(items, fitted, wanted, max_length, True, keys)
    found = partial(_cell_sums, number=number, mass=mass, max_length=max_length, sums=sums, names=names, keys=keys)
    return rows.mapInArrow(found, _schema(items, keys, "n ARRAY<LONG>", *[f"{c} ARRAY<DOUBLE>" for c in names]))


def by_bucket(listed: DataFrame, names: list[str]) -> DataFrame:
    """:func:`listed_sums` with one row per sample and bucket that has cells."""
    buckets = F.array(*[F.lit(i) for i in range(CELL_BUCKETS)]).alias("bucket")
    rows = listed.select(*SAMPLE, buckets, "n", *names)
    return rows.select(*SAMPLE, F.inline(F.arrays_zip("bucket", "n", *names))).where("n > 0")


def cell_sums(
    items: DataFrame,
    fitted: Column,
    sums,
    names: list[str],
    wanted: Column | None = None,
    max_length: int | None = None,
) -> DataFrame:
    """:func:`listed_sums` by bucket."""
    return by_bucket(listed_sums(items, fitted, sums, names, wanted, max_length), names)
