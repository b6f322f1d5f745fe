"""Packing of tokenized documents into sequences by Karmarkar-Karp differencing.

A document is cut into full windows, which are sequences of their own, and a rest. Rests are
cut once more into parts of at most ``part`` tokens and packed in groups: multiway
differencing starts with one partial partition per part, always merges the two with the
largest imbalance, the fullest windows of one with the emptiest of the other, and ends with
windows of nearly equal size. The number of windows starts at what the tokens need and rises
by one while any window is over capacity.

A group is ``group`` parts of one task, in the order of the rows, so rows are not shuffled,
memory is bounded, and a task that runs again gives the same sequences. Each task ends with
one smaller group. Nothing depends on keys, so there is no skew.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seenscope.llm.tokens import END, WordTokenizer, tokenizer_path
from seenscope.llm.words import reachable, split_words

WINDOW = 2048
GROUP = 256
PART = 700


def difference(sizes: np.ndarray, m: int) -> np.ndarray:
    """Window (0 to ``m - 1``) of each item by multiway differencing, for items over 0."""
    n = len(sizes)
    follows = np.full(n, -1)  # the next item of the same window
    states = {}  # tokens, first and last item of each window, by rising tokens
    for i, size in enumerate(sizes):
        tokens, item = np.zeros(m, np.int64), np.full(m, -1)
        tokens[-1], item[-1] = size, i
        states[i] = (tokens, item, item)
    heap = [(-int(s) if m > 1 else 0, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        tokens, first, last = states[a]
        more, first_b, last_b = (x[::-1] for x in states.pop(b))
        both = (last >= 0) & (first_b >= 0)
        follows[last[both]] = first_b[both]
        tokens = tokens + more
        order = tokens.argsort(kind="stable")
        tokens = tokens[order]
        states[a] = (
            tokens,
            np.where(first < 0, first_b, first)[order],
            np.where(last_b < 0, last, last_b)[order],
        )
        heapq.heappush(heap, (int(tokens[0] - tokens[-1]), a))
    window = np.zeros(n, np.int64)
    for _, first, _ in states.values():  # one is left
        for w, at in enumerate(first):
            while at >= 0:
                window[at] = w
                at = follows[at]
    return window


def pack(sizes: np.ndarray, capacity: int = WINDOW) -> np.ndarray:
    """Window of each item of 1 to ``capacity`` tokens; no window exceeds the capacity."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, m)
        if np.bincount(window, sizes, m).max() <= capacity:
            return window
        m += 1


def cut(length: int, capacity: int = WINDOW, part: int = PART) -> Iterator[tuple[int, int, bool]]:
    """``(start, length, full window?)`` of the pieces of a document."""
    full = length - length % capacity
    for start in range(0, full, capacity):
        yield start, capacity, True
    rest = length - full
    n = -(-rest // part)
    for i in range(n):
        begin, end = rest * i // n, rest * (i + 1) // n
        yield full + begin, end - begin, False


SCHEMA = (
    "doc_id LONG, start LONG, length LONG, ids_crc32 LONG, doc_tokens LONG, "
    "sequence_id LONG, offset LONG"
)


def pack_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    capacity: int = WINDOW,
    group: int = GROUP,
    part: int = PART,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: its document, place in the document, sequence and place there.

    A null text counts as an empty one, whose only token is the end token. A null or repeated
    id is packed like any other; further columns are ignored. An empty table gives an empty
    result. With ``with_ids`` the token ids of each piece come as a column ``ids``.
    """
    path = tokenizer or tokenizer_path()
    schema = SCHEMA + (", ids ARRAY<LONG>" if with_ids else "")
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches):
        words = WordTokenizer.load(path)
        # Sequence numbers of a task: its number, then a running number.
        next_id = TaskContext.get().partitionId() << 40
        held: list[list] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal next_id
            loose = [i for i, row in enumerate(held) if row[5] is None]
            window = pack(np.array([held[i][2] for i in loose], np.int64), capacity)
            filled: dict[int, int] = {}
            for i, w in zip(loose, window, strict=True):
                held[i][5], held[i][6] = next_id + int(w), filled.get(w, 0)
                filled[w] = held[i][6] + held[i][2]
            next_id += int(window.max()) + 1 if len(window) else 0
            columns = list(zip(*held, strict=True)) if held else [[] for _ in names]
            types = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
            )
            held.clear()

        loose = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for found in split_words(batch.column(1)):
                ids, counts = words.encode(found)
                ends = np.cumsum(counts)
                for d in range(found.n_docs):
                    own = np.append(ids[ends[d] - counts[d] : ends[d]], np.uint32(END))
                    for start, length, whole in cut(len(own), capacity, part):
                        piece = own[start : start + length]
                        row = [keys[found.first + d], start, length, zlib.crc32(piece.tobytes()), len(own)]
                        row += [None, None] if not whole else [next_id, 0]
                        next_id += whole
                        loose += not whole
                        held.append(row + [piece.tolist()] * with_ids)
                    if loose >= group:
                        yield from close()
                        loose = 0
        yield from close()

    reachable(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
