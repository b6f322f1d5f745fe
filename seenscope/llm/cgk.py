"""Benchmark decontamination by CGK embedding, bit sampling and exact edit verification.

The CGK random walk reads a string of words: at each step it writes the word under its head
and moves on by a random bit that depends on the step and the word. Two strings at a small
edit distance meet again soon after an edit, so their outputs differ in few places. Some
places of the output are sampled, and equal samples make a candidate; this is repeated with
fresh walks and samples until the target recall is reached. Candidates whose whole embeddings
differ too much are given up.

At the edit limit windows of words agree too rarely for any number of repetitions to be sure,
so the same documents are also searched by pieces: ``most`` edits leave all but ``most`` of an
item's disjoint pieces as they were, on diagonals at most ``most`` code points apart. Where
that many pieces of an item meet, it is a candidate, too; so no item within the limit is missed.

Windows are as long as the shortest item less the stride. Documents are read at every
``stride``-th word only; items are read at every word, so whatever an item's place in a
document is, windows that start at the same word of the item meet. Candidates are verified
in place: the edit distance, by code points with A-Z lower-cased, between the whole item and
the best matching part of the document is at most ``edits`` of the item's length.

Items are held by every task, so they come in blocks of bounded size, one pass over the
documents per block; documents are never shuffled. Items of fewer than ``short`` words must
occur word for word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seenscope.llm.words import Words, mix, reachable, split_words
from seenscope.plans.materialize import materialize

EDITS = 0.1
SHORT = 8
STRIDE = 4
SAMPLES = 4  # places compared by one repetition
AGREE = 0.8  # share of equal places assumed of a window; less near the edit limit
RECALL = 0.98  # of the walks alone at that share
DIFFER = 0.5  # candidates whose embeddings differ in more than this share are not verified
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 8  # at most
HITS = 1 << 20  # places of pieces taken together
_FILTER_BITS = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def repetitions(recall: float = RECALL, agree: float = AGREE, samples: int = SAMPLES) -> int:
    """How often to repeat so that one matching window is found with the target recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**samples)))


@dataclass(frozen=True)
class Walk:
    """A random walk over windows of ``length`` words and the places it samples.

    The head moves by half a word a step, so ``steps`` of 1.75 times the length rarely leave
    the window; beyond it, padding is written. One place is sampled from each of ``samples``
    stretches of the output, so that they fall on different words.
    """

    length: int
    steps: int
    places: tuple[int, ...]
    odd: np.ndarray

    @staticmethod
    def make(length: int, seed: int, samples: int = SAMPLES) -> Walk:
        rng = np.random.default_rng([seed, length])
        steps = max(samples, (7 * length) // 4)
        edges = [steps * i // samples for i in range(samples + 1)]
        places = tuple(int(rng.integers(x, y)) for x, y in zip(edges, edges[1:], strict=False))
        odd = rng.integers(0, 1 << 63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return Walk(length, steps, places, odd)

    def words(self, hashes: np.ndarray, starts: np.ndarray, steps: int) -> Iterator[np.ndarray]:
        """What the walk writes at each step, for windows that begin at ``starts``."""
        head, stop = starts.copy(), starts + self.length
        padded = np.append(hashes, np.zeros(self.length + 1, np.uint64))
        for step in range(steps):
            word = padded[head]
            if step >= self.length:
                word = np.where(head < stop, word, np.uint64(0))
            yield word
            head += ((word * self.odd[step]) >> np.uint64(63)).astype(np.int64)

    def keys(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One key per window: the sampled places of its embedding."""
        key = np.zeros(len(starts), np.uint64)
        for step, word in enumerate(self.words(hashes, starts, self.places[-1] + 1)):
            if step in self.places:
                key = mix(key + word)
        return key

    def distances(self, a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
        """Share of places in which the embeddings of two windows differ."""
        differ = np.zeros(len(at_a))
        for x, y in zip(self.words(a, at_a, self.steps), self.words(b, at_b, self.steps), strict=True):
            differ += x != y
        return differ / self.steps


def within(item: str, text: str, most: int) -> int | None:
    """Smallest edit distance of ``item`` to a substring of ``text``, if at most ``most``."""
    if item in text:
        return 0
    if not most:
        return None
    # Bit-parallel columns of the distance table, one per character of the text.
    n = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, n
    for c in text:
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right = down | (~(diagonal | up) & full)
        left = up & diagonal
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right, left = (right << 1) & full, (left << 1) & full
        up = left | (~(diagonal | right) & full)
        down = right & diagonal
        best = min(best, score)
    return best if best <= most else None


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_LOWER_BYTES = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def fold(text: str) -> str:
    return text.translate(_ASCII_LOWER)


def gram_keys(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes (8 at most) from each place on, as one number."""
    n = max(len(data) - size + 1, 0)
    key = np.zeros(n, np.uint64)
    for i in range(size):
        key = (key << np.uint64(8)) | data[i : i + n]
    return key


def slots(key: np.ndarray) -> np.ndarray:
    return ((key * _SPREAD) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def piece_size(n: int, most: int) -> int:
    """Code points per piece of an item of ``n``, so that two pieces at least outlast ``most``
    edits, or one if two cannot; 0 if all can be changed."""
    for left in (2, 1):
        for size in range(PIECE_BYTES, 0, -1):
            if n // size - most >= left:
                return size
    return 0


class Pieces:
    """Disjoint pieces of one size of some items: from each, its first ``size`` bytes."""

    def __init__(self, size: int, texts: dict[int, str], most: list[int]) -> None:
        self.size, self.reach = size, 0
        keys, item, point, byte = [], [], [], []
        needed = np.zeros(len(most), np.int64)
        for i, text in texts.items():
            needed[i] = len(text) // size - most[i]
            at = 0
            for j in range(len(text) // size):
                raw = text[j * size : (j + 1) * size].encode()
                keys.append(int.from_bytes(raw[:size], "big"))
                item.append(i)
                point.append(j * size)
                byte.append(at)
                at += len(raw)
            self.reach = max(self.reach, len(text.encode()) + 4 * most[i])
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys = np.array(keys, np.uint64)[order]
        self.item, self.point, self.byte = (np.array(x, np.int64)[order] for x in (item, point, byte))
        self.needed, self.most = needed, np.array(most, np.int64)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[slots(self.keys)] = True

    def places(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(documents, items, first bytes)`` where enough pieces of an item meet."""
        key = gram_keys(data, self.size)
        hits = np.flatnonzero(self.maybe[slots(key)])
        low = np.searchsorted(self.keys, key[hits], "left")
        n = np.searchsorted(self.keys, key[hits], "right") - low
        hits, low, n = hits[n > 0], low[n > 0], n[n > 0]
        if not len(hits):
            return
        # Code points before each hit, from the first one on.
        steps = np.add.reduceat((data & 0xC0) != 0x80, hits, dtype=np.int64)
        before = np.cumsum(steps) - steps
        total = np.cumsum(n)
        first = 0
        while first < len(hits):
            last = int(np.searchsorted(total, total[first] - n[first] + HITS, "right"))
            last = max(last, first + 1)
            end = int(np.searchsorted(hits, hits[last - 1] + self.reach, "right"))  # matches that begin before
            part, many = slice(first, end), n[first:end]
            of = np.repeat(low[part] - np.cumsum(many) + many, many) + np.arange(many.sum())
            at, item = np.repeat(hits[part], many), self.item[of]
            diagonal = np.repeat(before[part], many) - self.point[of]
            doc = np.searchsorted(offsets, at, "right") - 1
            order = np.lexsort((diagonal, doc, item))
            item, doc, diagonal, start = item[order], doc[order], diagonal[order], (at - self.byte[of])[order]
            later = np.arange(len(item)) + self.needed[item] - 1
            there = np.minimum(later, len(item) - 1)
            meet = (later < len(item)) & (item[there] == item) & (doc[there] == doc)
            meet &= diagonal[there] - diagonal <= self.most[item]
            yield doc[meet], item[meet], start[meet]
            first = last


class Items:
    """A block of benchmark items with the keys of their windows."""

    def __init__(self, ids: list[int], texts: list[str], edits: float = EDITS, short: int = SHORT, stride: int = STRIDE) -> None:
        self.ids = ids
        self.texts = [fold(t) for t in texts]
        self.most = [int(edits * len(t)) for t in texts]
        found = list(split_words(pa.array(texts, pa.string()), 1 << 62))
        self.words = found[0] if found else None
        self.stride, self.length, self.keys, self.phrases, self.short = stride, 0, [], {}, set()
        self.pieces: list[Pieces] = []
        if self.words is None:
            return
        counts, hashes = self.words.counts, self.words.hashes()
        begin = np.cumsum(counts) - counts
        long = np.flatnonzero(counts >= max(short, stride + 1))
        self.short = set(np.flatnonzero((counts > 0) & (counts < max(short, stride + 1))).tolist())
        for i in self.short:
            sizes = self.phrases.setdefault(int(counts[i]), {})
            key = phrase_keys(hashes[begin[i] : begin[i] + counts[i]], int(counts[i]))
            sizes.setdefault(int(key[0]), []).append(int(i))
        if not len(long):
            return
        by_size: dict[int, dict[int, str]] = {}
        for i in long.tolist():
            by_size.setdefault(piece_size(len(self.texts[i]), self.most[i]), {})[i] = self.texts[i]
        self.pieces = [Pieces(size, texts, self.most) for size, texts in sorted(by_size.items()) if size]
        self.length = int(counts[long].min()) - stride + 1
        starts = np.concatenate([np.arange(begin[i], begin[i] + counts[i] - self.length + 1) for i in long])
        for seed in range(1, repetitions() + 1):
            walk = Walk.make(self.length, seed)
            key = walk.keys(hashes, starts)
            order = np.argsort(key, kind="stable")
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[(key & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
            self.keys.append((walk, key[order], starts[order], maybe))

    def candidates(self, words: Words) -> Iterator[tuple[int, int, int, int]]:
        """``(document, item, first byte, last byte)`` where the item may lie."""
        hashes, counts = words.hashes(), words.counts
        begin = np.cumsum(counts) - counts
        for size, known in self.phrases.items():
            keys = phrase_keys(hashes, size)
            hits = np.flatnonzero(np.isin(keys, np.array(list(known), np.uint64)))
            for p in hits[words.doc[hits] == words.doc[hits + size - 1]]:
                for i in known[int(keys[p])]:
                    yield int(words.doc[p]), i, int(words.starts[p]), int(words.ends[p + size - 1])
        if not self.keys:
            return
        place = np.arange(len(hashes)) - begin[words.doc]
        starts = np.flatnonzero((place % self.stride == 0) & (counts[words.doc] - place >= self.length))
        seen = set()
        of_items = self.words.hashes()
        for walk, known, at, maybe in self.keys:
            key = walk.keys(hashes, starts)
            hits = np.flatnonzero(maybe[(key & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            low = np.searchsorted(known, key[hits], "left")
            n = np.searchsorted(known, key[hits], "right") - low
            window = np.repeat(starts[hits], n)
            of_item = at[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
            near = walk.distances(hashes, window, of_items, of_item) <= DIFFER
            window, of_item = window[near], of_item[near]
            item = self.words.doc[of_item]
            # Bytes of the item before the window, and where the item would begin.
            before = self.words.starts[of_item] - self.words.offsets[item]
            first = words.starts[window] - before
            yield from self._new(words.doc[window], item, first, seen)
        data = _LOWER_BYTES[words.data]
        for pieces in self.pieces:
            for doc, item, first in pieces.places(data, words.offsets):
                yield from self._new(doc, item, first, seen)

    def _new(self, doc: np.ndarray, item: np.ndarray, first: np.ndarray, seen: set) -> Iterator[tuple[int, int, int, int]]:
        """Candidates that begin at ``first`` or nearby, unless ``seen``."""
        for d, i, f in zip(doc.tolist(), item.tolist(), first.tolist(), strict=True):
            slack = 4 * self.most[i] + 4
            if (d, i, f // (slack + 1)) not in seen:
                seen.add((d, i, f // (slack + 1)))
                size = int(self.words.offsets[i + 1] - self.words.offsets[i])
                yield d, i, f - 2 * slack - 1, f + size + 2 * slack + 1

    def matches(self, words: Words) -> list[dict[int, int]]:
        """For each document the verified items with their edit distances."""
        found: list[dict[int, int]] = [{} for _ in range(words.n_docs)]
        for d, i, first, last in self.candidates(words):
            if found[d].get(i) == 0:
                continue
            low, high = words.offsets[d], words.offsets[d + 1]
            part = words.data[max(low, first) : min(high, last)].tobytes().decode(errors="ignore")
            most = found[d].get(i, self.most[i] + 1) - 1
            distance = within(self.texts[i], fold(part), most)
            if distance is None and i in self.short:
                distance = self.most[i]  # the same words with other white space
            if distance is not None:
                found[d][i] = distance
        return found


def phrase_keys(hashes: np.ndarray, size: int) -> np.ndarray:
    n = max(len(hashes) - size + 1, 0)
    key = np.zeros(n, np.uint64)
    for i in range(size):
        key = mix(key + hashes[i : i + n])
    return key


def _blocks(items: DataFrame, key: str, text: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """Non-null items with a word, in blocks of about ``block_bytes``."""
    rows = items.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(
        "id IS NOT NULL AND text IS NOT NULL"
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        got = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).collect()
        yield [r["id"] for r in got], [r["text"] for r in got]


def mark(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    edits: float = EDITS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``item_ids`` (ascending) and their edit ``distances``.

    Both arrays are empty for a document without a match, a null or an empty text. Items with
    a null id or text, or without a word, match nothing; repeated items count once. Columns of
    ``docs`` that bear these names are replaced.
    """
    reachable(docs.sparkSession)
    docs = docs.drop("item_ids", "distances")
    for n, (ids, texts) in enumerate(_blocks(items, item_key, item_text, block_bytes)):
        if n:
            docs = materialize(docs, "marked")
        docs = _mark_block(docs, text, Items(ids, texts, edits), first=n == 0)
    return docs


def _mark_block(docs: DataFrame, text: str, items: Items, first: bool) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)
    if first:
        docs = docs.withColumns(
            {"item_ids": F.array().cast("array<bigint>"), "distances": F.array().cast("array<int>")}
        )
    names = docs.columns
    at = [names.index(x) for x in (text, "item_ids", "distances")]

    def run(batches):
        block = held.value
        for batch in batches:
            columns = list(batch.columns)
            known = zip(batch.column(at[1]).to_pylist(), batch.column(at[2]).to_pylist(), strict=True)
            best = [dict(zip(i, d, strict=True)) for i, d in known]
            for words in split_words(batch.column(at[0])):
                for d, matched in enumerate(block.matches(words)):
                    mine = best[words.first + d]
                    for i, distance in matched.items():
                        mine[block.ids[i]] = min(distance, mine.get(block.ids[i], distance))
            ordered = [sorted(x.items()) for x in best]
            columns[at[1]] = pa.array([[i for i, _ in x] for x in ordered], pa.list_(pa.int64()))
            columns[at[2]] = pa.array([[d for _, d in x] for x in ordered], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, contaminated, n_items, item_ids, distances``."""
    marked = mark(docs.select("doc_id", "text"), items, **options)
    return marked.select(
        "doc_id",
        (F.size("item_ids") > 0).alias("contaminated"),
        F.size("item_ids").alias("n_items"),
        "item_ids",
        "distances",
    )
