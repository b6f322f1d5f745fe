"""Words and their 64-bit hashes, found for many texts at once.

A word is a run of bytes other than space and the control characters 9 to 13 of a UTF-8
text. Its hash is a polynomial over the bytes, taken from prefix sums, so that no Python
object is made per word. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package although it is not installed."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        environment["PYTHONPATH"] = f"{root}:{known}" if known else root


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower:
        values[65:91] = values[97:123]
    return values


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base`` to the power of 0 to n - 1; the longest asked for so far is kept."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(n, base, np.uint64)
        known[:1] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = known
    return known[:n]


@dataclass
class Words:
    """The words of the texts ``first`` to ``first + n_docs - 1`` of a batch."""

    first: int
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # where each text starts and the last ends
    starts: np.ndarray  # of each word
    ends: np.ndarray
    doc: np.ndarray  # index of each word's text, from 0

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        """Number of words of each text."""
        return np.bincount(self.doc, minlength=self.n_docs)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """One hash per word; with ``lower``, A-Z count as a-z."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_values(lower)[self.data] * _power(_BASE, n), out=sums[1:])
        found = (sums[self.ends] - sums[self.starts]) * _power(_INVERSE, n + 1)[self.starts]
        return mix(found + (self.ends - self.starts).astype(np.uint64))

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's offset; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``max_bytes``, or of one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def find_words(data: np.ndarray, offsets: np.ndarray, first: int = 0) -> Words:
    solid = ~SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    before = np.zeros(len(data), bool)  # does the byte before belong to the same word?
    before[1:] = solid[:-1]
    before &= ~begins[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:] & ~begins[1:-1]
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    return Words(first, data, offsets, starts, ends, doc)


def split_words(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a batch of texts, some texts at a time; covers every text once."""
    data, offsets = text_bytes(texts)
    for first, last in pieces(offsets, max_bytes):
        at = offsets[first : last + 1]
        yield find_words(data[at[0] : at[-1]], at - at[0], first)
