"""Word vectors from the language model's pair counts: PPMI and a randomised SVD.

The matrix has a row per first word and a column per second word of the fitted pairs, with

    ppmi(u, t) = max(0, ln(c(u, t) * N / (c(u) * c(t))))

and is only ever a table of its positive cells. Its leading right singular directions come
from block power iteration: a block of ``dim`` columns, started from hashes of the words, is
multiplied by the matrix and by its transpose in turn and made orthogonal in between. A
multiplication is one join of cells with the block and one sum by word; only the ``dim * dim``
inner products of the block's columns reach the driver, which turns them into the step that
makes the columns orthogonal.

A word's vector is its row of the right singular block, each direction weighted by the root of
its singular value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.operators.language_model import START
from seenscope.plans.joins import lookup_join
from seenscope.plans.materialize import materialize
from seenscope.plans.ordering import order_key

DIM = 16
# Multiplications by the matrix and its transpose.
TURNS = 3
# A column that keeps less than this share of its squared length depends on those before it.
LEAST_SHARE = 1e-12


def ppmi(pairs: DataFrame) -> DataFrame:
    """``(prev, tok, value)``: the positive cells of fitted pairs ``(prev, tok, c_pair)``."""
    inner = pairs.where(F.col("prev") != START).select("prev", "tok", "c_pair")
    by_prev = inner.groupBy("prev").agg(F.sum("c_pair").alias("c_prev"), F.count("*").alias("uses"))
    by_tok = inner.groupBy("tok").agg(F.sum("c_pair").alias("c_tok"), F.count("*").alias("uses"))
    total = inner.agg(F.sum("c_pair")).scalar()
    counted = lookup_join(
        lookup_join(inner, materialize(by_prev, "first-words"), ["prev"]), materialize(by_tok, "second-words"), ["tok"]
    )
    ratio = F.col("c_pair") * total.cast("double") / (F.col("c_prev").cast("double") * F.col("c_tok"))
    return counted.select("prev", "tok", F.log(ratio).alias("value")).where("value > 0")


def _names(dim: int) -> list[str]:
    return [f"x{i}" for i in range(dim)]


def start(word: str, i: int) -> Column:
    """Column ``i`` of the first block: numbers from -1 to 1, from an md5 of the word."""
    digits = F.substring(order_key(f"start-{i // 8}", word), 4 * (i % 8) + 1, 4)
    return F.conv(digits, 16, 10).cast("double") / 32768 - 1


def orthogonal(products: np.ndarray) -> np.ndarray:
    """The matrix that makes columns with these inner products orthogonal and of length 1, one
    after the other; a column that depends on those before it becomes zero."""
    n = len(products)
    step = np.zeros((n, n))
    for j in range(n):
        column = np.zeros(n)
        column[j] = 1
        for _ in range(2):  # the second time takes off what rounding left
            column -= step[:, :j] @ (step[:, :j].T @ products @ column)
        length = column @ products @ column
        if length > LEAST_SHARE * products[j, j] and length > 0:
            step[:, j] = column / np.sqrt(length)
    return step


def _products(block: DataFrame, names: list[str]) -> np.ndarray:
    places = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    found = block.agg(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in places]).first()
    products = np.zeros((len(names), len(names)))
    for (i, j), value in zip(places, found, strict=True):
        products[i, j] = products[j, i] = value or 0.0
    return products


def _changed(block: DataFrame, key: str, names: list[str], step: np.ndarray) -> DataFrame:
    def column(j: int) -> Column:
        terms = [F.col(n) * F.lit(float(step[i, j])) for i, n in enumerate(names)]
        return sum(terms[1:], terms[0])

    return block.select(key, *[column(j).alias(n) for j, n in enumerate(names)])


def _multiplied(cells: DataFrame, block: DataFrame, uses: DataFrame, by: str, to: str, names: list[str]) -> DataFrame:
    """The block, keyed by ``by``, multiplied by the matrix: one row per word of ``to``."""
    joined = lookup_join(cells, block.join(uses, by), [by])
    return materialize(
        joined.groupBy(to).agg(*[F.sum(F.col("value") * F.col(n)).alias(n) for n in names]), f"block-{to}"
    )


def fit(pairs: DataFrame, dim: int = DIM, turns: int = TURNS) -> DataFrame:
    """``(word, vector)`` for each second word with a positive cell, written.

    ``pairs`` are those of a fitted model. A model of so few words that the matrix has fewer
    than ``dim`` directions has zeros for the rest; without pairs the result is empty.
    """
    names = _names(dim)
    cells = materialize(ppmi(pairs), "ppmi")
    by_tok = materialize(cells.groupBy("tok").agg(F.count("*").alias("uses")), "cells-of-words")
    by_prev = materialize(cells.groupBy("prev").agg(F.count("*").alias("uses")), "cells-of-words")
    right = by_tok.select("tok", *[start("tok", i).alias(n) for i, n in enumerate(names)])
    for turn in range(turns):
        if turn:
            right = _changed(right, "tok", names, orthogonal(_products(right, names)))
        left = _multiplied(cells, right, by_tok, "tok", "prev", names)
        left = _changed(left, "prev", names, orthogonal(_products(left, names)))
        right = _multiplied(cells, left, by_prev, "prev", "tok", names)
    # The length of a column is its singular value; its root is what the vectors keep of it.
    lengths = np.sqrt(np.diag(_products(right, names)))
    roots = [1 / np.sqrt(s) if s > 0 else 0.0 for s in lengths]
    vector = F.array(*[F.col(n) * F.lit(float(r)) for n, r in zip(names, roots, strict=True)])
    return materialize(right.select(F.col("tok").alias("word"), vector.alias("vector")), "word-vectors")


def with_vectors(rows: DataFrame, word: str, vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """Add the ``vector`` of each row's word; a word without one, or none, has zeros."""
    # Both uses below would else find the words anew.
    rows = materialize(rows, "words")
    uses = rows.where(F.col(word).isNotNull()).groupBy(word).agg(F.count("*").alias("uses"))
    lookup = materialize(vectors.withColumnRenamed("word", word).join(uses, word), "wanted-vectors")
    zeros = F.array(*[F.lit(0.0)] * dim)
    return lookup_join(rows, lookup, [word]).withColumn("vector", F.coalesce("vector", zeros))
