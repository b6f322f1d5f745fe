"""Near duplicates by DartMinHash signatures of word shingles.

A document is a weighted set: its shingles of five words, lower case for A-Z, weighted by
their number of occurrences. Darts are thrown at the quarter plane of every element: unit
cells of weight x rank hold a Poisson(1) number of darts, each with a rank, a weight and a
coordinate, all hashed from the element and the cell, so that every document sees the same
darts. A document keeps the darts below its weights; the earliest one per coordinate is its
signature. Two documents agree on a coordinate with the probability of their weighted
Jaccard similarity. The work is in proportion to the total weight plus ``k ln k``.

Signatures are cut into bands. Documents that share a band are candidates; a candidate pair
is linked if the exact weighted similarity of its shingles reaches the limit. Classes are the
connected components of the links.

Texts, not ids, are what is compared: copies count once, and rows that repeat an id keep
their own texts. The node of a text is its smallest id; only where several texts share that
id, a 64-bit hash of id and digest, as numbers take less to shuffle than digests.

Hot buckets: no pairs are formed inside a bucket at first. Each text is compared with one
pivot only, the text that meets most others in all their buckets, then with further pivots in
buckets that still hold several classes. Where pivots leave a bucket divided, its members are
joined by the rarest of their shingles: two sets at the limit share one of the first few in
the order of their frequency among the members, and at places that leave room for the
required overlap. A copy whose own edits take it below the limit to the original has nothing
but shingles of its own there, so a group of such copies forms no pairs, while no pair at the
limit is lost. Pairs already in one class need no comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.llm.components import components
from seenscope.llm.words import Words, mix, reachable, split_words
from seenscope.plans.joins import key_filter, split_by_filter
from seenscope.plans.materialize import materialize

SHINGLE = 5
SIMILARITY = 0.8
# Two documents at the limit share a band with probability 0.9994; at a similarity of 0.3, as
# from a common passage, with 0.0026, so buckets hold near duplicates and little else.
BANDS = 40
ROWS = 8
ESTIMATED = 128  # coordinates kept, one byte of each, to estimate a similarity
# Which member of a bucket's largest class the others are compared with.
PICKS = ("central", "last")
# Sets are joined by classes of their size, each this much wider than the one before.
SIZE_STEP = 1.02
# A pair whose signatures agree on less than this share is not fetched: at the similarity
# limit it lies six standard deviations below the expected share.
LEAST_ESTIMATE = 0.59

_ELEMENT_BITS = 48
_MASK = np.uint64((1 << _ELEMENT_BITS) - 1)
# Upper ends of the counts 0, 1, 2, ... of a Poisson(1) variable.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 17.0)])))


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, element)`` per occurrence; a text of fewer words is one shingle."""
    h, doc = words.hashes(), words.doc
    counts = words.counts
    n = len(h) - size + 1
    found = np.zeros(max(n, 0), np.uint64)
    for i in range(size if n > 0 else 0):
        found = found * np.uint64(0xD1342543DE82EF95) + h[i : i + n]
    whole = doc[:n] == doc[size - 1 :] if n > 0 else np.zeros(0, bool)
    found, of = mix(found)[whole], doc[: max(n, 0)][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        begin = np.cumsum(counts) - counts
        extra = []
        for d in short:
            x = counts[d : d + 1].astype(np.uint64)
            for i in range(begin[d], begin[d] + counts[d]):
                x = mix(x ^ h[i : i + 1])
            extra.append(x)
        found, of = np.concatenate([found, *extra]), np.concatenate([of, short])
    return of, found & _MASK


def weighted(doc: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, element, weight)``, sorted, with the number of occurrences as weight."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(_ELEMENT_BITS)) | element)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    weight = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(_ELEMENT_BITS)).astype(np.int64), key & _MASK, weight.astype(float)


def signatures(
    n_docs: int, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, k: int, seed: int = 1
) -> np.ndarray:
    """DartMinHash: an ``n_docs`` x ``k`` array of 64-bit values; 0 for a set without weight."""
    out = np.full((n_docs, k), np.iinfo(np.uint64).max, np.uint64)
    total = np.bincount(doc, weight, n_docs)
    darts = np.full(n_docs, k * (np.log(k) + 2.0))
    todo = total > 0
    while todo.any():
        mine = np.flatnonzero(todo[doc])
        limit = darts / np.maximum(total, 1e-300)  # highest rank, by document
        _throw(out, doc[mine], element[mine], weight[mine], limit, k, seed)
        # A coordinate that no dart hit: throw twice as many.
        todo &= (out == np.iinfo(np.uint64).max).any(axis=1)
        darts[todo] *= 2
    out[total <= 0] = 0
    return out


def _throw(out, doc, element, weight, limit, k, seed, max_cells: int = 1 << 19) -> None:
    """Throw the darts below ``limit`` and keep the earliest per document and coordinate."""
    wide = np.ceil(weight).astype(np.int64)
    cells = wide * np.ceil(limit[doc]).astype(np.int64)
    ends = np.cumsum(cells)
    first = 0
    while first < len(cells):  # a part of the cells at a time
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + max_cells, "right")))
        one = np.repeat(np.arange(first, last), cells[first:last])
        at = np.arange(len(one)) - np.repeat(ends[first:last] - cells[first:last] - base, cells[first:last])
        column, row = at % wide[one], at // wide[one]
        cell = mix(
            element[one]
            + np.uint64(seed) * np.uint64(0xA0761D6478BD642F)
            + row.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
            + column.astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)
        )
        hits = np.searchsorted(_POISSON, (cell >> np.uint64(11)).astype(float) * 2.0**-53, "right")
        of = np.repeat(np.arange(len(one)), hits)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(hits) - hits, hits)
        dart = mix(cell[of] + (nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        rank = row[of] + (dart & np.uint64(0xFFFFFF)).astype(float) * 2.0**-24
        height = column[of] + ((dart >> np.uint64(24)) & np.uint64(0xFFFF)).astype(float) * 2.0**-16
        d = doc[one[of]]
        keep = (rank < limit[d]) & (height < weight[one[of]])
        d, dart, rank = d[keep], dart[keep], rank[keep]
        coordinate = ((dart >> np.uint64(40)) * np.uint64(k) >> np.uint64(24)).astype(np.int64)
        # Ranks order the darts; the low bits tell apart darts of nearly equal rank.
        packed = (np.minimum(rank * 2.0**20, 2.0**40 - 1).astype(np.uint64) << np.uint64(24)) | (mix(dart) >> np.uint64(40))
        np.minimum.at(out.reshape(-1), d * k + coordinate, packed)
        first = last


def _signed(texts: pa.Array, bands: int, rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, one byte of some coordinates, band keys)`` for some texts at a time."""
    kept = min(ESTIMATED, bands * rows // 8 * 8)
    for words in split_words(texts):
        doc, element, weight = weighted(*shingles(words))
        found = signatures(words.n_docs, doc, element, weight, bands * rows)
        keys = np.zeros((words.n_docs, bands), np.uint64)
        for r in range(rows):
            keys = mix(keys + found[:, r::rows] + np.uint64(r + 1))
        keys = mix(keys + np.arange(1, bands + 1, dtype=np.uint64))
        keys[words.counts == 0] = 0
        low = (found[:, :kept] & np.uint64(255)).astype(np.uint8)
        yield words.first, np.ascontiguousarray(low).view(np.int64), keys.view(np.int64)


def digest(text: str) -> Column:
    """What a text is known by: 16 bytes; a null text counts as an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def sign(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(id, same, signature, bands)`` per row; ``same`` is the digest of the text. Texts
    without a word have neither signature nor bands (null)."""

    def run(batches):
        for batch in batches:
            for first, found, keys in _signed(batch.column(2), bands, rows):
                n = len(keys)
                empty = pa.array((keys == 0).all(axis=1))
                lists = [
                    pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1])
                    .cast(pa.list_(pa.from_numpy_dtype(x.dtype)))
                    for x in (found, keys)
                ]
                lists = [pa.compute.if_else(empty, pa.scalar(None, x.type), x) for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), *lists],
                    ["id", "same", "signature", "bands"],
                )

    reachable(docs.sparkSession)
    rows_in = docs.select(F.col(key).cast("long").alias("id"), digest(text).alias("same"), F.col(text).alias("text"))
    return rows_in.mapInArrow(run, "id LONG, same BINARY, signature ARRAY<LONG>, bands ARRAY<LONG>")


def similarity(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingles of each pair of texts; two texts
    without words are equal."""

    def sets(texts):
        for words in split_words(texts):
            doc, element, weight = weighted(*shingles(words))
            bounds = np.searchsorted(doc, np.arange(words.n_docs + 1))
            for i in range(words.n_docs):
                yield element[bounds[i] : bounds[i + 1]], weight[bounds[i] : bounds[i + 1]]

    out = []
    for (x, wx), (y, wy) in zip(sets(a), sets(b), strict=True):
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        both = np.minimum(wx[i], wy[j]).sum()
        union = wx.sum() + wy.sum() - both
        out.append(both / union if union else 1.0)
    return np.array(out)


def _agreement(a: Column, b: Column) -> Column:
    """Share of equal bytes of two arrays of longs."""

    def different(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (4, 2, 1):  # the lowest bit of each byte: is any bit of it set?
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    unequal = F.aggregate(F.zip_with(a, b, different), F.lit(0), lambda s, x: s + x)
    return 1 - unequal / (8 * F.size(a))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose exact similarity is at least ``least``."""

    def run(batches):
        for batch in batches:
            keep = similarity(batch.column(2), batch.column(3)) >= least
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"]
            )

    both = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    return both.mapInArrow(run, "a LONG, b LONG")


def _divided(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """``(bucket, node, label, largest, central, last)`` of the buckets that hold several
    classes, with the largest class and its central and last text."""
    labelled = materialize(
        buckets.join(labels, "node", "left").select(
            "bucket", "node", "degree", F.coalesce("label", "node").alias("label")
        ),
        "labelled",
    )
    classes = labelled.groupBy("bucket", "label").agg(
        F.count("*").alias("n"),
        F.max("node").alias("last"),
        F.max_by("node", F.struct("degree", "node")).alias("central"),
    )
    size = F.struct("n", "label")
    divided = materialize(
        classes.groupBy("bucket")
        .agg(
            F.count("*").alias("classes"),
            *[F.max_by(x, size).alias(name) for x, name in (("label", "largest"), ("central", "central"), ("last", "last"))],
        )
        .where("classes > 1"),
        "divided",
    )
    return labelled.join(divided, "bucket").select("bucket", "node", "label", "largest", "central", "last")


def _pivot_pairs(divided: DataFrame, pick: str) -> DataFrame:
    """Members outside the largest class of a bucket with a pivot of that class."""
    return divided.where("label != largest").select(
        F.least(pick, "node").alias("a"), F.greatest(pick, "node").alias("b")
    )


def _elements(texts: DataFrame) -> DataFrame:
    """``(node, size, elements)``: the shingles of a text, each occurrence an element."""

    def run(batches):
        for batch in batches:
            for words in split_words(batch.column(1)):
                doc, element, weight = weighted(*shingles(words))
                times = weight.astype(np.int64)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                of = np.repeat(doc, times)
                every = mix(np.repeat(element, times) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                size = np.bincount(of, minlength=words.n_docs)
                offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(every.view(np.int64)))
                nodes = batch.column(0).slice(words.first, words.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [nodes, pa.array(size.astype(np.int64)), lists.cast(pa.list_(pa.int64()))],
                    ["node", "size", "elements"],
                )

    return texts.select("node", "text").mapInArrow(run, "node LONG, size LONG, elements ARRAY<LONG>")


def _size_class(size: Column) -> Column:
    return F.floor(F.log(size) / float(np.log(SIZE_STEP)))


def _rare_pairs(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs of ``members(node, label)`` of different classes that may reach ``least``.

    Elements are ordered by their frequency among the members. Of two sets at the limit,
    the first common element stands in the smaller set before all but ``2t/(1+t)`` of it, in
    the larger one of size ``s`` before all but ``t/(1+t)`` of both sizes. The smaller one is
    filed by its size class, so the larger one looks no deeper than each class needs.
    Elements of one member only take up places and are joined with nothing.
    """
    share = least / (1 + least)
    listed = materialize(_elements(texts.join(members, "node", "left_semi")), "elements")
    each = listed.select("node", "size", F.explode("elements").alias("element"))
    shared = each.groupBy("element").agg(F.count("*").alias("n")).where("n > 1")
    known = each.join(shared, "element").groupBy("node", "size")
    known = known.agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("shared"))
    own = F.col("size") - F.size("shared")
    deepest = F.floor(F.col("size") * (1 - least) + 1e-6) + 1
    placed = materialize(
        known.where(own < deepest)
        .join(members, "node")
        .select(
            "node",
            "label",
            "size",
            own.alias("own"),
            F.posexplode(F.slice("shared", 1, (deepest - own).cast("int"))).alias("i", "at"),
        )
        .select("node", "label", "size", (F.col("own") + F.col("i") + 1).alias("place"), "at.element"),
        "places",
    )

    def side(rows: DataFrame, end: str) -> DataFrame:
        names = [F.col(c).alias(f"{c}_{end}") for c in ("node", "label", "size", "place")]
        return rows.select("element", "class", *names)

    size, place = F.col("size"), F.col("place")
    filed = placed.where(place <= size * (1 - 2 * share) + 1 + 1e-6).withColumn("class", _size_class(size))
    asked = placed.withColumn(
        "class", F.explode(F.sequence(_size_class(size * (least - 1e-9)), _size_class(size)))
    )
    smallest = F.greatest(F.pow(F.lit(SIZE_STEP), F.col("class")), size * least)
    asked = asked.where(place <= size + 1 + 1e-6 - share * (size + smallest))
    room = F.least(F.expr("size_a - place_a"), F.expr("size_b - place_b")) + 1
    return (
        side(filed, "a")
        .join(side(asked, "b"), ["element", "class"])
        .where("label_a != label_b AND struct(size_a, node_a) < struct(size_b, node_b)")
        .where(room + 1e-6 >= share * F.expr("size_a + size_b"))
        .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    )


def _promising(pairs: DataFrame, tried: DataFrame, candidates: DataFrame) -> DataFrame:
    """The pairs not tried before that share a band and whose signatures agree well enough
    to fetch the texts."""

    def side(end: str) -> DataFrame:
        return candidates.select(*[F.col(c).alias(f"{c}_{end}") for c in ("node", "signature", "bands")]).withColumnRenamed(f"node_{end}", end)

    alike = _agreement(F.col("signature_a"), F.col("signature_b")) >= LEAST_ESTIMATE
    return (
        pairs.distinct()
        .join(tried, ["a", "b"], "left_anti")
        .join(side("a"), "a")
        .join(side("b"), "b")
        .where(alike & F.arrays_overlap("bands_a", "bands_b"))
        .select("a", "b")
    )


def _numbered(signed: DataFrame) -> DataFrame:
    """``(same, first, node)`` per text: its digest, smallest id and node."""
    copies = materialize(signed.groupBy("same").agg(F.min("id").alias("first")), "firsts")
    several = copies.groupBy("first").agg(F.count("*").alias("n")).where("n > 1")
    node = F.when(F.col("n").isNull(), F.col("first")).otherwise(F.xxhash64("first", "same"))
    return copies.join(materialize(several, "several"), "first", "left").select("same", "first", node.alias("node"))


def classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``(doc_id, digest, class_id, kept)`` per input row with an id.

    ``class_id`` is the smallest id among the texts linked to this one, directly or through
    others; equal texts are always in one class. ``kept`` marks the text of a class that
    stands for it, at its smallest id: the text with that id, one of them if several are linked.
    A null text counts as an empty one, and texts without words are near duplicates of equal
    texts only. Rows with a null id are left out. Rows that repeat an id are judged by their
    own texts: equal ones are given back once each, different ones are linked only if alike,
    and two classes may then report one id. An empty table gives an empty result; further
    columns are ignored.
    """
    docs = docs.where(F.col(key).isNotNull())
    signed = materialize(sign(docs, key, text, bands, rows), "signatures")
    copies = materialize(_numbered(signed), "copies")
    # One row per text.
    firsts = signed.join(copies.withColumnRenamed("first", "id"), ["same", "id"])
    reps = materialize(firsts.dropDuplicates(["node"]).select("node", "signature", "bands"), "reps")
    placed = reps.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(placed.join(shared, "bucket"), "buckets")
    # How many others a text meets in all its buckets: of copies edited each in another
    # way, the original meets most.
    degrees = materialize(met.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree")), "degrees")
    met = met.select("bucket", "node").join(degrees, "node")
    central = met.groupBy("bucket").agg(
        F.max_by("node", F.struct("degree", "node")).alias("pivot"), F.max("degree").alias("reach")
    )
    buckets = materialize(met.join(central, "bucket"), "met")
    candidates = materialize(reps.join(degrees, "node", "left_semi"), "candidates")
    # Copies have one text: that of the first id is read.
    wanted = materialize(candidates.select("node").join(copies, "node"), "wanted")
    # Only texts of candidates are shuffled, and few others whose ids share a bit with theirs.
    every = docs.select(F.col(key).cast("long").alias("first"), F.col(text).alias("text"))
    fetched, _ = split_by_filter(every, key_filter(wanted, ["first"]), ["first"])
    texts = materialize(
        fetched.join(wanted, "first")
        .where(digest("text") == F.col("same"))
        .dropDuplicates(["node"])
        .select("node", "text"),
        "candidate-texts",
    )
    best = buckets.groupBy("node").agg(F.max_by("pivot", F.struct("reach", "pivot")).alias("pivot"))
    first = best.where("node != pivot").select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")
    )
    tried = materialize(first.distinct(), "first-pairs")
    links = materialize(_verified(tried, texts, least), "links")
    labels = components(links)
    for pick in (*PICKS, None):
        divided = _divided(buckets, labels)
        if pick is None:
            members = materialize(divided.select("node", "label").distinct(), "members")
            found = _rare_pairs(members, texts, least)
        else:
            found = _pivot_pairs(divided, pick)
        pairs = materialize(_promising(found, tried, candidates), "pairs")
        more = materialize(_verified(pairs, texts, least), "more-links")
        tried = tried.union(pairs)
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links)
    # The smallest id of a class, and the text at it.
    place = F.min(F.struct("first", "node")).alias("least")
    named = labels.join(copies, "node").groupBy("label").agg(place)
    linked = labels.join(named, "label").select("node", "least")
    known = copies.join(linked, "node", "left").select(
        "same", "node", "first", F.coalesce("least", F.struct("first", "node")).alias("least")
    )
    return signed.select("id", "same").join(materialize(known, "classes"), "same").select(
        F.col("id").alias("doc_id"),
        F.col("same").alias("digest"),
        F.col("least.first").alias("class_id"),
        ((F.col("least.node") == F.col("node")) & (F.col("id") == F.col("first"))).alias("kept"),
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, class_id)`` per input row, as in ``classes``."""
    return classes(docs, key, text, least, bands, rows).select("doc_id", "class_id")
