"""SimHash document fingerprints and the search for near ones by permuted block tables.

Every distinct word of a text (A-Z lower-cased) votes with weight ``1 + ln tf``: its hash adds
the weight to each bit it sets and takes it from each bit it leaves. A fingerprint has 128
bits, those with a positive sum, written as 32 hexadecimal digits; likeness is the share of
equal bits. A text without words has the fingerprint 0; a null text counts as an empty one.

To find all fingerprints within ``RADIUS`` bits of some queries, the bits are cut into
``RADIUS // 2 + 1`` blocks. Two fingerprints that differ in at most ``RADIUS`` bits differ in
at most one bit of some block, so there is one table for each block, keyed by its bits, and a
query asks each table for its own block and for those with one bit changed. Equal fingerprints
are one entry with a count. The entries of a bucket come as lists of about ``LIST`` entries,
and a query has its matches inside a list, so a bucket that holds many near copies gives one
row per query and list, not one per pair. Lists and what is asked of them meet by bucket and
list in a merge join, so neither is held whole by a task or the driver.

``RADIUS`` is measured: of documents of sf0.1 (60 to 3000 words) in which 2 % of the words were
replaced, those at a five-word similarity of 0.80 to 0.84 lie within 4 bits in 15 % of the
cases, within 9 in 80 %, within 11 in 92 % and within 13 in 98 %; with 2.3 % of the words in 11, 73, 90
and 96 %. The others are beyond what this radius finds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.llm.words import mix, reachable, split_words
from seenscope.plans.materialize import materialize

BITS = 128
RADIUS = 13
LIST = 512
QUERY_EVERY = 20
BUCKETS_PER_PARTITION = 16
_SMALLEST = -(1 << 63)
_SIGNS = 2.0 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) - 1


def fingerprints(texts: pa.Array) -> np.ndarray:
    """16 bytes per text."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for words in split_words(texts):
        key = np.sort((words.doc.astype(np.uint64) << np.uint64(44)) | (words.hashes() >> np.uint64(20)))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        weight = 1 + np.log(np.diff(np.append(first, len(key))))
        term, doc = key[first], (key[first] >> np.uint64(44)).astype(np.int64)
        term &= np.uint64((1 << 44) - 1)
        halves = [mix(term * np.uint64(2) + np.uint64(i)) for i in (0, 1)]
        for byte in range(BITS // 8):
            value = (halves[byte // 8] >> np.uint64(8 * (byte % 8))) & np.uint64(255)
            votes = np.bincount(doc * 256 + value.astype(np.int64), weight, words.n_docs * 256)
            bits = votes.reshape(-1, 256) @ _SIGNS > 1e-9
            out[words.first : words.first + words.n_docs, byte] = np.packbits(bits, axis=1)[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / BITS


def _in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows ``(bucket, order, id, text, next_only)`` sorted so that each row is followed by
    the next one by id, in the same task.

    A bucket is a range of ids; the first row of every bucket is sent to the bucket before,
    too, and to the last for the very first. Bounds are approximate quantiles of the ids: at
    most ``BUCKETS_PER_PARTITION`` numbers per shuffle partition are held by a task.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = BUCKETS_PER_PARTITION * partitions
    order = F.coalesce(F.col(key).cast("long"), F.lit(_SMALLEST))
    found = docs.select(
        F.percentile_approx(order, [i / n for i in range(n)], 20 * n), F.min(order)
    ).first()
    firsts = np.unique(np.array([*(found[0] or []), *([] if found[1] is None else [found[1]])], np.int64))

    def placed(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(firsts, ids, "right") - 1
            again = np.flatnonzero(firsts[bucket] == ids)
            rows = np.concatenate([np.arange(len(ids)), again])
            where = np.concatenate([bucket, (bucket[again] - 1) % len(firsts)])
            twice = np.zeros(len(rows), bool)
            twice[len(ids) :] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(where), pa.array(twice), *(c.take(pa.array(rows)) for c in batch.columns)],
                ["bucket", "next_only", "order", "id", "text"],
            )

    reachable(spark)
    rows = docs.select(order.alias("order"), F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return (
        rows.mapInArrow(placed, "bucket LONG, next_only BOOLEAN, order LONG, id LONG, text STRING")
        .repartition(partitions, "bucket")
        .sortWithinPartitions("bucket", "next_only", "order", F.xxhash64("text"))
    )


SCHEMA = (
    "doc_id LONG, n_chars LONG, edited_sha256 STRING, fingerprint STRING, "
    "edited_fingerprint STRING, near_edited DOUBLE, near_next DOUBLE"
)


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by the beginning of ``following``."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, with its fingerprint and that of its edited text.

    The next document is the one with the next larger id, of the first id after the last; rows
    that repeat an id follow each other by a hash of their text, and rows without an id come
    first. A single document follows itself. An empty table gives an empty result.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        """All rows but the last are complete; the last is the next of the one before."""
        texts = [r[3] for r in rows]
        edited = [edit(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own, changed = fingerprints(pa.array(texts, pa.string())), fingerprints(pa.array(edited, pa.string()))
        keep = [i for i in range(len(edited)) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in keep], pa.int64()),
                pa.array([len(texts[i]) for i in keep], pa.int64()),
                pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in keep], pa.string()),
                pa.array([own[i].tobytes().hex() for i in keep], pa.string()),
                pa.array([changed[i].tobytes().hex() for i in keep], pa.string()),
                pa.array(likeness(own[:-1], changed)[keep]),
                pa.array(likeness(own[:-1], own[1:])[keep]),
            ],
            names,
        )

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "next_only", "id", "text")), strict=True):
                held.append(row)
                size += len(row[3])
                if size > 1 << 20 and len(held) > 1:
                    yield finish(held)
                    held = held[-1:]
                    size = len(held[0][3])
        if len(held) > 1:
            yield finish(held)

    return _in_order(docs, key, text).mapInArrow(run, SCHEMA)


def _blocks(n: int) -> list[int]:
    """Masks of the blocks, as 128-bit numbers."""
    at = [BITS * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(at, at[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _halves(x: int) -> tuple[int, int]:
    return _signed(x >> 64), _signed(x & (1 << 64) - 1)


def _half(column: str, i: int) -> Column:
    digits = F.substring(column, 16 * i + 1, 16)
    # conv() reads unsigned numbers; the upper half of them becomes negative.
    top = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return F.shiftleft(top, 32).bitwiseOR(low)


def _digits(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def near_lists(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fingerprint, near)``: the fingerprints of ``prints`` within ``radius`` bits of each
    fingerprint of ``queries``, as arrays of ``(fingerprint, distance, n)`` with the number of
    rows that have it.

    A query has any number of rows; a match is in one of them only. A query finds itself if it
    is one of ``prints``; null fingerprints match nothing. Exact: every table is searched, and
    a match counts in its first table only.
    """
    blocks = _blocks(radius // 2 + 1)
    tables = [_halves(m) for m in blocks]
    probes = [
        (t, *tables[t], *_halves(flip))
        for t, m in enumerate(blocks)
        for flip in (0, *(1 << i for i in range(BITS) if radius and m >> i & 1))
    ]

    partitions = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def halves(df: DataFrame) -> DataFrame:
        return df.where("fingerprint IS NOT NULL").select(
            _half("fingerprint", 0).alias("high"), _half("fingerprint", 1).alias("low")
        )

    def spread(df: DataFrame) -> DataFrame:
        """Each row becomes many, so few rows must not end up in one task."""
        return df.repartition(partitions, "high", "low")

    def structs(rows: list[tuple], *names: str) -> Column:
        return F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names, strict=True)]) for r in rows])

    def bucket(table: Column, high: Column, low: Column) -> Column:
        return F.xxhash64(table, high, low).alias("bucket")

    of_block = lambda x, m: F.col(x).bitwiseAND(m)
    keys = [bucket(F.lit(t), of_block("high", F.lit(a)), of_block("low", F.lit(b))) for t, (a, b) in enumerate(tables)]
    entries = materialize(spread(halves(prints).groupBy("high", "low").agg(F.count("*").alias("n"))), "entries")
    entries = entries.select("*", F.explode(F.array(*keys)).alias("bucket"))
    large = entries.groupBy("bucket").agg(F.count("*").alias("size")).where(f"size > {LIST}")
    large = materialize(large.select("bucket", F.ceil(F.col("size") / LIST).alias("parts")), "large-buckets")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    lists = (
        entries.join(large, "bucket", "left")
        .groupBy("bucket", F.pmod(F.xxhash64("high", "low"), parts).alias("part"))
        .agg(F.collect_list(F.struct("high", "low", "n")).alias("entries"))
    )
    # Which probe it is travels in place of the probe.
    every = structs(probes, "table", "a", "b", "c", "d")
    at = F.explode(F.sequence(F.lit(0), F.lit(len(probes) - 1))).alias("at")
    asked = spread(halves(queries).distinct()).select("high", "low", at).withColumn("probe", F.get(every, F.col("at")))
    asked = asked.select(
        "high", "low", "at",
        bucket(
            F.col("probe.table"),
            of_block("high", F.col("probe.a")).bitwiseXOR(F.col("probe.c")),
            of_block("low", F.col("probe.b")).bitwiseXOR(F.col("probe.d")),
        ),
    )
    asked = asked.join(large, "bucket", "left").select(
        "high", "low", "at", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part")
    )
    masks = structs(tables, "a", "b")

    def bits(e: Column) -> tuple[Column, Column]:
        return F.col("high").bitwiseXOR(e["high"]), F.col("low").bitwiseXOR(e["low"])

    def matches(e: Column) -> Column:
        x, y = bits(e)
        near = F.bit_count(x) + F.bit_count(y) <= radius
        here = (x.bitwiseAND(F.col("probe.a")) == F.col("probe.c")) & (y.bitwiseAND(F.col("probe.b")) == F.col("probe.d"))
        earlier = F.exists(
            F.slice(masks, 1, F.col("probe.table")),
            lambda m: F.bit_count(x.bitwiseAND(m["a"])) + F.bit_count(y.bitwiseAND(m["b"])) <= min(radius, 1),
        )
        return near & here & ~earlier

    def found(e: Column) -> Column:
        x, y = bits(e)
        distance = (F.bit_count(x) + F.bit_count(y)).alias("distance")
        return F.struct(_digits(e["high"], e["low"]).alias("fingerprint"), distance, e["n"].alias("n"))

    # Spark's estimates leave out that a query has many probes, so it would broadcast them all.
    near = asked.hint("merge").join(lists, ["bucket", "part"]).withColumn("probe", F.get(every, F.col("at")))
    near = near.select("high", "low", F.filter("entries", matches).alias("near"))
    return near.where(F.size("near") > 0).select(
        _digits(F.col("high"), F.col("low")).alias("fingerprint"), F.transform("near", found).alias("near")
    )


def near_counts(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fingerprint, n_near)``: for each fingerprint of ``queries`` the rows of ``prints``
    within ``radius`` bits, itself included if it is one of them; those without any are left
    out."""
    n = F.aggregate("near", F.lit(0).cast("long"), lambda s, e: s + e["n"])
    return near_lists(prints, queries, radius).groupBy("fingerprint").agg(F.sum(n).alias("n_near"))


def near_prints(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(query_id, fingerprint, distance)``: which fingerprints of ``prints`` are near those of
    the rows of ``queries``, its own among them. The documents are those that ``members`` gives
    for a fingerprint. Both tables are ``(doc_id, fingerprint)``."""
    found = near_lists(prints, queries, radius)
    asked = queries.select(F.col("doc_id").alias("query_id"), "fingerprint")
    return asked.join(found, "fingerprint").select("query_id", F.inline("near").alias("fingerprint", "distance", "n")).drop("n")


def members(prints: DataFrame) -> DataFrame:
    """``(fingerprint, doc_id)`` for all rows with a fingerprint: who is equal."""
    return prints.where("fingerprint IS NOT NULL").select("fingerprint", "doc_id")


def with_near_counts(prints: DataFrame, every: int = QUERY_EVERY) -> DataFrame:
    """``prints`` with ``n_near``: for rows whose ``doc_id`` is divisible by ``every`` the
    number of other rows within the radius, null for the others."""
    prints = materialize(prints, "fingerprints")
    is_query = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    queries = prints.where(is_query)
    counts = materialize(near_counts(prints.select("fingerprint"), queries.select("fingerprint")), "near")
    found = queries.join(counts, "fingerprint").select(*prints.columns, (F.col("n_near") - 1).alias("n_near"))
    rest = prints.where(~is_query).withColumn("n_near", F.lit(None).cast("long"))
    return found.unionByName(rest)
