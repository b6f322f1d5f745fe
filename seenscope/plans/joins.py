"""Joins for keys that may be null and for keys that may be hot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.plans.materialize import materialize

# A key is hot if it holds more than 1/20,000 of the rows, so fewer than 20,000 keys are.
MAX_HOT_KEYS = 20_000
# A key filter has so many bits, 8 MB, whatever the number of keys; a bitmap holds 2^15 of them.
FILTER_BITS = 26
BITMAP_BITS = 15


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which a null key matches a null key; keys are taken from ``left``."""
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = reduce(
        Column.__and__, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    )
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*renamed.columns[: len(keys)])


def slot(*columns: Column) -> Column:
    """One key in place of several, any of which may be null: a digest of their values.

    Rows dealt by it once serve a window over these columns and an equi-join on them, which
    null-safe keys, dealt by other expressions, do not.
    """
    return F.md5(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])))


def _hot(lookup: DataFrame, keys: list[str], max_hot: int) -> DataFrame:
    """``(_digest, _salts)`` of the keys with more than 1/``max_hot`` of the rows.

    A key gets one salt per 1/``max_hot`` of the rows it holds, so there are at most
    ``2 * max_hot`` salts in all, of fixed width whatever the keys are.
    """
    total = lookup.agg(F.sum("uses")).scalar()
    share = F.col("uses") * F.lit(max_hot) / total
    hot = lookup.where(share > 1).select(
        F.xxhash64(*keys).alias("_digest"), F.ceil(share).cast("int").alias("_salts")
    )
    # Two keys of one digest are salted alike.
    return hot.groupBy("_digest").agg(F.max("_salts").alias("_salts"))


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    max_hot: int = MAX_HOT_KEYS,
    how: str = "left",
) -> DataFrame:
    """Join with a table that has one row per non-null key and a count ``uses`` of the rows
    expected to need it; ``rows`` is read once, and values are null for a key not there.

    Rows of hot keys are spread over salts by a hash of the whole row, and the lookup row of
    a hot key is repeated for each of its salts, so no key sends much more than
    1/``max_hot`` of the rows to one task. What is broadcast are digests of hot keys with
    their number of salts: fewer than ``max_hot`` pairs of numbers.
    """
    values = [c for c in lookup.columns if c not in keys and c != "uses"]
    hot = F.broadcast(_hot(lookup, keys, max_hot))
    salts = F.coalesce("_salts", F.lit(1))
    salted = (
        rows.withColumn("_digest", F.xxhash64(*keys))
        .join(hot, "_digest", "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int"))
    )
    repeated = (
        lookup.withColumn("_digest", F.xxhash64(*keys))
        .join(hot, "_digest", "left")
        .select(*keys, *values, F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    )
    return salted.join(repeated, [*keys, "_salt"], how).select(*rows.columns, *values)


def _bit(keys: list[str | Column]) -> tuple[Column, Column]:
    """The bitmap of a filter that a key belongs to, and its bit there."""
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << FILTER_BITS))
    return F.shiftright(place, BITMAP_BITS).cast("int"), place.bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))


def key_filter(table: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Bitmaps ``(_map, _bits)`` of the hashes of a table's keys, written: at most 8 MB for any
    number of keys. A null is a key like any other."""
    bitmap, bit = _bit(keys)
    places = table.select(bitmap.alias("_map"), bit.alias("_bit")).repartition("_map")
    return materialize(places.groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "key-filter")


def split_by_filter(
    rows: DataFrame, found: DataFrame, keys: list[str | Column]
) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be in the table of a :func:`key_filter`, and those whose key is
    not there. Neither is shuffled for it, so that a join of wide rows with a table few of them
    meet shuffles the first part only. Keys need the types they have in the table. The more
    keys, the more rows are in the first part in vain; no key of the table is in the second."""
    bitmap, bit = _bit(keys)
    marked = rows.withColumns({"_map": bitmap, "_bit": bit}).join(F.broadcast(found), "_map", "left")
    octet = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3).cast("int") + 1, F.lit(1))), 16, 10)
    hit = F.getbit(octet.cast("long"), F.col("_bit").bitwiseAND(F.lit(7)).cast("int")) == 1
    hit = F.coalesce(hit, F.lit(False))
    return marked.where(hit).select(*rows.columns), marked.where(~hit).select(*rows.columns)
