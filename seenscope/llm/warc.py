"""Not-modified revisits of a web crawl, resolved to the response they stand for.

A revisit takes the latest earlier full response of its canonical URL (an as-of join), if its
validators agree: equal entity tags (weak comparison), else equal modification dates, else
equal payload digests. The headers of the response are then updated with those of the revisit
that a not-modified answer may change; all others, such as the length, stay.

Records are dealt by ranges of (URL, date, id) and written with their range number, so that a
URL with most of the records is spread over many tasks. Inside a range a window carries the
last response on; the last response of each URL in earlier ranges comes from one row per URL
and range, kept for URLs that several ranges share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seenscope.plans.materialize import materialize

# Header fields that a not-modified answer may update.
PERMITTED = (
    "age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary",
)
_TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid)(?:=[^&]*)?"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, no tracking parameters,
    ``/`` for an empty path. Null for null; a text without ``://`` only loses its fragment."""
    whole = F.regexp_replace(url, r"(?s)#.*", "")
    scheme = F.translate(F.regexp_extract(whole, r"(?s)^([^:/?#]*)://", 1), UPPER, LOWER)
    host = F.translate(F.regexp_extract(whole, r"(?s)^[^:/?#]*://([^/?]*)", 1), UPPER, LOWER)
    host = F.when(scheme == "http", F.regexp_replace(host, r":(?:80)?$", "")).otherwise(
        F.regexp_replace(host, r":(?:443)?$", "")
    )
    path = F.regexp_extract(whole, r"(?s)^[^:/?#]*://[^/?]*([^?]*)", 1)
    query = F.regexp_extract(whole, r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^{_TRACKING}$")), "&")
    built = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(whole.rlike(r"(?s)^[^:/?#]+://"), built).otherwise(whole)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _agree(revisit: Column, response: Column) -> Column:
    """Do the validators agree? The first kind that the revisit has decides; a revisit with
    none agrees with nothing."""
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    return (
        F.when(revisit["etag"].isNotNull(), same(_weak(revisit["etag"]), _weak(response["etag"])))
        .when(revisit["last_modified"].isNotNull(), same(revisit["last_modified"], response["last_modified"]))
        .otherwise(same(revisit["digest"], response["digest"]))
    )


def merge_headers(stored: Column, update: Column) -> Column:
    """Stored headers with the permitted ones of the update; names in lower case."""
    allowed = F.map_filter(update, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def _lower_names(headers: Column) -> Column:
    """A header that occurs in several spellings keeps its last value."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key: string, value: string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    last = lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: ``revisit_id, url, date, refers_to, outcome, headers,
    payload_chars, payload_sha256``.

    ``records(record_id, kind, uri, date, headers, payload)``: kind is ``response`` or
    ``revisit``, other kinds are ignored. ``outcome`` is ``resolved``, ``mismatch`` (the
    validators differ) or ``missing`` (no earlier response, or a null URL or date); only
    resolved revisits refer to a response and have its payload and merged headers, the others
    keep their own headers. Records of one date are ordered by id. A null payload is empty.
    """
    headers = _lower_names(F.col("headers"))
    digest = F.sha2(F.coalesce("payload", F.lit("")), 256)
    rows = records.where(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").cast("long").alias("record_id"),
        (F.col("kind") == "response").alias("is_response"),
        canonical_url(F.col("uri")).alias("url"),
        "date",
        headers.alias("headers"),
        F.when(F.col("kind") == "response", digest).otherwise(headers["warc-payload-digest"]).alias("digest"),
        F.when(F.col("kind") == "response", F.length(F.coalesce("payload", F.lit("")))).cast("long").alias("chars"),
    )
    record = F.struct(
        "record_id", "headers", "digest", "chars",
        F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("last_modified"),
    )
    rows = rows.select("url", "date", "record_id", "is_response", record.alias("record"))
    placed = rows.where("url IS NOT NULL AND date IS NOT NULL")
    ranged = placed.repartitionByRange("url", "date", "record_id").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "crawl")
    parts = ranged.groupBy("url", "part").agg(
        F.max_by(F.when(F.col("is_response"), F.col("record")), F.when(F.col("is_response"), F.struct("date", "record_id"))).alias("last")
    )
    shared = parts.groupBy("url").agg(F.count("*").alias("n")).where("n > 1").select("url")
    before = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.join(shared, "url").select("url", "part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    carried = materialize(carried, "carried")
    earlier = Window.partitionBy("part", "url").orderBy("date", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    response = F.when(F.col("is_response"), F.col("record"))
    seen = (
        ranged.withColumn("inside", F.last(response, ignorenulls=True).over(earlier))
        .where("NOT is_response")
        .join(carried, ["url", "part"], "left")
        .select("url", "date", "record", F.coalesce("inside", "carried").alias("response"))
    )
    lost = rows.where("NOT is_response AND (url IS NULL OR date IS NULL)")
    seen = seen.unionByName(lost.select("url", "date", "record", F.lit(None).alias("response")))
    found = seen.withColumn(
        "outcome",
        F.when(F.col("response").isNull(), "missing")
        .when(_agree(F.col("record"), F.col("response")), "resolved")
        .otherwise("mismatch"),
    )
    resolved = lambda x: F.when(F.col("outcome") == "resolved", x)
    return found.select(
        F.col("record.record_id").alias("revisit_id"),
        "url",
        "date",
        resolved(F.col("response.record_id")).alias("refers_to"),
        "outcome",
        F.coalesce(resolved(merge_headers(F.col("response.headers"), F.col("record.headers"))), "record.headers").alias("headers"),
        resolved(F.col("response.chars")).alias("payload_chars"),
        resolved(F.col("response.digest")).alias("payload_sha256"),
    )


def with_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """``resolved`` with the payload of the response referred to (null if none)."""
    stored = records.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), "payload")
    return resolved.join(stored, "refers_to", "left")


def headers_text(headers: Column) -> Column:
    """``name: value`` lines by name."""
    entries = F.array_sort(F.map_entries(headers), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
