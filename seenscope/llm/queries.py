"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seenscope.llm import (
    cgk,
    chat,
    covertree,
    dartminhash,
    hpyp,
    language,
    oracle,
    packing,
    pii,
    simhash,
    template,
    trie,
    trust,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL = {
    "op2_url_verdicts": oracle.verdicts(),
    "op3_revisits": oracle.revisits(),
    "op10_chats": oracle.chats(),
    "op11_prefix_trie": oracle.prefix_trie(),
    "op12_hard_negatives": oracle.hard_negatives(),
}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query
def op1_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts; near ones are counted for the
    documents whose id is divisible by 20, against all documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.with_near_counts(simhash.fingerprint_documents(docs))


@query
def op2_url_verdicts(spark, sf_dir):
    """Verdict of every URL by rule, else by trust over the host graph."""
    found = trust.judge(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def crawl(pages: DataFrame) -> DataFrame:
    """A crawl log derived from pages: one to four captures of each, some of them full
    responses, the others revisits, with fragments, missing or wrong validators."""
    page, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    captures = pages.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.pmod(page, F.lit(4)))).alias("n"))
    n = F.col("n")
    full = ((n == 0) & (page % 5 != 0)) | ((n == 2) & (page % 3 == 0))
    version = F.when((n >= 2) & (page % 3 == 0), "2").otherwise("1")
    tag = F.when((page % 7 == 0) & ~full, F.lit('"other"')).otherwise(
        F.concat(F.when(full, "").otherwise("W/"), F.lit('"'), F.md5(html), F.lit("-"), version, F.lit('"'))
    )
    headers = F.map_filter(
        F.create_map(
            F.lit("ETag"), F.when(page % 11 != 0, tag),
            F.lit("Last-Modified"), F.concat(F.lit("day "), (page % 28).cast("string")),
            F.lit("Cache-Control"), F.concat(F.lit("max-age="), n.cast("string")),
            F.lit("Content-Length"), F.when(full, F.length(html)).otherwise(0).cast("string"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return captures.select(
        (page * 4 + n).alias("record_id"),
        F.when(full, "response").otherwise("revisit").alias("kind"),
        F.when(n % 2 == 1, F.concat("url", F.lit("#r"), n.cast("string"))).otherwise(F.col("url")).alias("uri"),
        F.timestamp_seconds(F.lit(1704067200) + page * 60 + n * 86400).alias("date"),
        headers.alias("headers"),
        F.when(full, html).alias("payload"),
    )


@query
def op3_revisits(spark, sf_dir):
    """Every revisit of the crawl log derived from all pages, with the response it stands for."""
    found = warc.resolve(crawl(table(spark, sf_dir, "pages", "page_id", "url", "html")))
    return found.withColumn("headers", warc.headers_text(F.col("headers"))).drop("date")


@query
def op4_personal_data(spark, sf_dir):
    """Personal data in every document."""
    return pii.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op5_language(spark, sf_dir):
    """Predicted language of every document."""
    return language.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@query
def op6_scores(spark, sf_dir):
    """Log-probability of every document under the hierarchical Pitman-Yor model."""
    return hpyp.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op7_near_duplicates(spark, sf_dir):
    """Class of every document: near duplicates have shingle similarity 0.8 or more."""
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op8_contaminated(spark, sf_dir):
    """Benchmark items that each document contains, up to an edit distance of a tenth."""
    return cgk.contaminated(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        table(spark, sf_dir, "benchmark", "item_id", "text"),
    )


@query
def op9_packed_pieces(spark, sf_dir):
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op10_chats(spark, sf_dir):
    """All conversations formatted for training, and one that holds control strings."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(chat.format_chats(chat.canonical_table(turns.union(tricky))))


@query
def op11_prefix_trie(spark, sf_dir):
    """Trie of all conversations, each with the opening of the one before it in its twenty."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    found = trie.prefix_trie(*trie.share_openings(trie.place_turns(turns)))
    return found.drop("node", "parent")


@query
def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of every hundredth vector; every seventh vector has another label."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = covertree.scale_vectors(vectors.withColumn("label", moved))
    return covertree.hard_negatives(scaled, F.col("id") % 100 == 0)


@query
def op13_main_text(spark, sf_dir):
    """Main text of every page."""
    return template.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
