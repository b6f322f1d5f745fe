"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents``. Every stage works on the whole of what its predecessor kept. Rows with a null
id or text pass no further than language identification; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seenscope.llm import cgk, dartminhash, language, packing, pii
from seenscope.plans.joins import key_filter, split_by_filter
from seenscope.plans.materialize import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# Documents below this calibrated probability are rejected: with few languages, a text that
# fits one of them hardly better than by chance.
LEAST_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised."""
    docs = docs.select(*COLUMNS)
    found = language.predict(docs, language.train(docs))
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(known & F.col("doc_id").isNotNull()).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one text of each class, at its smallest id. Rows are told apart by id and text;
    of rows equal in both, one stays."""
    docs = docs.select(*COLUMNS)
    same = ["doc_id", "digest"]
    judged = materialize(dartminhash.classes(docs).select(*same, "kept"), "judged")
    dropped = materialize(judged.where("NOT kept").select(*same).distinct(), "dropped")
    repeated = materialize(judged.where("kept").groupBy(*same).count().where("count > 1").select(*same), "repeated")
    # Texts whose ids are neither dropped nor repeated are kept where they are, without a shuffle.
    concerned = key_filter(dropped.union(repeated), ["doc_id"])
    judging, untouched = split_by_filter(docs, concerned, [F.col("doc_id").cast("long")])
    kept = judging.withColumn("digest", dartminhash.digest("text")).join(dropped, same, "left_anti")
    if repeated.isEmpty():
        return untouched.unionByName(kept.select(*COLUMNS))
    once = kept.join(repeated, same, "left_anti")
    copies = kept.join(repeated, same, "left_semi").dropDuplicates(same)
    return untouched.unionByName(once.unionByName(copies).select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return cgk.mark(docs.select(*COLUMNS), items).where(F.size("item_ids") == 0).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets."""
    docs = docs.select(*COLUMNS)
    cleaned = pii.redact(docs, pii.train(docs))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

# No stage but the redaction can be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
