"""Item tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seenscope.functions.prompts import FIXED_LABELS
from seenscope.operators.sampling import label_seen, split_half
from seenscope.plans.carry import last_before
from seenscope.sources.items import (
    fixed_choice_source,
    labeled_choice_source,
    math_source,
    read_table,
    with_prompt,
)

# The value lists of the source tables, which serve as answer choices.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CHOICE_LABELS = [*FIXED_LABELS, "E"]
# Ids of exchanges: room for so many turns per conversation.
TURNS_PER_ID = 1_000_000

SCHEMAS = {
    "documents": "doc_id LONG, text STRING, lang STRING, source STRING",
    "conversations": "conv_id LONG, turn LONG, role STRING, text STRING",
    "orders": "o_orderkey LONG, o_custkey LONG, o_orderpriority STRING",
    "customer": "c_custkey LONG, c_name STRING, c_mktsegment STRING",
    "embeddings": "vec_id LONG, embedding ARRAY<FLOAT>, label INT",
    "labels": "doc_id LONG, quality INT",
    "benchmark": "item_id LONG, text STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", SCHEMAS[name])


def _strings(values: list[str]):
    return F.array(*[F.lit(v) for v in values])


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the next assistant turn of its conversation, if any."""
    turns = table(spark, sf_dir, "conversations")
    answer = F.when(F.col("role") == "assistant", F.col("text"))
    # In falling order of the turns, the next one is the last before.
    answered = last_before(turns, "conv_id", -F.col("turn"), answer, "solution")
    return answered.where("role = 'user'").withColumnRenamed("text", "problem")


def math_items(spark: SparkSession, sf_dir: str, complete: bool = True) -> DataFrame:
    """Problem, solution and level (0 to 6) from conversations."""
    level = F.concat(F.lit("Level "), (F.col("conv_id") % 7).cast("string"))
    src_id = F.col("conv_id") * TURNS_PER_ID + F.col("turn")
    items = math_source(
        exchanges(spark, sf_dir), src_id, F.col("problem"), F.col("solution"), level
    )
    return items.where("solution IS NOT NULL") if complete else items


def labeled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three to five labelled priorities per order, the right one among them."""
    orders = table(spark, sf_dir, "orders")
    right = F.array_position(_strings(PRIORITIES), F.col("o_orderpriority")) - 1
    size = F.lit(3) + F.pmod(F.col("o_orderkey"), F.lit(3))
    place = F.pmod(F.col("o_orderkey"), size)
    texts = F.transform(
        F.sequence(F.lit(0).cast("long"), size - 1),
        lambda i: F.get(_strings(PRIORITIES), F.pmod(right - place + i, F.lit(5)).cast("int")),
    )
    question = F.concat(
        F.lit("Which priority has order "),
        F.col("o_orderkey").cast("string"),
        F.lit(" of customer "),
        F.col("o_custkey").cast("string"),
        F.lit("?"),
    )
    return labeled_choice_source(
        orders,
        F.col("o_orderkey"),
        question,
        F.slice(_strings(CHOICE_LABELS), 1, size.cast("int")),
        texts,
        F.get(_strings(CHOICE_LABELS), place.cast("int")),
    )


def fixed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sorted segments per customer, the right one among them."""
    customer = table(spark, sf_dir, "customer")
    right = F.array_position(_strings(SEGMENTS), F.col("c_mktsegment")) - 1
    left_out = F.pmod(right + 1 + F.pmod(F.col("c_custkey"), F.lit(4)), F.lit(5)).cast("int")
    choices = F.array_remove(_strings(SEGMENTS), F.get(_strings(SEGMENTS), left_out))
    return fixed_choice_source(
        customer,
        F.col("c_custkey"),
        F.concat(F.lit("Which segment is "), F.col("c_name"), F.lit(" in?")),
        choices,
        F.array_position(choices, F.col("c_mktsegment")) - 1,
    )


SOURCES = {"math": math_items, "choice_labeled": labeled_items, "choice_fixed": fixed_items}


def prompted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_prompt(SOURCES[name](spark, sf_dir), name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as items; the language is the dataset."""
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("dataset_name"),
        F.col("doc_id").alias("id_num"),
        F.col("text").alias("instruction_text"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_seen(documents(spark, sf_dir))


def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with label and split. Both come from comparing a row's hash with cut-offs
    that are written once, so reading the items again costs a scan and no shuffle of texts,
    which a join with written labels would."""
    return split_half(labelled_documents(spark, sf_dir))


def stored_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six consecutive embeddings as the states of one sample; no losses."""
    return table(spark, sf_dir, "embeddings").select(
        F.lit("vectors").alias("dataset_name"),
        F.floor(F.col("vec_id") / 6).cast("long").alias("id_num"),
        F.pmod(F.col("vec_id"), F.lit(6)).cast("int").alias("step"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
