"""Item tables: reading, adapting three source shapes, writing by dataset and split."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seenscope.functions.prompts import fixed_choice_prompt, labeled_choice_prompt, math_prompt
from seenscope.plans.joins import null_safe_join
from seenscope.sources import schemas


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def _adapt(df: DataFrame, schema: str, **columns: Column) -> DataFrame:
    wanted = StructType.fromDDL(schema)
    return df.select(*[columns[f.name].cast(f.dataType).alias(f.name) for f in wanted])


def math_source(
    df: DataFrame, src_id: Column, problem: Column, solution: Column, level: Column
) -> DataFrame:
    return _adapt(
        df, schemas.MATH_SOURCE, src_id=src_id, problem=problem, solution=solution, level=level
    )


def labeled_choice_source(
    df: DataFrame,
    src_id: Column,
    question: Column,
    labels: Column,
    texts: Column,
    answer_key: Column,
) -> DataFrame:
    return _adapt(
        df,
        schemas.LABELED_SOURCE,
        src_id=src_id,
        question=question,
        choices=F.struct(labels.alias("label"), texts.alias("text")),
        answerKey=answer_key,
    )


def fixed_choice_source(
    df: DataFrame, src_id: Column, question: Column, choices: Column, answer: Column
) -> DataFrame:
    return _adapt(
        df,
        schemas.FIXED_SOURCE,
        src_id=src_id,
        question=question,
        choices=choices,
        answer=answer,
    )


PROMPTS = {
    "math": lambda: math_prompt(F.col("problem")),
    "choice_labeled": lambda: labeled_choice_prompt(F.col("question"), F.col("choices")),
    "choice_fixed": lambda: fixed_choice_prompt(F.col("question"), F.col("choices")),
}


def with_prompt(df: DataFrame, dataset_name: str) -> DataFrame:
    """Add ``dataset_name`` and ``instruction_text`` to a source table of that kind."""
    return df.withColumn("dataset_name", F.lit(dataset_name)).withColumn(
        "instruction_text", PROMPTS[dataset_name]()
    )


def write_items(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Write by ``keys`` (dataset and split). The rebalance hint lets adaptive execution
    split a large dataset over several files and keep a small one in a single file."""
    keys = ["dataset_name", "split"] if keys is None else keys
    df.hint("rebalance", *[F.col(k) for k in keys]).write.partitionBy(*keys).parquet(path)


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


# A table whose parts (dataset and split) can be written again one by one: rows carry the name
# of the write they come from, and a marker per part names the write and its number of rows.
RUN = "_run"


def write_parts(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Write the parts that ``df`` holds, in place of what is there of these parts only.

    The markers are written last. A part whose write fails before Spark commits it keeps its
    old rows and marker; one that is replaced only in part no longer agrees with its marker,
    so :func:`read_parts` leaves it out until it is written again.
    """
    keys = ["dataset_name", "split"] if keys is None else keys
    run = uuid.uuid4().hex

    def put(rows: DataFrame, folder: str) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*keys).parquet(f"{path}/{folder}")

    put(df.withColumn(RUN, F.lit(run)).hint("rebalance", *[F.col(k) for k in keys]), "rows")
    written = _written(df.sparkSession, path, df.select(*keys).schema)
    counts = written.where(F.col(RUN) == run).groupBy(*keys).agg(F.first(RUN).alias(RUN), F.count("*").alias("n_rows"))
    put(counts, "parts")


def _written(spark: SparkSession, path: str, keys: StructType) -> DataFrame:
    """The keys and the write of every row: no other column is read."""
    schema = StructType([*StructType.fromDDL(f"{RUN} STRING"), *keys])
    return spark.read.schema(schema).parquet(f"{path}/rows")


def part_report(spark: SparkSession, path: str, schema: str, keys: list[str] | None = None) -> DataFrame:
    """Per part the rows found, and whether it is complete: all rows are of the write that its
    marker names, as many as it counted."""
    keys = ["dataset_name", "split"] if keys is None else keys
    fields = StructType([f for k in keys for f in StructType.fromDDL(schema) if f.name == k])
    found = _written(spark, path, fields).groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.min(RUN).alias("_first"), F.max(RUN).alias("_last")
    )
    markers = spark.read.schema(StructType([*StructType.fromDDL(f"{RUN} STRING, n_rows LONG"), *fields]))
    marked = markers.parquet(f"{path}/parts").withColumnRenamed("n_rows", "_marked")
    joined = null_safe_join(found, marked, keys, "left")
    whole = (F.col("_first") == F.col(RUN)) & (F.col("_last") == F.col(RUN)) & (F.col("n_rows") == F.col("_marked"))
    return joined.select(*keys, "n_rows", F.coalesce(whole, F.lit(False)).alias("complete"))


def read_parts(spark: SparkSession, path: str, schema: str, keys: list[str] | None = None) -> DataFrame:
    """The rows of all complete parts."""
    keys = ["dataset_name", "split"] if keys is None else keys
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    return null_safe_join(rows, part_report(spark, path, schema, keys).where("complete"), keys, "left_semi")
