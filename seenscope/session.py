"""Session settings used by the tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    master: str = "local[*]",
    app_name: str = "seenscope",
    shuffle_partitions: int | None = None,
    driver_memory: str = "16g",
) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .config("spark.ui.showConsoleProgress", "false")
        .appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
