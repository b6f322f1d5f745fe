"""Filters and checks on item tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

REQUIRED = ["instruction_text", "id_num"]
# The levels that are kept.
VALID_LEVELS = ["Level 1", "Level 2", "Level 3", "Level 4", "Level 5"]


def keep_levels(df: DataFrame, levels: list[str] | None = None) -> DataFrame:
    return df.where(F.col("level").isin(VALID_LEVELS if levels is None else levels))


def keep_seen(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Only rows marked seen; all rows if not enabled or if there is no such column."""
    if not enabled or "seen" not in df.columns:
        return df
    return df.where(F.col("seen"))


def seen_report(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset_name").agg(
        F.count("*").alias("n_rows"),
        F.count_if(~F.coalesce(F.col("seen"), F.lit(False))).alias("n_not_seen"),
    )


def _not_seen() -> Column:
    return F.count_if(~F.coalesce(F.col("seen"), F.lit(False))).alias("n_not_seen")


def _fail_unless_seen(wrong: int) -> None:
    if wrong:
        raise ValueError(f"{wrong} rows are not marked as seen")


def verify_seen(df: DataFrame) -> None:
    """Raise if any row is not seen, giving their number."""
    _fail_unless_seen(df.agg(_not_seen()).first()[0])


def write_verified(df: DataFrame, write: Callable[[DataFrame], None], rules: dict[str, Column] | None = None) -> dict[str, int]:
    """Write rows that must all be seen, counting while they are written: no scan is added.

    ``write`` gets the rows and writes them once. The result has ``n_rows``, ``n_not_seen``
    and, for each of ``rules``, the number of rows that break it. Raises after the write if a
    row is not seen, giving their number, as :func:`verify_seen` does.
    """
    counts = Observation()
    extra = [F.count_if(rule).alias(name) for name, rule in (rules or {}).items()]
    write(df.observe(counts, F.count(F.lit(1)).alias("n_rows"), _not_seen(), *extra))
    found = counts.get
    _fail_unless_seen(found["n_not_seen"])
    return found


def require_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    missing = [c for c in (REQUIRED if columns is None else columns) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def item_rules() -> dict[str, Column]:
    """What every item must not be."""
    return {
        "null_instruction_text": F.col("instruction_text").isNull(),
        "null_id_num": F.col("id_num").isNull(),
    }


def violations(df: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Per dataset: rows, null prompts, null ids, and rows that break each extra rule."""
    require_columns(df)
    rules = item_rules() | (extra or {})
    return df.groupBy("dataset_name").agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(rule).alias(name) for name, rule in rules.items()],
    )
