"""Word tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"([^ \t\n\r\f]+)"
CONTENT = r"[\p{L}\p{N}]"


def words(text: Column, max_length: int | None = None) -> Column:
    """Lower-case words of the whole text, or of its first ``max_length`` words if given."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))
    return found if max_length is None else F.slice(found, 1, max_length)


def is_special(token: Column) -> Column:
    """Tokens without a letter or digit play the part of special tokens."""
    return ~token.rlike(CONTENT)
