"""Chat records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seenscope.functions.prompts import FIXED_LABELS

# Fixed value: how an answer letter is given.
ANSWER_PREFIX = "The correct answer is: "


def chat(prompt: Column, answer: Column) -> Column:
    """``[{role: user, content}, {role: assistant, content}]``"""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("user", prompt), message("assistant", answer))


def valid_answer_index(answer: Column) -> Column:
    return answer.between(0, len(FIXED_LABELS) - 1)


def index_answer(answer: Column) -> Column:
    """Letter for a 0-based index; an index outside 0 to 3 raises an error."""
    labels = F.array(*[F.lit(x) for x in FIXED_LABELS])
    letter = F.when(valid_answer_index(answer), F.get(labels, answer)).otherwise(
        F.raise_error(F.concat(F.lit("answer index out of range: "), answer.cast("string")))
    )
    return F.concat(F.lit(ANSWER_PREFIX), letter)


def key_answer(answer_key: Column) -> Column:
    return F.concat(F.lit(ANSWER_PREFIX), answer_key)
