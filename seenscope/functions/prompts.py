"""Prompt texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt wording.
MATH_HEAD = (
    "Solve the following math problem step by step. Show your work and provide the final "
    "answer in \\boxed{} format at the very end.\n\nProblem: "
)
CHOICE_HEAD = (
    "Answer the following multiple choice question by selecting the correct option. Output "
    "only the letter corresponding to your choice.\n\nQuestion: "
)
CHOICES = "\n\nChoices:\n"
SELECT_OPEN = "\nSelect the correct answer ("
SELECT_CLOSE = ").\n\nAnswer:"
ANSWER_TAIL = "\n\nAnswer:"
FIXED_LABELS = ["A", "B", "C", "D"]
FIXED_FORMAT = "A, B, C, or D"


def math_prompt(problem: Column) -> Column:
    return F.concat(F.lit(MATH_HEAD), problem, F.lit(ANSWER_TAIL))


def _choice_prompt(question: Column, labels: Column, texts: Column, label_list: Column) -> Column:
    # The shorter list sets the number of lines; arrays_zip alone would pad with nulls.
    lines = F.zip_with(
        F.slice(labels, 1, F.least(F.size(labels), F.size(texts))),
        F.slice(texts, 1, F.least(F.size(labels), F.size(texts))),
        lambda label, text: F.concat(label, F.lit(". "), text, F.lit("\n")),
    )
    return F.concat(
        F.lit(CHOICE_HEAD),
        question,
        F.lit(CHOICES),
        F.array_join(lines, ""),
        F.lit(SELECT_OPEN),
        label_list,
        F.lit(SELECT_CLOSE),
    )


def labeled_choice_prompt(question: Column, choices: Column) -> Column:
    """Labels come with the data; all of them are named at the end of the prompt."""
    labels = choices["label"]
    return _choice_prompt(question, labels, choices["text"], F.array_join(labels, ", "))


def fixed_choice_prompt(question: Column, texts: Column) -> Column:
    """Labels A to D."""
    labels = F.array(*[F.lit(x) for x in FIXED_LABELS])
    return _choice_prompt(question, labels, texts, F.lit(FIXED_FORMAT))
