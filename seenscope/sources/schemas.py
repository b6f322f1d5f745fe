"""Schemas of the tables that are read and written."""

from __future__ import annotations

MATH_SOURCE = "src_id LONG, problem STRING, solution STRING, level STRING"
LABELED_SOURCE = (
    "src_id LONG, question STRING, "
    "choices STRUCT<label: ARRAY<STRING>, text: ARRAY<STRING>>, answerKey STRING"
)
FIXED_SOURCE = "src_id LONG, question STRING, choices ARRAY<STRING>, answer INT"
ITEMS = "dataset_name STRING, id_num LONG, instruction_text STRING, seen BOOLEAN"
TRAJECTORY = (
    "dataset_name STRING, split STRING, id_num LONG, step INT, "
    "embedding ARRAY<DOUBLE>, loss DOUBLE, grad_norm DOUBLE"
)
METRICS = (
    "dataset_name STRING, k INT, threshold DOUBLE, train_accuracy DOUBLE, "
    "eval_accuracy DOUBLE, train_auc DOUBLE, eval_auc DOUBLE, seen_mean DOUBLE, "
    "unseen_mean DOUBLE"
)
