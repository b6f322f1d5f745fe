"""SQL twins of the registered queries, for DuckDB on the same tables.

Each twin is a chain of named steps; :func:`_twin` puts in front of a final SELECT the
steps it needs.
"""

from __future__ import annotations

import re

from seenscope.catalog.fixtures import CHOICE_LABELS, PRIORITIES, SEGMENTS
from seenscope.catalog.queries import (
    K_VALUES,
    METHODS,
    REPORT_DATASETS,
    STRATIFIED_ROWS,
    SWEEP_K,
    VECTOR_DIM,
)
from seenscope.functions import prompts
from seenscope.functions.chat import ANSWER_PREFIX
from seenscope.operators.checks import VALID_LEVELS
from seenscope.operators.classifier import TOP_FEATURES
from seenscope.operators.features import feature_names
from seenscope.operators.kneser_ney import DISCOUNT
from seenscope.operators.optimiser import BETAS, BUCKETS, DECAY, EPSILON, RATE
from seenscope.operators.sampling import CONTAM_ROWS, SAMPLE_ROWS
from seenscope.operators.scores import K_RATIOS, MAX_LENGTH
from seenscope.operators.trajectory import DIM, NUM_STEPS
from seenscope.operators.word_vectors import TURNS


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"E'{escaped}'"


def _texts(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _key(purpose: str, *columns: str) -> str:
    return "md5('42:" + purpose + ":' || " + " || ':' || ".join(columns) + ")"


def _choice(labels: str, texts: str, label_list: str) -> str:
    lines = (
        f"list_transform(list_zip({labels}[1:least(len({labels}), len({texts}))], "
        f"{texts}[1:least(len({labels}), len({texts}))]), "
        f"lambda p: p[1] || '. ' || p[2] || chr(10))"
    )
    return (
        f"{_text(prompts.CHOICE_HEAD)} || question || {_text(prompts.CHOICES)} || "
        f"array_to_string({lines}, '') || {_text(prompts.SELECT_OPEN)} || {label_list} || "
        f"{_text(prompts.SELECT_CLOSE)}"
    )


def _numbered(source: str) -> str:
    key = _key("position", "dataset_name", "src_id")
    return (
        f"SELECT *, row_number() OVER (ORDER BY {key}, src_id) - 1 AS id_num, "
        f"CASE WHEN row_number() OVER (ORDER BY {key}, src_id) <= {CONTAM_ROWS} "
        f"THEN 'contam' ELSE 'val' END AS split FROM {source}"
    )


def _sampled(source: str) -> str:
    key = _key("sample", "dataset_name", "src_id")
    return (
        f"SELECT * FROM {source} QUALIFY row_number() OVER (ORDER BY {key}, src_id) "
        f"<= {SAMPLE_ROWS}"
    )


def _stratified(rows: int) -> str:
    key = _key("sample", "dataset_name", "src_id")
    return (
        "SELECT * FROM math_kept QUALIFY row_number() OVER "
        f"(PARTITION BY level ORDER BY {key}, src_id) "
        f"<= {rows} // (SELECT count(DISTINCT level) FROM math_kept)"
    )


def _labelled(source: str) -> str:
    key = _key("seen", "dataset_name", "id_num")
    return (
        f"SELECT *, row_number() OVER (PARTITION BY dataset_name, split ORDER BY {key}, id_num) "
        f"<= count(*) OVER (PARTITION BY dataset_name, split) // 2 AS seen FROM {source}"
    )


def _word_vectors(dim: int) -> dict[str, str]:
    """Block power iteration with a step per column: names of steps end in letters."""
    columns = [f"x{i}" for i in range(dim)]
    steps = {
        "inner_pairs": "SELECT prev, tok, c_pair, sum(c_pair) OVER (PARTITION BY prev) AS c_prev, "
        "sum(c_pair) OVER (PARTITION BY tok) AS c_tok, sum(c_pair) OVER () AS total "
        "FROM pairs WHERE c_pair > 0 AND prev <> ''",
        "ppmi": "SELECT * FROM (SELECT prev, tok, ln(c_pair * total::DOUBLE / (c_prev::DOUBLE * c_tok)) AS value "
        "FROM inner_pairs) WHERE value > 0",
        "block_start": "SELECT tok, "
        + ", ".join(
            f"('0x' || substr(md5('42:start-{i // 8}:' || tok), {4 * (i % 8) + 1}, 4))::INTEGER / 32768e0 - 1 AS x{i}"
            for i in range(dim)
        )
        + " FROM (SELECT DISTINCT tok FROM ppmi)",
    }
    at = "block_start"

    def add(sql: str) -> None:
        nonlocal at
        n = len(steps)
        at = "block_" + chr(97 + n // 26) + chr(97 + n % 26)
        steps[at] = sql

    def multiply(by: str, to: str) -> None:
        add(
            f"SELECT {to}, " + ", ".join(f"sum(value * {c}) AS {c}" for c in columns)
            + f" FROM ppmi JOIN {at} USING ({by}) GROUP BY {to}"
        )

    def orthogonal(key: str) -> None:
        for i, c in enumerate(columns):
            if i:
                less = " - ".join(f"(SELECT sum({q} * {c}) FROM {at}) * {q}" for q in columns[:i])
                add(f"SELECT {key}, " + ", ".join(f"{c} - {less} AS {c}" if x == c else x for x in columns) + f" FROM {at}")
            length = f"sqrt((SELECT sum({c} * {c}) FROM {at}))"
            add(f"SELECT {key}, " + ", ".join(f"{c} / {length} AS {c}" if x == c else x for x in columns) + f" FROM {at}")

    for turn in range(TURNS):
        if turn:
            orthogonal("tok")
        multiply("tok", "prev")
        orthogonal("prev")
        multiply("prev", "tok")
    steps["word_vectors"] = (
        "SELECT tok, "
        + ", ".join(f"{c} / sqrt(sqrt((SELECT sum({c} * {c}) FROM {at}))) AS v{i}" for i, c in enumerate(columns))
        + f" FROM {at}"
    )
    return steps


def _adam() -> dict[str, str]:
    """Optimiser steps with one row per sample and parameter: names of steps end in letters."""
    digit = "(instr('0123456789abcdef', substr(md5({0}), 1, 1)) - 1)"
    first, second = BETAS
    row = "PARTITION BY dataset_name, id_num, u"
    steps = {
        "adam_start": "SELECT u, j, ln((coalesce(c, 0) + 1e0) / (coalesce(sum(c) OVER (PARTITION BY u), 0) + "
        f"{BUCKETS}e0)) AS w FROM (SELECT unnest(range({BUCKETS})) AS u) CROSS JOIN "
        f"(SELECT unnest(range({BUCKETS})) AS j) LEFT JOIN (SELECT {digit.format('prev')} AS u, "
        f"{digit.format('tok')} AS j, sum(c_pair)::DOUBLE AS c FROM pairs WHERE prev <> '' GROUP BY ALL) USING (u, j)",
        "adam_pairs": f"SELECT dataset_name, id_num, {digit.format('prev')} AS u, {digit.format('tok')} AS j, "
        "count(*)::DOUBLE AS n FROM positions WHERE pos > 0 GROUP BY ALL",
        "adam_last": f"SELECT dataset_name, id_num, {digit.format('last_token')} AS u FROM last_words",
        "adam_zero": "SELECT dataset_name, id_num, u, j, coalesce(n, 0e0) AS n, "
        f"coalesce(sum(n) OVER ({row}), 0e0) AS n_u, size, w, 0e0 AS m, 0e0 AS v FROM "
        "(SELECT dataset_name, id_num, u FROM adam_pairs UNION SELECT dataset_name, id_num, u FROM adam_last) "
        "JOIN (SELECT dataset_name, id_num, sum(n) AS size FROM adam_pairs GROUP BY ALL) USING (dataset_name, id_num) "
        "JOIN adam_start USING (u) LEFT JOIN adam_pairs USING (dataset_name, id_num, u, j)",
    }
    at, out = "adam_zero", ["SELECT 0 AS step, dataset_name, id_num, u, j, w, NULL::DOUBLE AS l, NULL::DOUBLE AS g FROM adam_zero"]
    for s in STEPS[1:]:
        sloped, moved = f"adam_slope_{'abcdefgh'[s]}", f"adam_step_{'abcdefgh'[s]}"
        steps[sloped] = (
            "SELECT *, (n_u * exp(ln_p) - n) / size AS g, -n * ln_p AS l FROM "
            f"(SELECT dataset_name, id_num, u, j, n, n_u, size, w, m, v, w - ln(sum(exp(w)) OVER ({row})) AS ln_p FROM {at})"
        )
        steps[moved] = (
            f"SELECT * EXCLUDE (w, ln_p), w * (1 - {RATE}e0 * {DECAY}e0) - {RATE}e0 * m / {1 - first**s!r}::DOUBLE / "
            f"(sqrt(v / {1 - second**s!r}::DOUBLE) + {EPSILON!r}) AS w FROM "
            f"(SELECT * EXCLUDE (m, v), {first}e0 * m + {1 - first!r}::DOUBLE * g AS m, "
            f"{second}e0 * v + {1 - second!r}::DOUBLE * g * g AS v FROM {sloped})"
        )
        at = moved
        out.append(f"SELECT {s}, dataset_name, id_num, u, j, w, l, g FROM {moved}")
    steps["adam_moves"] = " UNION ALL ".join(out)
    steps["adam_states"] = (
        "SELECT dataset_name, split, id_num, step, round(sum(l) / any_value(size), 9) AS loss, "
        "round(sqrt(sum(g * g)), 9) AS grad_norm, "
        + ", ".join(f"round(max(w) FILTER (WHERE j = {i} AND last_u = u), 9) AS e{i}" for i in range(BUCKETS))
        + " FROM adam_moves JOIN (SELECT dataset_name, id_num, sum(n) AS size FROM adam_pairs GROUP BY ALL) "
        "USING (dataset_name, id_num) JOIN (SELECT dataset_name, id_num, u AS last_u FROM adam_last) "
        "USING (dataset_name, id_num) JOIN (SELECT dataset_name, id_num, split FROM items) "
        "USING (dataset_name, id_num) GROUP BY dataset_name, split, id_num, step"
    )
    return steps


def _interpolated(count: str, lower: str) -> str:
    own = f"greatest(coalesce({count}, 0) - {DISCOUNT}e0, 0e0)"
    return f"CASE WHEN c_context > 0 THEN ({own} + {DISCOUNT}e0 * k_context * {lower}) / c_context ELSE {lower} END"


# Enough for the last digits at the sizes that are compared.
DESCENT_TURNS = 2500
STEPS = range(NUM_STEPS + 1)
P = {
    s: f"((c_pair + base + {s}e0 * n) / (c_prev + 1e0 + {s}e0 * n_prev))" for s in STEPS
}
FEATURES = feature_names()

WITH = {
    # --- items from the source tables
    "turns": "SELECT *, first_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER "
    "(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS solution "
    "FROM conversations",
    "math_all": "SELECT 'math' AS dataset_name, conv_id * 1000000 + turn AS src_id, text AS problem, "
    "solution, 'Level ' || (conv_id % 7) AS level FROM turns WHERE role = 'user'",
    "math": "SELECT *, "
    + f"{_text(prompts.MATH_HEAD)} || problem || {_text(prompts.ANSWER_TAIL)} AS instruction_text "
    + "FROM math_all WHERE solution IS NOT NULL",
    "math_kept": "SELECT * FROM math WHERE level IN ("
    + ", ".join(f"'{v}'" for v in VALID_LEVELS)
    + ")",
    "labeled_raw": "SELECT 'choice_labeled' AS dataset_name, o_orderkey AS src_id, "
    "'Which priority has order ' || o_orderkey || ' of customer ' || o_custkey || '?' AS question, "
    f"list_position({_texts(PRIORITIES)}, o_orderpriority) - 1 AS at_right, "
    "3 + o_orderkey % 3 AS size, o_orderkey % (3 + o_orderkey % 3) AS place FROM orders",
    "labeled": "SELECT *, "
    + _choice("labels", "texts", "array_to_string(labels, ', ')")
    + " AS instruction_text FROM (SELECT *, "
    + f"{_texts(CHOICE_LABELS)}[1:size] AS labels, {_texts(CHOICE_LABELS)}[place + 1] AS answer_key, "
    + f"list_transform(range(0, size), lambda i: {_texts(PRIORITIES)}"
    + "[(at_right - place + i + 5) % 5 + 1]) AS texts FROM labeled_raw)",
    "fixed_raw": "SELECT 'choice_fixed' AS dataset_name, c_custkey AS src_id, "
    "'Which segment is ' || c_name || ' in?' AS question, c_mktsegment AS right_segment, "
    f"(list_position({_texts(SEGMENTS)}, c_mktsegment) - 1 + 1 + c_custkey % 4) % 5 AS left_out "
    "FROM customer",
    "fixed": "SELECT *, list_position(choices, right_segment) - 1 AS answer, "
    + _choice(_texts(prompts.FIXED_LABELS), "choices", f"'{prompts.FIXED_FORMAT}'")
    + " AS instruction_text FROM (SELECT *, "
    + f"list_filter({_texts(SEGMENTS)}, lambda s: s <> {_texts(SEGMENTS)}[left_out + 1]) AS choices "
    + "FROM fixed_raw)",
    "math_numbered": _numbered("math"),
    "labeled_numbered": _numbered("labeled"),
    "fixed_numbered": _numbered("fixed"),
    "labeled_sample": _sampled("labeled"),
    "labeled_sample_numbered": _numbered("labeled_sample"),
    "prepared": _labelled(
        "(SELECT dataset_name, id_num, split FROM math_numbered UNION ALL "
        "SELECT dataset_name, id_num, split FROM labeled_numbered UNION ALL "
        "SELECT dataset_name, id_num, split FROM fixed_numbered)"
    ),
    "tasks": "SELECT row_number() OVER (ORDER BY task, id_num) - 1 AS global_index, * FROM ("
    "SELECT 0 AS task, dataset_name, id_num, instruction_text AS first_content, "
    "solution AS second_content FROM math_numbered UNION ALL "
    "SELECT 1, dataset_name, id_num, instruction_text, "
    f"'{ANSWER_PREFIX}' || {_texts(prompts.FIXED_LABELS)}[answer + 1] FROM fixed_numbered UNION ALL "
    "SELECT 2, dataset_name, id_num, instruction_text, "
    f"'{ANSWER_PREFIX}' || answer_key FROM labeled_numbered)",
    # --- documents as items
    "docs": "SELECT lang AS dataset_name, doc_id AS id_num, text AS instruction_text FROM documents",
    "labelled": "SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY "
    + _key("seen", "dataset_name", "id_num")
    + ", id_num) <= count(*) OVER (PARTITION BY dataset_name) // 2 AS seen FROM docs",
    "items": "SELECT *, CASE WHEN row_number() OVER (PARTITION BY dataset_name, seen ORDER BY "
    + _key("split", "dataset_name", "id_num")
    + ", id_num) <= count(*) OVER (PARTITION BY dataset_name, seen) // 2 "
    "THEN 'train' ELSE 'eval' END AS split FROM labelled",
    # --- language model
    "listed": "SELECT dataset_name, id_num, seen, "
    "regexp_extract_all(lower(instruction_text), '[^ \\t\\n\\r\\f]+') AS words FROM items",
    "positions": "SELECT dataset_name, id_num, seen, (at_pos - 1)::INTEGER AS pos, words[at_pos] AS tok, "
    "CASE WHEN at_pos = 1 THEN '' ELSE words[at_pos - 1] END AS prev FROM "
    "(SELECT *, unnest(range(1, len(words) + 1)) AS at_pos FROM listed)",
    "cells": "SELECT *, sum(n) OVER (PARTITION BY dataset_name, id_num, prev) AS n_prev FROM "
    "(SELECT dataset_name, id_num, seen, prev, tok, count(*) AS n FROM positions GROUP BY ALL)",
    "pairs": "SELECT prev, tok, count(*) FILTER (WHERE seen) AS c_pair FROM positions GROUP BY ALL",
    "contexts": "SELECT prev, sum(c_pair)::BIGINT AS c_prev FROM pairs GROUP BY prev",
    "unigrams": "SELECT tok, sum(c_pair)::BIGINT AS c_tok FROM pairs GROUP BY tok",
    "model": "SELECT prev, tok, c_pair, c_prev, c_tok, (c_tok + 1e0) / (SELECT sum(c_tok) + "
    "count(*) FILTER (WHERE c_tok > 0) + 1 FROM unigrams)::DOUBLE AS base "
    "FROM pairs JOIN contexts USING (prev) JOIN unigrams USING (tok)",
    "logprobs": "SELECT dataset_name, id_num, pos, tok AS token, "
    "ln((c_pair + base) / (c_prev + 1e0)) AS logprob "
    "FROM positions JOIN model USING (prev, tok) WHERE pos > 0",
    "ordered": "SELECT *, row_number() OVER (PARTITION BY dataset_name, id_num ORDER BY logprob, pos) "
    "AS place, count(*) OVER (PARTITION BY dataset_name, id_num) AS tokens FROM logprobs",
    "sample_scores": "SELECT dataset_name, id_num, exp(-avg(logprob))::FLOAT::DOUBLE AS perplexity, "
    "-avg(logprob) AS avg_nll, count(*) AS num_tokens, "
    + ", ".join(
        f"-avg(logprob) FILTER (WHERE place <= greatest(1, floor(tokens * {r}e0))) AS min_k_{k}"
        for r, k in zip(K_RATIOS, K_VALUES, strict=True)
    )
    + " FROM ordered GROUP BY ALL",
    "scores": "SELECT dataset_name, id_num, split, seen, perplexity, avg_nll, "
    "coalesce(num_tokens, 0) AS num_tokens, "
    + ", ".join(f"round(coalesce(min_k_{k}, 0e0), 9) AS min_k_{k}" for k in K_VALUES)
    + " FROM items LEFT JOIN sample_scores USING (dataset_name, id_num)",
    "long": " UNION ALL ".join(
        f"SELECT dataset_name, id_num, split, seen, {k} AS k, min_k_{k} AS score FROM scores"
        for k in K_VALUES
    ),
    # --- the same for texts that had no part in the model
    "other_pairs": "SELECT prev, tok, count(*) AS c_pair FROM positions JOIN "
    "(SELECT dataset_name, id_num, split FROM items) USING (dataset_name, id_num) "
    "WHERE seen AND split = 'train' GROUP BY ALL",
    "other_contexts": "SELECT prev, sum(c_pair)::BIGINT AS c_prev FROM other_pairs GROUP BY prev",
    "other_unigrams": "SELECT tok, sum(c_pair)::BIGINT AS c_tok FROM other_pairs GROUP BY tok",
    "other_cells": "SELECT c.dataset_name, c.id_num, c.n, c.n_prev, c.prev, c.tok, "
    "coalesce(c_pair, 0) AS c_pair, coalesce(c_prev, 0) AS c_prev, "
    "(coalesce(c_tok, 0) + 1e0) / (SELECT sum(c_tok) + count(*) + 1 FROM other_unigrams)::DOUBLE AS base, "
    "instr('0123456789abcdef', substr(md5(c.prev || ' ' || c.tok), 1, 1)) - 1 AS bucket "
    "FROM cells c JOIN (SELECT dataset_name, id_num, split FROM items) i USING (dataset_name, id_num) "
    "LEFT JOIN other_pairs USING (prev, tok) LEFT JOIN other_contexts USING (prev) "
    "LEFT JOIN other_unigrams USING (tok) WHERE i.split = 'eval' AND c.prev <> ''",
    "other_ordered": "SELECT *, sum(n) OVER (PARTITION BY dataset_name, id_num ORDER BY logprob, prev, tok) "
    "AS upto, sum(n) OVER (PARTITION BY dataset_name, id_num) AS tokens FROM "
    "(SELECT *, ln((c_pair + base) / (c_prev + 1e0)) AS logprob FROM other_cells)",
    "other_scores": "SELECT dataset_name, id_num, -sum(n * logprob) / sum(n) AS avg_nll, sum(n)::BIGINT AS num_tokens, "
    + ", ".join(
        f"-sum(greatest(0, least(n, greatest(1, floor(tokens * {r}e0)) - upto + n)) * logprob) / "
        f"greatest(1, floor(max(tokens) * {r}e0)) AS min_k_{k}"
        for r, k in zip(K_RATIOS, K_VALUES, strict=True)
    )
    + " FROM other_ordered GROUP BY ALL",
    "other_steps": " UNION ALL ".join(
        f"SELECT dataset_name, id_num, {s} AS step, bucket, n, n * ln({P[s]}) AS ll, "
        + (
            f"n * ln({P[s - 1]}) AS prior_ll, (n_prev * {P[s - 1]} - n) ** 2 AS prior_g"
            if s
            else "NULL::DOUBLE AS prior_ll, NULL::DOUBLE AS prior_g"
        )
        + " FROM other_cells"
        for s in STEPS
    ),
    "corners": "SELECT *, lag(pos) OVER w AS before, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg "
    "FROM eval_counts WINDOW w AS (PARTITION BY dataset_name, k ORDER BY score)",
    # --- the model of order three
    "grams": "SELECT dataset_name, id_num, seen, (at_pos - 1)::INTEGER AS pos, words[at_pos] AS tok, "
    "CASE WHEN at_pos = 1 THEN '' ELSE words[at_pos - 1] END AS prev, "
    "CASE WHEN at_pos <= 2 THEN '' ELSE words[at_pos - 2] END AS before FROM "
    "(SELECT *, unnest(range(1, len(words) + 1)) AS at_pos FROM listed)",
    "triples": "SELECT before, prev, tok, count(*) AS c FROM grams WHERE seen GROUP BY ALL",
    "kinds_of_pairs": "SELECT prev, tok, count(*) AS k FROM triples GROUP BY ALL",
    "kinds_of_words": "SELECT tok, count(*) AS k FROM kinds_of_pairs GROUP BY ALL",
    "low": f"SELECT tok, (greatest(coalesce(k, 0) - {DISCOUNT}e0, 0e0) + {DISCOUNT}e0 * "
    "(SELECT count(*) FROM kinds_of_words) / (SELECT count(*) + 1 FROM kinds_of_words)) / "
    "(SELECT sum(k) FROM kinds_of_words) AS p_low FROM (SELECT DISTINCT tok FROM grams) "
    "LEFT JOIN kinds_of_words USING (tok)",
    "middle": f"SELECT prev, tok, {_interpolated('k', 'p_low')} AS p_middle FROM "
    "(SELECT DISTINCT prev, tok FROM grams) LEFT JOIN kinds_of_pairs USING (prev, tok) "
    "LEFT JOIN (SELECT prev, sum(k) AS c_context, count(*) AS k_context FROM kinds_of_pairs GROUP BY prev) "
    "USING (prev) JOIN low USING (tok)",
    "high": f"SELECT before, prev, tok, ln({_interpolated('c', 'p_middle')}) AS logprob FROM "
    "(SELECT DISTINCT before, prev, tok FROM grams) LEFT JOIN triples USING (before, prev, tok) "
    "LEFT JOIN (SELECT before, prev, sum(c) AS c_context, count(*) AS k_context FROM triples GROUP BY ALL) "
    "USING (before, prev) JOIN middle USING (prev, tok)",
    "longer_logprobs": "SELECT dataset_name, id_num, pos, tok AS token, logprob "
    "FROM grams JOIN high USING (before, prev, tok) WHERE pos > 0",
    # --- evaluation
    "train_counts": "SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, "
    "sum(pos) OVER g AS total_pos, sum(neg) OVER g AS total_neg FROM (SELECT dataset_name, k, score, "
    "count(*) FILTER (WHERE seen) AS pos, count(*) FILTER (WHERE NOT seen) AS neg "
    "FROM long WHERE split = 'train' GROUP BY ALL) "
    "WINDOW g AS (PARTITION BY dataset_name, k), w AS (PARTITION BY dataset_name, k ORDER BY score)",
    "eval_counts": "SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, "
    "sum(pos) OVER g AS total_pos, sum(neg) OVER g AS total_neg FROM (SELECT dataset_name, k, score, "
    "count(*) FILTER (WHERE seen) AS pos, count(*) FILTER (WHERE NOT seen) AS neg "
    "FROM long WHERE split = 'eval' GROUP BY ALL) "
    "WINDOW g AS (PARTITION BY dataset_name, k), w AS (PARTITION BY dataset_name, k ORDER BY score)",
    "train_right": "SELECT *, cum_pos - pos + total_neg - (cum_neg - neg) AS n_right FROM train_counts",
    "train_best": "SELECT dataset_name, k, score, n_right, total_pos + total_neg AS n_rows "
    "FROM train_right QUALIFY row_number() OVER "
    "(PARTITION BY dataset_name, k ORDER BY n_right DESC, score) = 1",
    "medians": "SELECT dataset_name, k, median(score) AS median FROM long "
    "WHERE split = 'train' GROUP BY ALL",
    "train_auc": "SELECT dataset_name, k, CASE WHEN max(total_pos) * max(total_neg) = 0 THEN 0.5e0 ELSE "
    "sum(pos * (total_neg - cum_neg + neg / 2e0)) / (max(total_pos) * max(total_neg))::DOUBLE END "
    "AS train_auc FROM train_counts GROUP BY ALL",
    "eval_auc": "SELECT dataset_name, k, CASE WHEN max(total_pos) * max(total_neg) = 0 THEN 0.5e0 ELSE "
    "sum(pos * (total_neg - cum_neg + neg / 2e0)) / (max(total_pos) * max(total_neg))::DOUBLE END "
    "AS eval_auc FROM eval_counts GROUP BY ALL",
    "thresholds": "SELECT dataset_name, k, CASE WHEN n_right > 0 THEN score ELSE median END AS threshold, "
    "n_right / n_rows::DOUBLE AS train_accuracy, train_auc "
    "FROM train_best JOIN medians USING (dataset_name, k) JOIN train_auc USING (dataset_name, k)",
    "judged": "SELECT dataset_name, k, "
    "avg(CASE WHEN (score < threshold) = seen THEN 1e0 ELSE 0e0 END) AS eval_accuracy, "
    "avg(score) FILTER (WHERE seen) AS seen_mean, avg(score) FILTER (WHERE NOT seen) AS unseen_mean "
    "FROM long JOIN thresholds USING (dataset_name, k) WHERE split = 'eval' GROUP BY ALL",
    "metrics": "SELECT dataset_name, k, threshold, train_accuracy, eval_accuracy, train_auc, eval_auc, "
    "seen_mean, unseen_mean FROM thresholds JOIN judged USING (dataset_name, k) "
    "JOIN eval_auc USING (dataset_name, k)",
    "compared": "SELECT d.dataset_name, a.eval_auc AS k20_auc, a.eval_accuracy AS k20_accuracy, "
    "b.eval_auc AS k30_auc, b.eval_accuracy AS k30_accuracy FROM "
    f"(SELECT unnest({_texts(REPORT_DATASETS)}) AS dataset_name) d "
    "LEFT JOIN metrics a ON a.dataset_name = d.dataset_name AND a.k = 20 "
    "LEFT JOIN metrics b ON b.dataset_name = d.dataset_name AND b.k = 30",
    # --- trajectories
    "model_cells": "SELECT c.*, c_pair, c_prev, base, "
    "instr('0123456789abcdef', substr(md5(prev || ' ' || tok), 1, 1)) - 1 AS bucket "
    "FROM cells c JOIN model USING (prev, tok) WHERE prev <> ''",
    "cell_steps": " UNION ALL ".join(
        f"SELECT dataset_name, id_num, {s} AS step, bucket, n, n * ln({P[s]}) AS ll, "
        + (
            f"n * ln({P[s - 1]}) AS prior_ll, (n_prev * {P[s - 1]} - n) ** 2 AS prior_g"
            if s
            else "NULL::DOUBLE AS prior_ll, NULL::DOUBLE AS prior_g"
        )
        + " FROM model_cells"
        for s in STEPS
    ),
    "states": "SELECT dataset_name, split, id_num, step, t.* EXCLUDE (dataset_name, id_num, step) FROM "
    "(SELECT dataset_name, id_num, step, round(-sum(prior_ll) / sum(n), 9) AS loss, "
    "round(sqrt(sum(prior_g)) / sum(n), 9) AS grad_norm, "
    + ", ".join(
        f"round(coalesce(sum(ll) FILTER (WHERE bucket = {i}), 0e0) / sum(n), 9) AS e{i}"
        for i in range(DIM)
    )
    + " FROM cell_steps GROUP BY dataset_name, id_num, step) t "
    "JOIN (SELECT dataset_name, id_num, split FROM items) USING (dataset_name, id_num)",
    "geometry": "SELECT b.*, sqrt("
    + " + ".join(f"(b.e{i} - a.e{i}) ** 2" for i in range(DIM))
    + ") AS l2, acos(greatest(-1e0, least(1e0, ("
    + " + ".join(f"b.e{i} * a.e{i}" for i in range(DIM))
    + ") / ((sqrt("
    + " + ".join(f"a.e{i} ** 2" for i in range(DIM))
    + ") + 1e-8) * (sqrt("
    + " + ".join(f"b.e{i} ** 2" for i in range(DIM))
    + ") + 1e-8))))) AS angle FROM states b JOIN states a USING (dataset_name, id_num) "
    "WHERE a.step = 0 AND b.step > 0",
    "features": "SELECT dataset_name, split, id_num, seen, "
    + ", ".join(
        f"max({column}) FILTER (WHERE step = {i}) AS {stem}_Step{i}"
        for stem, column in (
            ("Loss", "loss"),
            ("GradNorm", "grad_norm"),
            ("L2Dist", "l2"),
            ("Angle", "angle"),
        )
        for i in range(1, NUM_STEPS + 1)
    )
    + " FROM geometry JOIN (SELECT dataset_name, id_num, seen FROM items) "
    "USING (dataset_name, id_num) GROUP BY ALL",
    "scaler": "SELECT dataset_name, "
    + ", ".join(
        f"avg({f}) AS m_{f}, CASE WHEN min({f}) = max({f}) THEN 1e0 ELSE stddev_pop({f}) END AS d_{f}"
        for f in FEATURES
    )
    + " FROM features WHERE split = 'train' GROUP BY dataset_name",
    # --- classifiers: accelerated gradient steps on the same strictly convex objective
    "scaled": "SELECT dataset_name, split, id_num, seen, ["
    + ", ".join(f"({f} - m_{f}) / d_{f}" for f in FEATURES)
    + ", 1e0] AS x FROM features JOIN scaler USING (dataset_name)",
    "class_sizes": "SELECT dataset_name, count(*)::DOUBLE AS n, count(*) FILTER (WHERE seen)::DOUBLE AS n_seen "
    "FROM scaled WHERE split = 'train' GROUP BY dataset_name",
    "weighted": "SELECT dataset_name, x, CASE WHEN seen THEN 1e0 ELSE 0e0 END AS y, "
    "n / (2 * CASE WHEN seen THEN n_seen ELSE n - n_seen END) AS weight "
    "FROM scaled JOIN class_sizes USING (dataset_name) WHERE split = 'train'",
    "bounds": "SELECT dataset_name, 1 + sum(weight * list_dot_product(x, x)) / 4 AS steepest "
    "FROM weighted GROUP BY dataset_name",
    "descent": f"SELECT dataset_name, 0 AS turn, list_transform(range({len(FEATURES) + 1}), lambda i: 0e0) AS w, "
    f"list_transform(range({len(FEATURES) + 1}), lambda i: 0e0) AS v FROM bounds UNION ALL "
    "SELECT dataset_name, turn + 1, next_w, list_transform(list_zip(next_w, w), "
    "lambda p: p[1] + (sqrt(steepest) - 1) / (sqrt(steepest) + 1) * (p[1] - p[2])) FROM "
    "(SELECT dataset_name, turn, w, steepest, ["
    + ", ".join(
        f"v[{i}] - (sum(rest * x[{i}]) + {'v[%d]' % i if i <= len(FEATURES) else '0'}) / steepest"
        for i in range(1, len(FEATURES) + 2)
    )
    + "] AS next_w FROM (SELECT d.dataset_name, turn, w, v, steepest, x, "
    "weight * (1 / (1 + exp(-list_dot_product(x, v))) - y) AS rest FROM descent d "
    "JOIN weighted USING (dataset_name) JOIN bounds USING (dataset_name) "
    f"WHERE turn < {DESCENT_TURNS}) GROUP BY dataset_name, turn, w, v, steepest)",
    "coefficients": f"SELECT dataset_name, w FROM descent WHERE turn = {DESCENT_TURNS}",
    "ranked": f"SELECT dataset_name, unnest({_texts(FEATURES)}) AS feature, unnest(w[1:{len(FEATURES)}]) AS coefficient "
    "FROM coefficients",
    "classified": "SELECT dataset_name, seen, list_dot_product(x, w) > 0 AS predicted, "
    "-(1 / (1 + exp(-list_dot_product(x, w)))) AS score "
    "FROM scaled JOIN coefficients USING (dataset_name) WHERE split = 'eval'",
    "trace_counts": "SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, "
    "sum(pos) OVER g AS total_pos, sum(neg) OVER g AS total_neg FROM (SELECT dataset_name, score, "
    "count(*) FILTER (WHERE seen) AS pos, count(*) FILTER (WHERE NOT seen) AS neg "
    "FROM classified GROUP BY ALL) "
    "WINDOW g AS (PARTITION BY dataset_name), w AS (PARTITION BY dataset_name ORDER BY score)",
    "trace_results": "SELECT dataset_name, auc, accuracy FROM (SELECT dataset_name, "
    "CASE WHEN max(total_pos) * max(total_neg) = 0 THEN 0.5e0 ELSE "
    "sum(pos * (total_neg - cum_neg + neg / 2e0)) / (max(total_pos) * max(total_neg))::DOUBLE END AS auc "
    "FROM trace_counts GROUP BY ALL) JOIN (SELECT dataset_name, "
    "avg(CASE WHEN predicted = seen THEN 1e0 ELSE 0e0 END) AS accuracy FROM classified GROUP BY ALL) "
    "USING (dataset_name)",
    "series": "SELECT 'trace' AS method, dataset_name, cum_neg / total_neg::DOUBLE AS fpr, "
    "cum_pos / total_pos::DOUBLE AS tpr FROM trace_counts UNION ALL "
    "SELECT 'min_k', dataset_name, cum_neg / total_neg::DOUBLE, cum_pos / total_pos::DOUBLE "
    "FROM eval_counts WHERE k = 30 UNION ALL "
    "SELECT DISTINCT 'trace', dataset_name, 0e0, 0e0 FROM trace_counts UNION ALL "
    "SELECT DISTINCT 'min_k', dataset_name, 0e0, 0e0 FROM eval_counts",
    "areas": "SELECT 'trace' AS method, dataset_name, auc FROM trace_results UNION ALL "
    "SELECT 'min_k', dataset_name, eval_auc FROM eval_auc WHERE k = 30",
    # --- embeddings as stored trajectories
    "vectors": "SELECT vec_id // 6 AS id_num, vec_id % 6 AS step, embedding::DOUBLE[] AS v FROM embeddings",
    "whole_vectors": "SELECT * FROM vectors WHERE id_num IN "
    "(SELECT id_num FROM vectors GROUP BY id_num HAVING count(DISTINCT step) = 6)",
    "vector_pairs": "SELECT b.id_num, b.step, list_zip(a.v, b.v) AS ab FROM whole_vectors b "
    "JOIN whole_vectors a ON a.id_num = b.id_num AND a.step = 0 WHERE b.step > 0",
    **_word_vectors(VECTOR_DIM),
    "last_words": "SELECT dataset_name, id_num, coalesce(max(pos) FILTER (WHERE content), "
    "max(pos))::INTEGER AS last_pos, coalesce(arg_max(tok, pos) FILTER (WHERE content), "
    "arg_max(tok, pos)) AS last_token FROM (SELECT *, regexp_matches(tok, '[\\p{L}\\p{N}]') AS content "
    "FROM positions) GROUP BY ALL",
    **_adam(),
    # --- label parts
    "source_rows": "SELECT source || '-' || lang AS dataset_name, doc_id AS id_num FROM documents",
}

# The same steps from other states.
TRACE = ["states", "geometry", "features", "scaler", "scaled", "class_sizes", "weighted", "bounds", "descent"]
TRACE += ["coefficients", "classified", "trace_counts", "trace_results"]
SCORING = ["logprobs", "ordered", "sample_scores", "scores", "long", "train_counts", "eval_counts", "train_right"]
SCORING += ["train_best", "medians", "train_auc", "eval_auc", "thresholds", "judged", "metrics"]
WITH |= {
    f"longer_{name}": re.sub(rf"(FROM|JOIN) ({'|'.join(SCORING)})\b", r"\1 longer_\2", WITH[name]) for name in SCORING[1:]
}
WITH |= {
    f"adam_{name}": re.sub(rf"(FROM|JOIN) ({'|'.join(TRACE)})\b", r"\1 adam_\2", WITH[name]) for name in TRACE[1:]
}

WINDOWLESS = re.compile(r"[a-z_]+")


def _twin(final: str) -> str:
    """``final`` with the steps it needs, each step before those that read it."""
    needed: list[str] = []

    def add(sql: str) -> None:
        for name in WINDOWLESS.findall(sql):
            if name in WITH and name not in needed and name in _reads(sql) and sql != WITH[name]:
                add(WITH[name])
                needed.append(name)

    add(final)
    if not needed:
        return final
    steps = ",\n".join(
        f"{name} AS {'' if name in _reads(WITH[name]) else 'MATERIALIZED '}({WITH[name]})"
        for name in needed
    )
    return f"WITH RECURSIVE {steps}\n{final}"


def _reads(sql: str) -> set[str]:
    return set(re.findall(r"(?:FROM|JOIN)\s+\(*\s*([a-z_]+)", sql))


def _round(columns: list[str]) -> str:
    return ", ".join(f"round({c} + 1e-10, 6) AS {c}" for c in columns)


def _chat(source: str, answer: str) -> str:
    return (
        "SELECT src_id, 'user' AS first_role, instruction_text AS first_content, "
        f"'assistant' AS second_role, {answer} AS second_content FROM {source}"
    )


METRIC_COLUMNS = [
    "threshold",
    "train_accuracy",
    "eval_accuracy",
    "train_auc",
    "eval_auc",
    "seen_mean",
    "unseen_mean",
]
MIN_K = [f"min_k_{k}" for k in K_VALUES]
METRICS = f"SELECT dataset_name, k, {_round(METRIC_COLUMNS)} FROM metrics"
SQUARE = "list_sum(list_transform(ab, lambda p: {0} * {0}))"

FINAL = {
    "scan_items": "SELECT * FROM docs",
    "source_items": "SELECT dataset_name, src_id, problem AS question, level AS choices, "
    "solution AS answer FROM math UNION ALL "
    "SELECT dataset_name, src_id, question, array_to_string(labels, ',') || '|' || "
    "array_to_string(texts, ','), answer_key FROM labeled UNION ALL "
    "SELECT dataset_name, src_id, question, array_to_string(choices, ','), answer::VARCHAR FROM fixed",
    "roundtrip_partitions": "SELECT dataset_name, split, id_num, seen, instruction_text FROM items",
    "rewritten_parts": "SELECT dataset_name, split, id_num, seen FROM items WHERE NOT "
    "(dataset_name = 'en' AND split = 'train') UNION ALL SELECT dataset_name, split, id_num, true "
    "FROM items WHERE dataset_name = 'en' AND split = 'train' AND NOT seen",
    "write_verified": "SELECT dataset_name, count(*) AS n_read, any_value(n_rows) AS n_rows, "
    "0::BIGINT AS n_not_seen, any_value(n_no_text) AS null_instruction_text, 0::BIGINT AS null_id_num, "
    "any_value(n_long) AS long_text FROM labelled, (SELECT count(*) AS n_rows, "
    "count(*) FILTER (WHERE instruction_text IS NULL) AS n_no_text, "
    "count(*) FILTER (WHERE length(instruction_text) > 1000) AS n_long FROM labelled WHERE seen) "
    "WHERE seen GROUP BY dataset_name",
    "path_columns": "SELECT dataset_name, 'probe' AS level, split, count(*) AS n_rows, "
    "count(*) FILTER (WHERE seen) AS n_seen FROM items GROUP BY ALL",
    "paired_datasets": "SELECT * FROM source_rows WHERE id_num NOT IN (SELECT doc_id FROM labels) "
    "AND dataset_name IN (SELECT dataset_name FROM source_rows WHERE id_num IN "
    "(SELECT doc_id FROM labels))",
    "trajectory_roundtrip": "SELECT dataset_name, split, id_num, step, "
    + _round(["loss", "grad_norm", "e0"])
    + " FROM states",
    "complete_datasets": "SELECT 'vectors' AS dataset_name, count(DISTINCT id_num) AS n_samples, "
    "count(*) AS n_states FROM whole_vectors",
    "trajectory_summary": "SELECT dataset_name, split, count(*) FILTER (WHERE step = 0) AS num_samples, "
    f"(max(step) + 1)::BIGINT AS num_states, {DIM}::BIGINT AS dim, min(id_num) AS id_num_min, "
    "max(id_num) AS id_num_max, bool_or(loss IS NOT NULL) AS has_losses, "
    "bool_or(grad_norm IS NOT NULL) AS has_grad_norms FROM states GROUP BY ALL",
    "metrics_json": METRICS,
    "filter_levels": "SELECT src_id, level FROM math_kept",
    "keep_seen": "SELECT dataset_name, id_num FROM labelled WHERE seen",
    "verify_seen": "SELECT dataset_name, count(*) AS n_rows, count(*) FILTER (WHERE NOT seen) "
    "AS n_not_seen, 'all' AS stage FROM labelled GROUP BY dataset_name UNION ALL "
    "SELECT dataset_name, count(*), count(*) FILTER (WHERE NOT seen), 'kept' FROM labelled "
    "WHERE seen GROUP BY dataset_name",
    "validate_items": "SELECT dataset_name, count(*) AS n_rows, "
    "count(*) FILTER (WHERE problem IS NULL) AS null_instruction_text, "
    "count(*) FILTER (WHERE src_id IS NULL) AS null_id_num, "
    "count(*) FILTER (WHERE solution IS NULL) AS bad_answer FROM math_all GROUP BY dataset_name "
    "UNION ALL SELECT dataset_name, count(*), count(*) FILTER (WHERE instruction_text IS NULL), "
    "count(*) FILTER (WHERE src_id IS NULL), count(*) FILTER (WHERE answer NOT BETWEEN 0 AND 3) "
    "FROM fixed GROUP BY dataset_name",
    "prompt_math": "SELECT src_id, instruction_text FROM math",
    "prompt_choice_labeled": "SELECT src_id, instruction_text FROM labeled",
    "prompt_choice_fixed": "SELECT src_id, instruction_text FROM fixed",
    "chat_math": _chat("math", "solution"),
    "chat_choice_index": _chat(
        "fixed", f"'{ANSWER_PREFIX}' || {_texts(prompts.FIXED_LABELS)}[answer + 1]"
    ),
    "chat_choice_key": _chat("labeled", f"'{ANSWER_PREFIX}' || answer_key"),
    "assign_ids": "SELECT dataset_name, src_id, id_num, split FROM fixed_numbered",
    "tokens": "SELECT dataset_name, id_num, pos, tok AS token FROM positions",
    "tokens_max_length": "SELECT dataset_name, id_num, "
    f"least(len(words), {MAX_LENGTH})::BIGINT AS n_tokens, "
    f"(least(len(words), {MAX_LENGTH}) - 1)::INTEGER AS last_pos FROM listed WHERE len(words) > 0",
    "sample_exact": "SELECT dataset_name, src_id, question FROM labeled_sample",
    "split_positional": "SELECT dataset_name, src_id, id_num, split FROM labeled_sample_numbered",
    "sample_stratified": "SELECT dataset_name, src_id, level FROM ("
    + _stratified(STRATIFIED_ROWS)
    + ")",
    "label_seen": "SELECT dataset_name, id_num, seen FROM labelled",
    "split_stratified_half": "SELECT dataset_name, id_num, seen, split FROM items",
    "shuffle_key": "SELECT dataset_name, id_num, "
    + _key("shuffle", "dataset_name", "id_num")
    + " AS shuffle_key FROM docs",
    "label_join": "SELECT lang AS dataset_name, doc_id AS id_num, coalesce(quality = 1, false) AS seen "
    "FROM documents LEFT JOIN labels USING (doc_id)",
    "apply_thresholds": "SELECT s.dataset_name, s.id_num, s.seen, s.num_tokens, "
    + ", ".join(f"round(max(s.min_k_{k}) + 1e-10, 6) AS min_k_{k}" for k in K_VALUES)
    + ", "
    + ", ".join(
        f"round(max(threshold) FILTER (WHERE k = {k}) + 1e-10, 6) AS epsilon_k_{k}, "
        f"round(max(train_auc) FILTER (WHERE k = {k}) + 1e-10, 6) AS auc_k_{k}, "
        f"max(s.min_k_{k}) < max(threshold) FILTER (WHERE k = {k}) AS pred_k_{k}"
        for k in K_VALUES
    )
    + " FROM scores s JOIN thresholds USING (dataset_name) WHERE s.split = 'eval' "
    "GROUP BY s.dataset_name, s.id_num, s.seen, s.num_tokens",
    "compare_methods": "SELECT upper(dataset_name) AS dataset, "
    + _round([f"{m}_{x}" for m in METHODS for x in ("auc", "accuracy")])
    + " FROM compared",
    "eval_anti": "SELECT dataset_name, id_num, seen FROM items WHERE split <> 'train'",
    "concat_strata": "SELECT dataset_name, id_num, split || '-' || "
    "CASE WHEN seen THEN 'seen' ELSE 'unseen' END AS stratum FROM items",
    "multi_task_union": "SELECT global_index, dataset_name, id_num, first_content, second_content FROM tasks",
    "fetch_by_index": "SELECT item_id * 450 AS global_index, dataset_name, id_num, "
    "dataset_name IS NOT NULL AS found FROM benchmark LEFT JOIN tasks "
    "ON item_id * 450 = global_index",
    "composition": "SELECT coalesce(dataset_name, 'total') AS dataset_name, count(*) AS n_rows "
    "FROM prepared GROUP BY ROLLUP (dataset_name)",
    "split_report": "SELECT dataset_name, split, count(*) AS n_rows, "
    "count(*) FILTER (WHERE seen) AS n_seen FROM prepared GROUP BY ALL",
    "seen_means": "SELECT dataset_name, k, round(avg(score) FILTER (WHERE seen) + 1e-10, 6) AS seen_mean, "
    "round(avg(score) FILTER (WHERE NOT seen) + 1e-10, 6) AS unseen_mean FROM long GROUP BY ALL",
    "strata_quota": "SELECT dataset_name, count(DISTINCT level) AS n_strata, "
    f"({SAMPLE_ROWS} // count(DISTINCT level))::BIGINT AS quota FROM math_kept GROUP BY dataset_name",
    "ngram_model": "SELECT prev, tok, c_pair, c_prev, c_tok FROM model WHERE c_pair > 0",
    "token_logprobs": "SELECT dataset_name, id_num, pos, token, round(logprob + 1e-10, 6) AS logprob FROM logprobs",
    "token_logprobs_order3": "SELECT dataset_name, id_num, pos, token, round(logprob + 1e-10, 6) AS logprob "
    "FROM longer_logprobs",
    "score_table_order3": "SELECT dataset_name, id_num, split, seen, num_tokens, "
    + _round(["avg_nll", *MIN_K])
    + " FROM longer_scores",
    "metrics_order3": METRICS.replace("FROM metrics", "FROM longer_metrics"),
    "sample_perplexity": "SELECT dataset_name, id_num, "
    + _round(["perplexity", "avg_nll"])
    + ", num_tokens FROM sample_scores",
    "min_k_scores": f"SELECT dataset_name, id_num, num_tokens, {_round(MIN_K)} FROM scores",
    "score_table": "SELECT dataset_name, id_num, split, seen, num_tokens, "
    + _round(["perplexity", "avg_nll", *MIN_K])
    + " FROM scores",
    "score_other_texts": "SELECT dataset_name, id_num, coalesce(num_tokens, 0) AS num_tokens, "
    "round(avg_nll + 1e-10, 6) AS avg_nll, "
    + ", ".join(f"round(round(coalesce(min_k_{k}, 0e0), 9) + 1e-10, 6) AS min_k_{k}" for k in K_VALUES)
    + " FROM (SELECT * FROM items WHERE split = 'eval') LEFT JOIN other_scores USING (dataset_name, id_num)",
    "trajectory_other_texts": "SELECT dataset_name, 'eval' AS split, id_num, step, "
    "round(round(-sum(prior_ll) / sum(n), 9) + 1e-10, 6) AS loss, "
    "round(round(sqrt(sum(prior_g)) / sum(n), 9) + 1e-10, 6) AS grad_norm, "
    "round(round(coalesce(sum(ll) FILTER (WHERE bucket = 0), 0e0) / sum(n), 9) + 1e-10, 6) AS e0 "
    "FROM other_steps GROUP BY dataset_name, id_num, step",
    "complete_parts": "SELECT dataset_name, split, count(*) AS n_states FROM states WHERE dataset_name IN "
    "(SELECT dataset_name FROM states GROUP BY dataset_name HAVING count(DISTINCT split) = 2 "
    "AND bool_and(e0 IS NOT NULL)) GROUP BY ALL",
    "summary_of_nothing": "SELECT 'all' AS part, count(*) FILTER (WHERE step = 0) AS num_samples, "
    "min(id_num) AS id_num_min, max(id_num) AS id_num_max, false AS has_losses, false AS has_grad_norms "
    "FROM vectors UNION ALL SELECT 'beyond', 0, 0, 0, false, false",
    "roc_corners": "SELECT dataset_name, k, round(cum_neg / total_neg::DOUBLE + 1e-10, 6) AS fpr, "
    "round(cum_pos / total_pos::DOUBLE + 1e-10, 6) AS tpr FROM corners "
    "WHERE before IS NULL OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg "
    "UNION ALL SELECT DISTINCT dataset_name, k, 0e0, 0e0 FROM corners",
    "last_content_token": "SELECT dataset_name, id_num, last_pos, last_token, "
    + ", ".join(f"round(coalesce(v{i}, 0e0) + 1e-10, 6) + 0e0 AS v{i}" for i in range(VECTOR_DIM))
    + " FROM last_words LEFT JOIN word_vectors ON tok = last_token",
    "trajectory": "SELECT dataset_name, split, id_num, step, "
    + _round(["loss", "grad_norm", *[f"e{i}" for i in range(DIM)]])
    + " FROM states",
    "adam_trajectory": "SELECT dataset_name, split, id_num, step, "
    + _round(["loss", "grad_norm", *[f"e{i}" for i in range(BUCKETS)]])
    + " FROM adam_states",
    "adam_features": f"SELECT dataset_name, split, id_num, seen, {_round(FEATURES)} FROM adam_features",
    "adam_eval": f"SELECT dataset_name, {_round(['auc', 'accuracy'])} FROM adam_trace_results",
    "auc_by_k": "SELECT dataset_name, k, round(CASE WHEN sum(pos) * sum(neg) = 0 THEN 0.5e0 ELSE "
    "sum(pos * (total_neg - cum_neg + neg / 2e0)) / (sum(pos) * sum(neg))::DOUBLE END + 1e-10, 6) AS auc "
    "FROM (SELECT *, sum(neg) OVER (PARTITION BY dataset_name, k ORDER BY score) AS cum_neg, "
    "sum(neg) OVER (PARTITION BY dataset_name, k) AS total_neg FROM (SELECT dataset_name, k, score, "
    "count(*) FILTER (WHERE seen) AS pos, count(*) FILTER (WHERE NOT seen) AS neg FROM long GROUP BY ALL)) "
    "GROUP BY dataset_name, k",
    "best_threshold": "SELECT dataset_name, k, "
    + _round(["threshold", "train_accuracy", "train_auc"])
    + " FROM thresholds",
    "eval_accuracy": "SELECT dataset_name, k, round(eval_accuracy + 1e-10, 6) AS eval_accuracy FROM judged",
    "roc_points": "SELECT dataset_name, k, round(cum_neg / total_neg::DOUBLE + 1e-10, 6) AS fpr, "
    "round(cum_pos / total_pos::DOUBLE + 1e-10, 6) AS tpr FROM eval_counts UNION ALL "
    "SELECT DISTINCT dataset_name, k, 0e0, 0e0 FROM eval_counts",
    "metrics_summary": METRICS,
    "step_l2": "SELECT 'vectors' AS dataset_name, id_num, step::INTEGER AS step, round(sqrt("
    + SQUARE.format("(p[1] - p[2])")
    + ") + 1e-10, 6) AS l2 FROM vector_pairs",
    "step_angle": "SELECT 'vectors' AS dataset_name, id_num, step::INTEGER AS step, "
    "round(acos(greatest(-1e0, least(1e0, list_sum(list_transform(ab, lambda p: p[1] * p[2])) / ((sqrt("
    + SQUARE.format("p[1]")
    + ") + 1e-8) * (sqrt("
    + SQUARE.format("p[2]")
    + ") + 1e-8))))) + 1e-10, 6) AS angle FROM vector_pairs",
    "trace_features": f"SELECT dataset_name, split, id_num, seen, {_round(FEATURES)} FROM features",
    "scaled_features": "SELECT dataset_name, split, id_num, seen, "
    + ", ".join(f"round(({f} - m_{f}) / d_{f} + 1e-10, 6) AS {f}" for f in FEATURES)
    + " FROM features JOIN scaler USING (dataset_name)",
    "trace_coefficients": "SELECT dataset_name, feature, round(round(coefficient, 3) + 1e-10, 6) AS coefficient FROM ranked",
    "top_coefficients": "SELECT dataset_name, place::INTEGER AS rank, feature, "
    "round(round(coefficient, 3) + 1e-10, 6) AS coefficient, "
    "CASE WHEN coefficient > 0 THEN '+' ELSE '-' END AS sign FROM (SELECT *, row_number() OVER "
    "(PARTITION BY dataset_name ORDER BY abs(coefficient) DESC, feature) AS place FROM ranked) "
    f"WHERE place <= {TOP_FEATURES}",
    "trace_eval": f"SELECT dataset_name, {_round(['auc', 'accuracy'])} FROM trace_results",
    "roc_series": f"SELECT method, dataset_name, {_round(['fpr', 'tpr', 'auc'])} "
    "FROM series JOIN areas USING (method, dataset_name)",
    "summary": f"SELECT 'trace' AS method, dataset_name, {_round(['auc', 'accuracy'])} FROM trace_results "
    "UNION ALL SELECT 'min_k', dataset_name, round(eval_auc + 1e-10, 6), round(eval_accuracy + 1e-10, 6) "
    "FROM metrics WHERE k = 30",
    "bar_series": " UNION ALL ".join(
        f"SELECT upper(dataset_name) AS dataset, '{m}' AS method, '{x}' AS measure, "
        f"round(coalesce({m}_{x}, 0e0) + 1e-10, 6) AS value FROM compared"
        for m in METHODS
        for x in ("auc", "accuracy")
    ),
    "k_sweep": "SELECT d.dataset_name, d.k, round(coalesce(m.eval_auc, 0e0) + 1e-10, 6) AS eval_auc, "
    "round(coalesce(m.eval_accuracy, 0e0) + 1e-10, 6) AS eval_accuracy FROM (SELECT *, "
    f"unnest({SWEEP_K}) AS k FROM (SELECT DISTINCT dataset_name FROM metrics)) d "
    "LEFT JOIN metrics m ON m.dataset_name IS NOT DISTINCT FROM d.dataset_name AND m.k = d.k",
    "min_k_representative": "SELECT dataset_name, round(eval_auc + 1e-10, 6) AS auc, "
    "round(eval_accuracy + 1e-10, 6) AS accuracy FROM metrics WHERE k = 30",
}

ORACLE_SQL = {name: _twin(sql) for name, sql in FINAL.items()}
