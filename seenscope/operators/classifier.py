"""One class-balanced logistic regression per dataset on scaled trajectory features.

All datasets are fitted together by Newton's method. The state of the fits is a table with one
row per dataset; a turn is one grouped sum over the rows of all unfinished datasets (loss,
gradient and curvature at the state's trial point, added up on the map side) and one step of
each state. So the number of jobs depends on the turns of the slowest fit, not on the number
of datasets, and nothing of a dataset reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seenscope.plans.joins import null_safe_join
from seenscope.plans.materialize import materialize
from seenscope.plans.workers import reachable

# Most iterations, and rows shown of the coefficient ranking.
MAX_ITER = 2000
TOP_FEATURES = 15
# A step must lower the loss by this share of what the slope promises.
LEAST_GAIN = 1e-4
STATE = (
    "dataset_name STRING, point ARRAY<DOUBLE>, base ARRAY<DOUBLE>, direction ARRAY<DOUBLE>, "
    "base_loss DOUBLE, slope DOUBLE, step DOUBLE, turns INT, done BOOLEAN"
)


def class_weights(train: DataFrame) -> DataFrame:
    """Rows per dataset and weight ``rows / (2 * rows of the class)`` of each class."""
    return train.groupBy("dataset_name").agg(
        F.count("*").alias("n_rows"),
        F.try_divide(F.count("*"), 2 * F.count_if("seen")).alias("seen_weight"),
        F.try_divide(F.count("*"), 2 * F.count_if(~F.col("seen"))).alias("unseen_weight"),
    )


def _sums(train: DataFrame, states: DataFrame, names: list[str]) -> DataFrame:
    """Per dataset the weighted loss, its gradient and the upper half of its curvature at the
    state's point, without the penalty, as one array."""
    x = F.array(F.lit(1.0), *names)
    margin = F.aggregate(F.zip_with("x", "point", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    y = F.col("seen").cast("double")
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
    # ln(1 + exp(m)) - y m, without overflow.
    loss = F.greatest("margin", F.lit(0.0)) + F.log1p(F.exp(-F.abs("margin"))) - y * F.col("margin")

    def scaled(by: Column) -> Column:
        return F.transform("x", lambda v: v * by)

    halves = F.flatten(
        F.transform("x", lambda a, i: F.transform(F.slice("x", F.lit(1), i + 1), lambda b: a * b * F.col("bend")))
    )
    rows = (
        null_safe_join(train.withColumn("x", x), states.select("dataset_name", "point"), ["dataset_name"], "inner")
        .select("dataset_name", "seen", "weight", "x", margin.alias("margin"))
        .select("dataset_name", "weight", "x", loss.alias("loss"), (p - y).alias("rest"), (p * (1 - p)).alias("bend"))
    )
    parts = F.concat(F.array("loss"), scaled(F.col("rest")), halves)
    summed = rows.select("dataset_name", "weight", array_to_vector(parts).alias("parts"))
    return summed.groupBy("dataset_name").agg(
        vector_to_array(Summarizer.sum(F.col("parts"), F.col("weight"))).alias("sums")
    )


def newton(state: dict, sums: np.ndarray, tol: float) -> dict:
    """The next state of one fit from the sums at its point.

    A point that lowers the loss too little is tried again half as far; an accepted one gives
    the next direction. The fit is done when the loss cannot fall by more than ``tol`` of it.
    """
    point = np.array(state["point"])
    n = len(point)
    penalty = np.ones(n)
    penalty[0] = 0  # the intercept
    loss = sums[0] + 0.5 * (penalty * point * point).sum()
    promised = state["step"] * state["slope"]
    if state["turns"] and loss > state["base_loss"] - LEAST_GAIN * promised and promised > tol * abs(loss):
        step = state["step"] / 2
        ahead = np.array(state["base"]) + step * np.array(state["direction"])
        return state | {"point": ahead.tolist(), "step": step, "turns": state["turns"] + 1}
    gradient = sums[1 : n + 1] + penalty * point
    curve = np.zeros((n, n))
    curve[np.tril_indices(n)] = sums[n + 1 :]
    curve = curve + np.tril(curve, -1).T + np.diag(penalty)
    direction = -np.linalg.lstsq(curve, gradient, rcond=None)[0]
    slope = float(-direction @ gradient)
    return {
        "dataset_name": state["dataset_name"],
        "point": (point + direction).tolist(),
        "base": point.tolist(),
        "direction": direction.tolist(),
        "base_loss": float(loss),
        "slope": slope,
        "step": 1.0,
        "turns": state["turns"] + 1,
        "done": bool(slope <= tol * abs(loss) or state["turns"] + 1 >= MAX_ITER),
    }


def _step(batches, tol: float):
    names = [part.split()[0] for part in STATE.split(", ")]
    for batch in batches:
        rows = [newton({k: r[k] for k in names}, np.array(r["sums"]), tol) for r in batch.to_pylist()]
        kinds = [batch.schema.field(n).type for n in names]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names
        )


def fit_classifiers(train: DataFrame, names: list[str], tol: float = 1e-15) -> DataFrame:
    """Coefficients per dataset, in the order of ``names``, written: one row per dataset. A
    dataset whose rows are all of one class has none: its values are null.

    The penalty is half the squared norm of the coefficients against the weighted sum of
    losses (C = 1). Rows with a null label or feature are left out.
    """
    reachable(train.sparkSession)
    complete = train.select("dataset_name", "seen", *names).na.drop(subset=["seen", *names])
    weights = materialize(class_weights(complete), "class-weights")
    two = weights.where("seen_weight IS NOT NULL AND unseen_weight IS NOT NULL")
    weight = F.when(F.col("seen"), F.col("seen_weight")).otherwise(F.col("unseen_weight"))
    weighted = null_safe_join(complete, two, ["dataset_name"], "inner").select(
        "dataset_name", "seen", *names, weight.alias("weight")
    )
    weighted = materialize(weighted, "weighted")
    zeros = F.array(*[F.lit(0.0)] * (len(names) + 1))
    open_fits = materialize(
        two.select(
            "dataset_name",
            zeros.alias("point"),
            zeros.alias("base"),
            zeros.alias("direction"),
            F.lit(0.0).alias("base_loss"),
            F.lit(0.0).alias("slope"),
            F.lit(1.0).alias("step"),
            F.lit(0).alias("turns"),
            F.lit(False).alias("done"),
        ),
        "fits",
    )
    finished = []
    while not open_fits.isEmpty():
        sums = _sums(weighted, open_fits, names)
        stepped = null_safe_join(open_fits, sums, ["dataset_name"], "inner").mapInArrow(
            lambda batches: _step(batches, tol), STATE
        )
        stepped = materialize(stepped, "fits")
        finished.append(stepped.where("done"))
        open_fits = stepped.where("NOT done")
    fitted = open_fits
    for part in finished:
        fitted = fitted.unionByName(part)
    found = null_safe_join(weights.select("dataset_name"), fitted, ["dataset_name"], "left").select(
        "dataset_name",
        F.get("point", F.lit(0)).alias("intercept"),
        F.slice("point", 2, len(names)).alias("coefficients"),
    )
    # Written, so that Catalyst knows its size and broadcasts it if it is small.
    return materialize(found, "coefficients")


def predict(features: DataFrame, coefficients: DataFrame, names: list[str]) -> DataFrame:
    """Probability of ``seen`` and the predicted class, for all datasets in one pass; null
    where the dataset has no coefficients."""
    others = [c for c in features.columns if c not in names]
    products = F.zip_with(F.array(*names), F.col("coefficients"), lambda x, c: x * c)
    margin = F.aggregate(products, F.col("intercept"), lambda acc, x: acc + x)
    joined = null_safe_join(features, coefficients, ["dataset_name"], "left")
    return joined.select(*others, margin.alias("margin")).select(
        *others,
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))).alias("probability"),
        (F.col("margin") > 0).alias("predicted"),
    )


def feature_coefficients(coefficients: DataFrame, names: list[str]) -> DataFrame:
    """Long form: one row per dataset and feature."""
    named = F.arrays_zip(
        F.array(*[F.lit(n) for n in names]).alias("feature"),
        F.col("coefficients").alias("coefficient"),
    )
    return coefficients.select("dataset_name", F.inline(named))


def top_coefficients(
    coefficients: DataFrame, names: list[str], n: int = TOP_FEATURES
) -> DataFrame:
    """The ``n`` largest coefficients of each dataset by absolute value, with their sign."""
    ranked = coefficients.select(
        "dataset_name",
        F.posexplode(
            F.slice(
                F.array_sort(
                    F.arrays_zip(
                        F.transform("coefficients", lambda c: -F.abs(c)).alias("order"),
                        F.array(*[F.lit(x) for x in names]).alias("feature"),
                        F.col("coefficients").alias("coefficient"),
                    )
                ),
                1,
                n,
            )
        ).alias("pos", "entry"),
    )
    return ranked.select(
        "dataset_name",
        (F.col("pos") + 1).alias("rank"),
        F.col("entry.feature").alias("feature"),
        F.col("entry.coefficient").alias("coefficient"),
        F.when(F.col("entry.coefficient") > 0, "+").otherwise("-").alias("sign"),
    )
