"""Leading bits of doubles, and running sums by them."""

import math
import random
import struct
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from seenscope.operators import evaluate
from seenscope.plans.histogram import leading_bits, ordered_sums


def some_numbers():
    rng = random.Random(4)
    bits = [struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)]
    powers = [2.0**e for e in range(-1074, 1024, 7)]
    near = [math.nextafter(p, way) for p in powers for way in (0, math.inf)]
    plain = [rng.gauss(0, 1) for _ in range(1000)] + [0.0, -0.0, 1e-300, math.inf, -math.inf, 5e-324]
    found = {x for x in bits + powers + near + plain if not math.isnan(x)}
    return sorted(found | {-x for x in found})


def test_bits_never_fall(spark):
    numbers = some_numbers()
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i INT, x DOUBLE")
    found = [r["b"] for r in rows.select("i", leading_bits(F.col("x")).alias("b")).orderBy("i").collect()]
    assert all(a <= b for a, b in zip(found, found[1:]))
    fine = [(a, b) for a, b, x, y in zip(found, found[1:], numbers, numbers[1:]) if abs(y - x) > abs(x) / 2**15]
    assert all(a < b for a, b in fine)
    odd = spark.createDataFrame([(math.nan,), (None,)], "x DOUBLE").select(leading_bits(F.col("x")).alias("b")).collect()
    assert odd[0]["b"] > found[-1] and odd[1]["b"] is None


@pytest.mark.parametrize("partitions", [1, 16])
def test_sums_of_one_huge_group(spark, partitions):
    rng = random.Random(5)
    values = {("huge", rng.gauss(3, 1e-4) if i % 2 else rng.gauss(0, 5)): rng.randrange(5) for i in range(20_000)}
    values |= {(g, float(i)): 1 for g in ("small", None) for i in range(-3, 4)}
    rows = spark.createDataFrame([(g, v, n) for (g, v), n in values.items()], "g STRING, v DOUBLE, n LONG")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = ordered_sums(rows, ["g"], "v", ["n"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == len(values)
    for name in ("huge", "small", None):
        mine = sorted((v, n) for (g, v), n in values.items() if g == name)
        cums = dict(zip([v for v, _ in mine], accumulate(n for _, n in mine), strict=True))
        for r in found:
            if r["g"] == name:
                assert r["cum_n"] == cums[r["v"]] and r["total_n"] == sum(n for _, n in mine)


def test_measures_sample_and_write_nothing(spark):
    scores = spark.range(500).select(
        F.lit("d").alias("dataset_name"), F.lit(30).alias("k"), F.rand(1).alias("score"), (F.col("id") % 2 == 0).alias("seen")
    )
    plan = evaluate.auc(evaluate.score_counts(scores, evaluate.BY_K), evaluate.BY_K)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text and "FileScan" not in text
    assert 0.3 < plan.first()["auc"] < 0.7
