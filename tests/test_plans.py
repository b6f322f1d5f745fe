"""Plan building blocks against brute force, with hot groups."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seenscope.operators import classifier, evaluate, report
from seenscope.plans import ordering
from seenscope.plans.carry import last_before
from seenscope.plans.joins import key_filter, lookup_join, null_safe_join, split_by_filter
from seenscope.plans.materialize import materialize, shared_folder
from seenscope.plans.running import running_sums
from seenscope.sources import paths


def _hot_rows(n=3000, seed=1):
    rng = random.Random(seed)
    # One group holds more than a third of the rows.
    return [
        ("hot" if rng.random() < 0.4 else f"g{rng.randrange(20)}", i, rng.randrange(500))
        for i in range(n)
    ]


@pytest.mark.parametrize("partitions", [None, 1, 3, 16])
def test_running_sums(spark, partitions):
    totals = Counter()
    for group, _, value in _hot_rows():
        totals[group, float(value)] += 1
    df = spark.createDataFrame(
        [(g, v, n) for (g, v), n in totals.items()], "g STRING, v DOUBLE, n LONG"
    )
    found = running_sums(df, ["g"], "v", ["n"], partitions=partitions).collect()
    assert len(found) == len(totals)
    by_group = defaultdict(list)
    for (group, value), n in totals.items():
        by_group[group].append((value, n))
    for row in found:
        pairs = by_group[row["g"]]
        assert row["cum_n"] == sum(n for v, n in pairs if v <= row["v"])
        assert row["total_n"] == sum(n for _, n in pairs)


@pytest.mark.parametrize("max_hot", [1, 5, 20_000])
def test_lookup_join(spark, max_hot):
    data = _hot_rows()
    uses = Counter(g for g, _, _ in data)
    rows = spark.createDataFrame(data + [("absent", -1, 0)], "g STRING, i LONG, v LONG")
    lookup = spark.createDataFrame(
        [(g, n, f"value-{g}") for g, n in uses.items()], "g STRING, uses LONG, value STRING"
    )
    found = lookup_join(rows, lookup, ["g"], max_hot=max_hot, how="inner").collect()
    wanted = [(g, i, v, f"value-{g}") for g, i, v in data]
    assert sorted((r["g"], r["i"], r["v"], r["value"]) for r in found) == sorted(wanted)
    found = lookup_join(rows, lookup, ["g"], max_hot=max_hot).collect()
    assert len(found) == len(data) + 1
    assert [r["value"] for r in found if r["g"] == "absent"] == [None]


def test_lookup_join_spreads_hot_keys(spark):
    # Without broadcast of the cold side, the join key must hold the spread value.
    data = _hot_rows()
    uses = Counter(g for g, _, _ in data)
    rows = spark.createDataFrame(data, "g STRING, i LONG, v LONG")
    lookup = spark.createDataFrame(list(uses.items()), "g STRING, uses LONG").withColumn(
        "value", F.col("g")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lookup_join(rows, lookup, ["g"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert any("_salt" in line for line in exchanges)


@pytest.mark.parametrize("partitions", [1, 16])
def test_last_before(spark, partitions):
    rng = random.Random(8)
    data = [(g, i, f"v{i}" if rng.random() < 0.3 else None) for g, i, _ in _hot_rows(900)]
    df = spark.createDataFrame(data + [(None, 5, "n"), (None, 6, None)], "g STRING, i LONG, v STRING")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = last_before(df, "g", F.col("i"), F.col("v"), "found").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == len(data) + 2
    groups = defaultdict(list)
    for r in sorted(found, key=lambda r: r["i"]):
        known = [v for v in groups[r["g"]] if v is not None]
        assert r["found"] == (known[-1] if known else None)
        groups[r["g"]].append(r["v"])


def _exchanged(df, words):
    """Rows of the plan that shuffle all of the given columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and all(w in x for w in words)]


def test_large_sides_are_not_shuffled_for_a_few_datasets(spark):
    """With written small sides and a low broadcast limit, as for large inputs."""
    rows = spark.range(50_000).select(
        (F.col("id") % 4).cast("string").alias("dataset_name"), F.col("id").alias("id_num"),
        (F.col("id") % 3 == 0).alias("seen"), F.rand(1).alias("score"), F.rand(2).alias("a"),
    )
    rows = materialize(rows, "rows")
    coefficients = classifier.fit_classifiers(rows.limit(500), ["a"])
    counts = materialize(evaluate.score_counts(rows, ["dataset_name"]), "counts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        assert not _exchanged(classifier.predict(rows, coefficients, ["a"]), ["dataset_name"])
        assert not _exchanged(paths.paired(rows, rows.limit(100)), ["dataset_name"])
        series = report.roc_series({"m": counts})._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in series
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_null_safe_join(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k STRING, x INT")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k STRING, y INT")
    found = null_safe_join(left, right, ["k"], "left").collect()
    assert sorted((r["k"] or "", r["x"], r["y"]) for r in found) == [
        ("", 2, 20),
        ("a", 1, 10),
        ("b", 3, None),
    ]


@pytest.mark.parametrize("most", [0, 3, 40])
def test_take_first_both_ways(spark, most):
    data = _hot_rows(600)
    df = spark.createDataFrame(data + [(None, 10_001, 0), (None, 10_002, 0)], "g STRING, i LONG, v LONG")
    key = ordering.order_key("test", "g", "i")
    limited = ordering.take_first(df, ["g"], key, "i", F.lit(most), most)
    plan = limited._jdf.queryExecution().executedPlan().toString()
    assert most == 0 or plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert most == 0 or "Partial" in plan
    wanted = {r["i"] for r in limited.collect()}
    spark.conf.set(ordering.GROUP_LIMIT, "-1")
    try:
        cut = ordering.take_first(df, ["g"], key, "i", F.lit(most), most)
        assert "WindowGroupLimit" not in cut._jdf.queryExecution().executedPlan().toString()
        assert {r["i"] for r in cut.collect()} == wanted
    finally:
        spark.conf.unset(ordering.GROUP_LIMIT)
    sizes = Counter(g for g, _, _ in data)
    assert len(wanted) == sum(min(n, most) for n in sizes.values()) + min(2, most)


@pytest.mark.parametrize("quota", [0, 1, 7, 10_000])
def test_mark_first(spark, quota):
    data = _hot_rows(600)
    df = spark.createDataFrame(data + [(None, 10_001, 0)], "g STRING, i LONG, v LONG")
    key = ordering.order_key("test", "g", "i")
    marked = ordering.mark_first(df, ["g"], key, "i", F.lit(quota), "first")
    rows = marked.withColumn("key", key).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["g"]].append(r)
    assert len(rows) == 601
    for members in groups.values():
        members.sort(key=lambda r: (r["key"], r["i"]))
        assert [r["first"] for r in members] == [n < quota for n in range(len(members))]


def test_number_by_hash(spark):
    df = spark.createDataFrame(_hot_rows(600), "g STRING, i LONG, v LONG")
    key = ordering.order_key("test", "g", "i")
    rows = ordering.number_by_hash(df, ["g"], key, "i", "place").withColumn("key", key).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["g"]].append(r)
    for members in groups.values():
        members.sort(key=lambda r: (r["key"], r["i"]))
        assert [r["place"] for r in members] == list(range(len(members)))


def test_shared_folder_is_read_from_the_session(spark, tmp_path):
    spark.conf.get("spark.checkpoint.dir", None)
    df = materialize(spark.range(10), "numbers")
    assert df.count() == 10
    assert df.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(
        shared_folder(spark).split(":", 1)[-1].lstrip("/")
    )


def test_split_by_filter(spark):
    """Every key of the table is in the first part, few others are, and no row is shuffled."""
    keys = [*range(0, 5000, 50), None]
    table = spark.createDataFrame([(k,) for k in keys], "id LONG")
    rows = spark.range(-5000, 5000).selectExpr("if(id = 7, null, id) id", "'t' text").repartition(3)
    maybe, never = split_by_filter(rows, key_filter(table, ["id"]), ["id"])
    first, second = ([r["id"] for r in part.collect()] for part in (maybe, never))
    assert set(keys) <= set(first) and len(first) < len(keys) + 20
    assert Counter(first + second) == Counter([i for i in range(-5000, 5000) if i != 7] + [None])
    plan = never._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "BroadcastHashJoin" in plan
