"""Tables written by parts and by index, checks while writing, keys that are null."""

import os

import pytest
from pyspark.sql import functions as F

from seenscope.operators import checks, report, tasks
from seenscope.plans import ordering
from seenscope.plans.materialize import materialize, scratch_path, shared_folder
from seenscope.plans.running import running_sums
from seenscope.sources import items, trajectories

ITEMS = "dataset_name STRING, split STRING, id_num LONG, seen BOOLEAN"


def some_items(spark):
    rows = [(d, s, i, i % 2 == 0) for d in ("a", "b", None) for s in ("train", "eval") for i in range(4)]
    return spark.createDataFrame(rows, ITEMS)


def parts(spark, path):
    return {(r["dataset_name"], r["split"]): (r["n_rows"], r["complete"]) for r in items.part_report(spark, path, ITEMS).collect()}


def test_parts_are_replaced_one_by_one(spark):
    path, table = scratch_path(spark, "parts"), some_items(spark)
    items.write_parts(table, path)
    assert parts(spark, path) == {(d, s): (4, True) for d in ("a", "b", None) for s in ("train", "eval")}
    again = spark.createDataFrame([("a", "train", 9, True), (None, "eval", 8, True)], ITEMS)
    items.write_parts(again, path)
    found = sorted((str(r["dataset_name"]), r["split"], r["id_num"]) for r in items.read_parts(spark, path, ITEMS).collect())
    kept = [r for r in table.collect() if (r["dataset_name"], r["split"]) not in (("a", "train"), (None, "eval"))]
    assert found == sorted([(str(r["dataset_name"]), r["split"], r["id_num"]) for r in kept] + [("a", "train", 9), ("None", "eval", 8)])


def test_rerun_after_a_failed_write(spark):
    path, table = scratch_path(spark, "parts"), some_items(spark)
    items.write_parts(table, path)
    broken = F.when(F.col("id_num") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("seen")).cast("boolean")
    one = table.where("dataset_name = 'b' AND split = 'eval'")
    with pytest.raises(Exception, match="lost"):
        items.write_parts(one.withColumn("seen", broken), path)
    assert parts(spark, path)["b", "eval"] == (4, True)
    assert items.read_parts(spark, path, ITEMS).count() == 24
    # As if files of a new write had come, and its marker had not.
    late = one.drop("dataset_name", "split").withColumn(items.RUN, F.lit("another"))
    late.write.mode("append").parquet(f"{path}/rows/dataset_name=b/split=eval")
    assert parts(spark, path)["b", "eval"] == (8, False)
    assert items.read_parts(spark, path, ITEMS).count() == 20
    items.write_parts(one, path)
    assert parts(spark, path)["b", "eval"] == (4, True)
    assert items.read_parts(spark, path, ITEMS).count() == 24


def files_read(frame):
    """Files that the scans of a plan have read."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return [s.metrics().get("numFiles").get().value() for s in scans if "FileScan parquet" in s.toString()]


def test_fetch_reads_the_files_it_needs(spark):
    path = scratch_path(spark, "indexed")
    table = spark.range(40_000).select(F.col("id").alias("global_index"), F.concat(F.lit("t"), "id").alias("text"))
    tasks.write_indexed(table.repartition(5), path, range_rows=500)
    written = sum(f.endswith(".parquet") for _, _, names in os.walk(path.removeprefix("file:")) for f in names)
    assert written == 80
    asked = materialize(spark.createDataFrame([(i,) for i in [*range(7000, 7039), 99_999_999, -3]], "global_index LONG"), "asked")
    schema = "global_index LONG, text STRING"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = tasks.fetch_indexed(spark, path, schema, asked, range_rows=500)
        rows = found.collect()
        assert max(files_read(found)) < 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {r["global_index"]: (r["text"], r["found"]) for r in rows} == {
        **{i: (f"t{i}", True) for i in range(7000, 7039)}, 99_999_999: (None, False), -3: (None, False)
    }
    assert tasks.fetch_indexed(spark, path, schema, asked.where("false"), range_rows=500).count() == 0


def test_checks_while_writing(spark):
    path, table = scratch_path(spark, "verified"), some_items(spark)
    scans = spark.sparkContext.accumulator(0)

    def write(rows):
        rows.write.parquet(path)
        scans.add(1)

    counts = checks.write_verified(table.where("seen"), write, {"late": F.col("id_num") > 1})
    assert counts == {"n_rows": 12, "n_not_seen": 0, "late": 6}
    assert scans.value == 1 and spark.read.parquet(path).count() == 12
    with pytest.raises(ValueError, match="12 rows are not marked as seen"):
        checks.write_verified(table, lambda rows: rows.write.parquet(f"{path}-all"))
    with pytest.raises(ValueError, match="12 rows are not marked as seen"):
        checks.verify_seen(table)


def test_null_datasets_in_reports(spark):
    states = spark.createDataFrame([(d, i, s) for d in ("a", None) for i in (1, 2) for s in range(3 if i == 1 else 2)], "dataset_name STRING, id_num LONG, part INT")
    kept = trajectories.keep_complete(states, states, ["dataset_name", "id_num"], 3).collect()
    assert sorted((str(r["dataset_name"]), r["id_num"]) for r in kept) == [("None", 1)] * 3 + [("a", 1)] * 3
    metrics = spark.createDataFrame([("a", 10, 0.6, 0.5), (None, 10, 0.7, 0.8)], "dataset_name STRING, k INT, eval_auc DOUBLE, eval_accuracy DOUBLE")
    found = {(r["dataset_name"], r["k"]): (r["eval_auc"], r["eval_accuracy"]) for r in report.k_sweep(metrics, [10, 20]).collect()}
    assert found == {("a", 10): (0.6, 0.5), ("a", 20): (0.0, 0.0), (None, 10): (0.7, 0.8), (None, 20): (0.0, 0.0)}


def test_numbering_shuffles_the_rows_once(spark):
    rows = materialize(spark.range(3000).select((F.col("id") % 3).cast("string").alias("g"), "id", F.repeat(F.lit("x"), 50).alias("text")), "rows")
    sums = materialize(rows.select("g", F.col("id").cast("double").alias("v"), F.lit(1).alias("n")), "sums")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = ordering.number_by_hash(rows, ["g"], ordering.order_key("place", "g", "id"), "id", "place")
        summed = running_sums(sums, ["g"], "v", ["n"])
        for plan, column in ((numbered, "text"), (summed, "v")):
            lines = plan._jdf.queryExecution().executedPlan().toString().splitlines()
            exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
            # The rows' side and the offsets' side of one join.
            assert len(exchanges) == 2, lines
        assert sorted(r["place"] for r in numbered.where("g = '1'").collect()) == list(range(1000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_one_process_chooses_a_folder(spark, monkeypatch):
    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return "/chosen" if self.master == "local[4]" else None

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default: None)})

        def __init__(self, master):
            self.sparkContext = Context(master)

    assert shared_folder(Session("local[4]")) == "/chosen"
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:1"):
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            shared_folder(Session(master))
