import os

import pytest
from pyspark.sql import functions as F

from acrelens.operators import merge, sinks


def names(path):
    return {os.path.join(d, f).removeprefix(str(path)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}


def upsert(now, changes):
    return merge.upsert(now, changes, ["k"], protected={"kept"})


def table(spark, tmp_path, n=200, buckets=16):
    kept = sinks.KeyedTable(spark, f"{tmp_path}/t", ["k"], buckets)
    kept.create(spark.createDataFrame([(i, f"v{i}", i) for i in range(n)], "k long, v string, kept int"))
    return kept


def test_only_touched_parts_are_written_and_twice_is_once(spark, tmp_path):
    kept = table(spark, tmp_path)
    before = names(f"{tmp_path}/t")
    changes = spark.createDataFrame([(3, "new", -1), (500, "fresh", -1)], "k long, v string, kept int")
    assert kept.upsert(changes, upsert) == len(kept.touched(changes)) <= 2
    after = names(f"{tmp_path}/t")
    gone = {n.split("/")[1] for n in before - after}
    assert gone <= {f"{sinks.BUCKET}={b}" for b in kept.touched(changes)} and len(before & after) >= 14
    want = sorted([(i, "new" if i == 3 else f"v{i}", i) for i in range(200)] + [(500, "fresh", None)])
    assert sorted(map(tuple, kept.read().collect())) == want
    kept.upsert(changes, upsert)
    assert sorted(map(tuple, kept.read().collect())) == want
    assert kept.upsert(changes.limit(0), upsert) == 0


def test_a_failed_merge_leaves_the_table(spark, tmp_path):
    kept = table(spark, tmp_path)
    before = names(f"{tmp_path}/t")
    bad = spark.createDataFrame([(1, "x", 0)], "k long, v string, kept int")
    with pytest.raises(Exception):
        kept.upsert(bad, lambda now, changes: now.withColumn("v", F.raise_error(F.lit("no"))))
    assert names(f"{tmp_path}/t") == before and kept.read().count() == 200


def test_runs_leave_rows_on_success_and_failure(spark, tmp_path):
    rows = spark.range(30)

    def good(run):
        run.write(rows, lambda df: df.write.mode("overwrite").parquet(f"{tmp_path}/good"), even=F.col("id") % 2 == 0)
        run.write(rows.limit(3), lambda df: df.write.mode("overwrite").parquet(f"{tmp_path}/more"), even=F.col("id") % 2 == 0)

    def bad(run):
        run.write(rows.limit(5), lambda df: df.write.mode("overwrite").parquet(f"{tmp_path}/bad"))
        rows.select(F.raise_error(F.lit("broken row"))).collect()

    for _ in range(2):
        told = {r["source"]: r for r in sinks.run_sources(spark, f"{tmp_path}/log", {"bad": bad, "none": lambda run: None, "good": good}).collect()}
        assert {n: r["status"] for n, r in told.items()} == {"bad": "FAILED", "none": "SUCCESS", "good": "SUCCESS"}
        assert told["good"]["counts"] == {"written": 33, "even": 17} and told["bad"]["counts"] == {"written": 5} and told["none"]["counts"] == {}
        assert "broken row" in told["bad"]["error"] and told["good"]["error"] is None and told["good"]["started_at"] <= told["good"]["ended_at"]
    assert spark.read.parquet(f"{tmp_path}/log").count() == 6
