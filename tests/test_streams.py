"""Streams give what the batch operators give on the same events."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import events as ev
from quillspark.streaming import keyed


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rows = [(i % 4, i % 3, 1_700_000_000 + 900 * i + (7 * i) % 50, i, int(i % 5 == 0), 1 if i % 7 < 3 else -1, float(i % 11)) for i in range(240)]
    path = str(tmp_path_factory.mktemp("log") / "t")
    df = spark.createDataFrame(rows, "owner long, item long, s long, key long, is_click int, stance int, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.coalesce(1).write.parquet(path)
    return spark.read.parquet(path), path


def run(spark, out, tmp_path, mode="append"):
    q = out.writeStream.format("memory").queryName("sink").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return sorted(tuple(r) for r in spark.table("sink").collect())


def read(spark, log):
    return spark.readStream.schema(log[0].schema).parquet(log[1])


def test_dedupe(spark, log, tmp_path):
    got = run(spark, keyed.impressions_deduped(read(spark, log).select("owner", "item", "ts", "key"), 6), tmp_path)
    assert got == sorted(tuple(r) for r in ev.impressions_deduped(log[0], "owner", "item", "ts", "key", 6).collect())


def test_last_touch(spark, log, tmp_path):
    got = run(spark, keyed.last_touch(read(spark, log).select("owner", "item", "ts", "key", "is_click"), 24), tmp_path)
    want = ev.last_touch(log[0].where("is_click = 1"), log[0].where("is_click = 0"), "owner", "item", "ts", "key", 24)
    assert got and got == sorted(tuple(r) for r in want.collect())


def test_stance(spark, log, tmp_path):
    got = run(spark, keyed.stance_changes(read(spark, log).select("owner", "item", "ts", "key", "stance")), tmp_path)
    assert got == sorted(tuple(r) for r in ev.stance_changes(log[0], "owner", "item", "ts", "key", "stance").select("key", "stance", "was", "delta").collect())


def test_running_mean(spark, log, tmp_path):
    got = run(spark, keyed.running_mean(read(spark, log), ["owner", "item"], "value"), tmp_path, "complete")
    assert got == sorted(tuple(r) for r in ev.running_mean(log[0], ["owner", "item"], "value").collect())


def test_visit_boundary_is_a_new_visit(spark):
    at = lambda *s: spark.createDataFrame([(1, x, i) for i, x in enumerate(s)], "owner long, s double, key long").select("owner", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "key")
    assert ev.visits(at(0.0, 1800.0, 3599.9), "owner", "ts", "key", 30).count() == 2
    w = keyed.visits(at(0.0, 1800.0, 3599.9), "owner", "ts", 30)
    assert w.count() == 2
