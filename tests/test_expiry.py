"""State that ends: batches of errors by number and by time, and rate limits of keys that went idle."""

import datetime as dt
import time

import pytest

from loomspark.streaming import state


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def wait(check, seconds=90):
    end = time.time() + seconds
    while not check():
        assert time.time() < end
        time.sleep(0.5)


def state_rows(run):
    return run.lastProgress["stateOperators"][0]["numRowsTotal"] if run.lastProgress and run.lastProgress["stateOperators"] else None


def test_error_batches_by_number_and_time(spark, tmp_path):
    schema, at = "key string, payload string", str(tmp_path / "in")
    first = [("a", f"a{k}") for k in range(23)] + [("b", "b0"), ("b", None)] + [("c", f"c{k}") for k in range(10)] + [(None, "n")]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(at)
    out = state.error_batches(spark.readStream.schema(schema).parquet(at), 10, 3.0)
    run = out.writeStream.format("memory").queryName("batched").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        wait(lambda: spark.table("batched").count() >= 6)
        wait(lambda: state_rows(run) == 0)
        spark.createDataFrame([("b", "late")], schema).write.mode("append").parquet(at)
        wait(lambda: spark.table("batched").count() == 7)
        wait(lambda: state_rows(run) == 0)
    finally:
        run.stop()
    got = [(r.key, r.cause, r.payloads) for r in spark.table("batched").collect()]
    want = [("a", "full", [f"a{k}" for k in range(10)]), ("a", "full", [f"a{k}" for k in range(10, 20)]), ("a", "time", ["a20", "a21", "a22"])]
    want += [("b", "time", ["b0", None]), ("c", "full", [f"c{k}" for k in range(10)]), (None, "time", ["n"]), ("b", "time", ["late"])]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_idle_keys_leave_the_state(spark, tmp_path):
    schema, at, base = "key string, ts timestamp", str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    spark.createDataFrame([(k, base + dt.timedelta(milliseconds=100 * n)) for k in ("old", "new") for n in range(3)], schema).write.parquet(at)
    out = state.rate_limit(spark.readStream.schema(schema).parquet(at), 2, 2.0)
    run = out.writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        wait(lambda: spark.table("expiring").count() == 6)
        time.sleep(5)
        assert state_rows(run) == 2  # idle by the clock, but the watermark still lies within their window
        spark.createDataFrame([("new", base + dt.timedelta(seconds=60))], schema).write.mode("append").parquet(at)
        wait(lambda: spark.table("expiring").count() == 7 and state_rows(run) == 1)
    finally:
        run.stop()
    got = sorted((r.key, r.ts, r.allowed) for r in spark.table("expiring").collect())
    assert [a for k, _, a in got if k == "old"] == [True, True, False] and [a for k, _, a in got if k == "new"] == [True, True, False, True]
