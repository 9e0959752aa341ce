"""Streams from files, with the results held against the same rows at rest."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import timeline
from millrace.sources.queue_store import QueueStore
from millrace.streaming import flows

MS = 1_000_000


@pytest.fixture
def feed(spark, tmp_path):
    """feed(rows) adds a file that the stream then reads."""

    def make(ddl, name):
        folder = tmp_path / name
        folder.mkdir()

        def put(rows):
            spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(folder))

        put([])
        return put, spark.readStream.schema(ddl).parquet(str(folder))

    return make


def test_signals_and_items_flow_into_the_store(spark, tmp_path, feed):
    store = QueueStore(spark, f"file://{tmp_path}/store")
    put, stream = feed("workflow_id string, sig_id string, name string, payload string, enqueued_at long, seq long", "signals")
    put([("r1", "s1", "go", "old", 1, 1), ("r1", "s1", "go", "new", 2, 2), ("r2", "s9", "stop", "x", 3, 3)])
    flows.deliver(store, stream).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    put([("r1", "s2", "go", "more", 4, 4)])
    flows.deliver(store, stream).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert store.signals("r1") == [("s1", "go", "new"), ("s2", "go", "more")] and store.signals("r2") == [("s9", "stop", "x")]
    put, stream = feed("workflow_id string, type string, input string", "items")
    put([("a", "t", None), ("b", "t", '{"n": 1}'), ("a", "t", None)])
    for i in range(2):  # without the checkpoint of the first, the second sees everything again
        flows.take_in(store, stream, lambda: 7).option("checkpointLocation", str(tmp_path / f"q{i}")).trigger(availableNow=True).start().awaitTermination()
    assert [i.input for i in store.claim_items("w", 8, most=9)] == [None, {"n": 1}]


def test_waits_fall_due(spark, tmp_path, feed):
    put, stream = feed("workflow_id string, node_name string, fire_at long, at timestamp", "waits")
    ts = lambda ms: spark.sql(f"SELECT timestamp_millis({ms}) AS t").first().t
    q = flows.due(stream, late="0 seconds").writeStream.format("memory").queryName("due").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        put([("r", "a", 5000 * MS, ts(1000)), ("r", "b", 9000 * MS, ts(1000)), ("r", "c", 4000 * MS, ts(1000))])
        q.processAllAvailable()
        assert spark.table("due").count() == 0
        put([("r", "c", None, ts(2000)), ("r", "a", 99000 * MS, ts(2000))])  # disarmed; armed again, which changes nothing
        q.processAllAvailable()
        put([("x", "x", 10**15, ts(6000))])
        q.processAllAvailable()
        put([("x", "y", 10**15, ts(6001))])
        q.processAllAvailable()
        assert {(r.workflow_id, r.node_name, r.fire_at) for r in spark.table("due").collect()} == {("r", "a", 5000 * MS)}
        put([("x", "z", 10**15, ts(9500))])
        q.processAllAvailable()
        put([("x", "w", 10**15, ts(9501))])
        q.processAllAvailable()
        assert {r.node_name for r in spark.table("due").collect()} == {"a", "b"}
    finally:
        q.stop()


def test_windows_and_latest_equal_the_batch(spark, tmp_path, feed):
    ddl = "k string, v long, version long, at timestamp"
    put, stream = feed(ddl, "events")
    rows = [(f"k{i % 3}", i, i, spark.sql(f"SELECT timestamp_seconds({i * 7}) AS t").first().t) for i in range(40)]
    put(rows[:25])
    put(rows[25:])
    w = flows.windowed(stream, "at", ["k"], "60 seconds", "0 seconds").writeStream.format("memory").queryName("win").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "w")).start()
    w.awaitTermination()
    want = spark.createDataFrame(rows, ddl).groupBy(F.window("at", "60 seconds").alias("w"), "k").agg(F.count("*").alias("n")).where("w.end <= timestamp_seconds(39 * 7)")
    assert {(r.begin, r.k, r.n) for r in spark.table("win").collect()} == {(r.w.start, r.k, r.n) for r in want.collect()} != set()
    u = flows.latest(stream, ["k"], ["v"]).writeStream.format("memory").queryName("last").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "l")).start()
    u.awaitTermination()
    log = spark.createDataFrame(rows, ddl).withColumn("op", F.lit("U"))
    assert {(r.k, r.v) for r in spark.table("last").collect()} == {(r.k, r.v) for r in timeline.latest_state(log, ["k"], ["v"]).collect()}
