"""Stream twins of E1 and E10 against their batch forms, with a restart in the middle."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabscope.streaming import events as E

PARTIES = ["view", "click", "purchase"]


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def _rows(users):
    """Reports within a minute of disorder; user 3 never completes, user 2's first click comes late."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s, microseconds=7)
    early = [(u, p, at(10 * u + i)) for u in users if u != 3 for i, p in enumerate(PARTIES)] + [(3, "view", at(5)), (3, "other", at(6))]
    return early, [(2, "click", at(15)), (1, "purchase", at(1))], at


def _run(spark, src, ckpt, out, build):
    stream = E.read_event_stream(spark, src, "user_id long, event_type string, ts timestamp", max_files=1)
    q = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(100)


def test_barrier_emits_each_completed_key_once_also_after_a_restart(rocks, scratch):
    early, moved, at = _rows([1, 2, 4])
    files = [early, moved, [(9, "view", at(4000))], [(1, p, at(4001)) for p in PARTIES] + [(5, p, at(4002)) for p in PARTIES], [(9, "view", at(9000))]]
    schema = "user_id long, event_type string, ts timestamp"
    src, everything = f"{scratch}/in", rocks.createDataFrame([r for f in files for r in f], schema)
    build = lambda s: E.stream_completion_barrier(s, "user_id", "event_type", PARTIES)
    for i, f in enumerate(files):
        rocks.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(src)
        if i in (1, 2, 4):  # three runs from one checkpoint
            _run(rocks, src, f"{scratch}/ckpt", f"{scratch}/out", build)
    got = sorted(tuple(r) for r in rocks.read.parquet(f"{scratch}/out").collect())
    batch = E.completion_barrier(everything, "user_id", "event_type", PARTIES).where("complete").select("user_id", "n_reported", "completed_at")
    assert got == sorted(tuple(r) for r in batch.collect()) and [r[0] for r in got] == [1, 2, 4, 5]


def test_routes_equal_the_batch(spark, scratch):
    early, _, _ = _rows([1, 2])
    df = spark.createDataFrame(early, "user_id long, event_type string, ts timestamp")
    df.repartition(3).write.parquet(f"{scratch}/in")
    routes = {"view": ["a", "b"], "click": ["a"]}
    _run(spark, f"{scratch}/in", f"{scratch}/ckpt", f"{scratch}/out", lambda s: E.stream_route_channel(s, routes))
    got = spark.read.parquet(f"{scratch}/out")
    ref = E.route_channel(df, routes)
    assert got.count() == ref.count() > 0 and got.exceptAll(ref.select(got.columns)).count() == 0
