"""Null keys, ids shared between keys, text ids and odd version texts."""

from pyspark.sql import functions as F

from tabscope.operators import ml, rules, window
from tabscope.streaming import events


def test_rows_with_a_null_key_stay(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 3).alias("k"))
    index = window.row_index(df, ["id"], ["k"], "pos", skew_safe=True)
    assert index.count() == 100
    assert [r["pos"] for r in index.where("k IS NULL").orderBy("id").collect()] == list(range(10))
    rolled = window.rolling(df, {"s": ("sum", "id", 2)}, ["id"], ["k"], skew_safe=True)
    assert [r["s"] for r in rolled.where("k IS NULL").orderBy("id").limit(3).collect()] == [0.0, 10.0, 30.0]
    assert ml.train_test_split(df, ["id"], 0.2, "k").count() == 100
    assert ml.kfold_assign(df, ["id"], 5, "k").count() == 100


def test_events_of_two_keys_may_share_text_ids(spark):
    rows = [("a", "x", "2024-01-01 00:00:00"), ("a", "y", "2024-01-01 00:00:01"), ("b", "y", "2024-01-01 00:00:00"),
            (None, "z", "2024-01-01 00:00:00"), (None, "w", "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "k string, event_id string, t string").select("k", "event_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    want = {("a", "x"), ("b", "y"), (None, "z")}
    for kept in (events.dedup_within(df, ["k"], window_s=60), events.dedup_within(df, ["k"], window_s=60, partitions=3),
                 events.dedup_seen(df, ["k"])):
        assert {(r["k"], r["event_id"]) for r in kept.collect()} == want and kept.count() == 3


def test_requirements_with_a_trailing_dot(spark):
    advisories = [("requests", "<", "2.31.0", "old")]
    df = spark.createDataFrame([(1, "requests==2.30."), (2, "requests==2.31.0"), (3, "requests==")], "id long, text string")
    assert [r["file_id"] for r in rules.scan_requirements(df, "id", "text", advisories).collect()] == [1]


def test_dependency_network_finds_the_edges_and_no_cycle(spark):
    df = spark.range(400).select((F.col("id") % 4).alias("a"), (F.col("id") % 4 * 2 + F.col("id") % 2).alias("b"),
                                 (F.xxhash64("id") % 5).alias("c"))
    from tabscope.operators.assoc import dependency_network
    edges = {(r["source"], r["target"]) for r in dependency_network(df, ["a", "b", "c"]).collect()}
    assert {frozenset(e) for e in edges} >= {frozenset("ab")}
    assert not any((t, s) in edges for s, t in edges)
