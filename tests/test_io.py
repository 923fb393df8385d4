"""Sources and sinks (S1-S16) and model persistence / scoring, round-tripped through scratch folders."""

import os

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tabscope.operators import ml as M
from tabscope.operators import retrieval as RT
from tabscope.sources import io as IO

from conftest import SF


def test_read_dispatch_and_latest(spark, scratch):
    c = spark.read.parquet(f"{SF}/customer.parquet")
    c.coalesce(1).write.option("header", True).csv(f"{scratch}/ds/a.csv")
    c.coalesce(1).write.option("header", True).option("sep", "\t").csv(f"{scratch}/ds/b.tsv")
    c.coalesce(1).write.json(f"{scratch}/ds/c_engineered.json")
    assert IO.read_table(spark, f"{scratch}/ds/a.csv", "csv").count() == c.count()
    t = IO.read_table(spark, f"{scratch}/ds/b.tsv", "tsv")
    assert dict(t.dtypes)["c_acctbal"] == "double"
    empty = spark.createDataFrame([], "x int")
    empty.write.parquet(f"{scratch}/empty")
    with pytest.raises(ValueError):
        IO.read_table(spark, f"{scratch}/empty", "parquet")
    latest = IO.latest_dataset(spark, f"{scratch}/ds", "raw")
    assert latest is not None and "engineered" not in latest


def test_fingerprint_is_order_insensitive_and_materialize_once(spark, scratch):
    c = spark.read.parquet(f"{SF}/customer.parquet")
    a = IO.table_fingerprint(c).first()
    b = IO.table_fingerprint(c.orderBy(F.desc("c_custkey")).repartition(3)).first()
    assert a == b
    calls = []

    def build(df):
        calls.append(1)
        return df.withColumn("bal_x2", F.col("c_acctbal") * 2)

    out1 = IO.materialize_once(c, f"{scratch}/eng", build)
    out2 = IO.materialize_once(c, f"{scratch}/eng", build)
    assert len(calls) == 1 and out1.count() == out2.count() == c.count()
    new = IO.new_columns(c, out1).collect()
    assert [(r["column"], r["dtype"]) for r in new] == [("bal_x2", "double")]


def test_results_json_metrics_and_logs(spark, scratch):
    c = spark.read.parquet(f"{SF}/customer.parquet")
    IO.write_results_json({"customers": c.limit(3)}, f"{scratch}/res")
    assert spark.read.json(f"{scratch}/res/customers").count() == 3
    m = spark.createDataFrame([(0.61, 1399.0)], "r2 double, rmse double")
    assert IO.metrics_sink(m, f"{scratch}/metrics").first()["r2"] == 0.61
    ev = spark.read.parquet(f"{SF}/events.parquet").limit(10)
    IO.event_log_append(ev.select("event_id", F.col("ts").cast("string").alias("ts")), f"{scratch}/runs")
    IO.event_log_append(ev.select("event_id", F.col("ts").cast("string").alias("ts")), f"{scratch}/runs")
    with open(f"{scratch}/runs_bad.jsonl", "w") as f:
        f.write('{"event_id": 1, "ts": "a"}\n\nnot json\n{"event_id": 2, "ts": "b"}\n')
    assert IO.read_jsonl_tolerant(spark, f"{scratch}/runs", "event_id long, ts string").count() == 20
    got = IO.read_jsonl_tolerant(spark, f"{scratch}/runs_bad.jsonl", "event_id long, ts string")
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2]


def test_index_round_trip(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    idx = RT.build_index(docs)
    IO.write_index(idx, f"{scratch}/idx")
    back = IO.read_index(spark, f"{scratch}/idx")
    assert back["chunks"].count() == idx["chunks"].count() > 0
    q = spark.read.parquet(f"{SF}/benchmark.parquet").limit(3).withColumnRenamed("item_id", "query_id")
    a = RT.hybrid_search(back, q, k=3).orderBy("query_id", "rank").collect()
    b = RT.hybrid_search_join(back, q, k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"], r["chunk_no"], r["score"]) for r in a] == \
        [(r["query_id"], r["doc_id"], r["chunk_no"], r["score"]) for r in b]


def test_model_save_load_score_and_stream(spark, scratch):
    c = spark.read.parquet(f"{SF}/customer.parquet")
    lab, low, high, _ = M.prepare_frame(c, "c_acctbal", "regression", ["c_nationkey", "c_custkey"], ["c_mktsegment"])
    model = Pipeline(stages=M.build_preprocessor(["c_nationkey", "c_custkey"], low, high) +
                     [M.estimator("random_forest", "regression", numTrees=5)]).fit(lab)
    path = IO.save_model(model, f"{scratch}/registry", f"{scratch}/models", "raw", "Random Forest!", "random_forest", 0.5)
    assert os.path.basename(path) == "Random_Forest"
    loaded = IO.load_model(f"{scratch}/registry", aliases=["random_forest"])
    scored = M.batch_score(loaded, c, ["c_nationkey", "c_custkey", "c_mktsegment"], "c_custkey")
    assert scored.count() == c.count()
    with pytest.raises(ValueError):
        M.batch_score(loaded, c.drop("c_mktsegment"), ["c_nationkey", "c_custkey", "c_mktsegment"], "c_custkey")
    IO.write_predictions(loaded.transform(lab), f"{scratch}/pred")
    assert spark.read.parquet(f"{scratch}/pred").columns == ["actual", "predicted"]
    # JSON records arriving as a stream, scored with the same model
    c.select(F.to_json(F.struct("c_custkey", "c_nationkey", "c_mktsegment")).alias("value")).write.text(f"{scratch}/in")
    stream = spark.readStream.format("text").load(f"{scratch}/in")
    sc = M.score_json_stream(loaded, stream, "c_custkey long, c_nationkey int, c_mktsegment string", id_col="c_custkey")
    q = sc.writeStream.format("memory").queryName("scored_stream").option("checkpointLocation", f"{scratch}/ck") \
        .trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT * FROM scored_stream").count() == c.count()
