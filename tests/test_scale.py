"""Operators whose work must not meet in one task: quantiles, deduplication, rates, search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.operators import retrieval as RT
from tabscope.operators import search as SR
from tabscope.operators.common import long_form
from tabscope.operators.quantiles import order_code, quantile_scalars, quantile_table
from tabscope.streaming import events as E

SF = "/root/testdata/sf0.001"


def test_order_code_orders_all_doubles(spark):
    powers = [float(2.0 ** k) for k in range(-1074, 1024, 7)]
    values = sorted({s * v for p in powers for v in (p, float(np.nextafter(p, 0)), float(np.nextafter(p, math.inf))) for s in (1, -1)} | {math.inf, -math.inf})
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, math.nan)], "i int, v double").select("i", order_code(F.col("v")).alias("c")).collect()
    code = {r["i"]: r["c"] for r in rows}
    assert all(code[i] < code[i + 1] for i in range(len(values) - 1)) and code[-1] > code[len(values) - 1]


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    groups = {"normal": rng.normal(size=3001), "few": rng.integers(0, 4, 500).astype(float), "one": np.array([7.5]), "wide": np.exp(rng.normal(size=900) * 20),
              None: np.array([-1.0, 1.0])}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("normal", None), ("empty", None)]
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    for bounded in (True, False):
        got = {r["g"]: r["q"] for r in quantile_table(spark.createDataFrame(rows, "g string, value double"), probs, ["g"], bounded=bounded).collect()}
        assert set(got) == set(groups)
        for g, xs in groups.items():
            assert got[g] == pytest.approx(np.quantile(xs, probs), rel=1e-14)


def test_quantiles_of_no_values_and_plan(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert df.select(quantile_scalars(df, ["a", "b"], [0.5]).alias("s")).first()["s"].asDict() == {"c0": None, "c1": [1.5]}
    wide = spark.range(1000).select(F.rand(1).alias("a"), F.rand(2).alias("b"))
    plan = quantile_table(long_form(wide, ["a", "b"]), [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "SinglePartition" not in plan


def accepted(rows, window):
    """The fold: (key, t, id) in order; of one time the least id."""
    last, out = {}, []
    for k, t, i in sorted(rows):
        if k not in last or t - last[k] >= window:
            last[k] = t
            out.append((k, t, i))
    return out


def test_dedup_within_equals_the_fold(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abbbbbb"), rng.randrange(0, 3000) * 250_000, i) for i in range(4000)]  # a hot key in bursts
    rows += [("burst", j * 400_000, 10_000 + j) for j in range(3000)]  # twenty minutes without a gap
    again = rows + rng.sample(rows, 800)
    df = spark.createDataFrame(again, "k string, t long, event_id long").select("k", F.timestamp_micros("t").alias("ts"), "event_id", "t")
    for parts in (1, 7):
        got = sorted((r["k"], r["t"], r["event_id"]) for r in E.dedup_within(df, ["k"], window_s=1.5, partitions=parts).collect())
        assert got == accepted(set(rows), 1_500_000)
    seen = sorted((r["k"], r["t"], r["event_id"]) for r in E.dedup_seen(df, ["k"]).collect())
    assert seen == sorted(min((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])) for k in {r[0] for r in rows})


def test_dedup_null_keys_times_and_empty(spark):
    rows = [(None, 1, 1), (None, 1, 1), (None, None, 2), (None, None, 3), ("a", None, 4)]
    df = spark.createDataFrame(rows, "k string, t long, event_id long").select("k", F.timestamp_seconds("t").alias("ts"), "event_id")
    assert sorted(r["event_id"] for r in E.dedup_within(df, ["k"]).collect()) == [1, 2, 4]
    assert E.dedup_within(df.limit(0), ["k"]).count() == 0 and E.dedup_seen(df.limit(0), ["k"]).count() == 0


def test_rates_of_a_hot_key(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 2 else f"k{i % 9}", rng.randrange(0, 4 * 86400) * 1_000_000 + rng.choice([0, 1, 999_999]), i, "x" * rng.randrange(0, 60)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, event_id long, props string").select("k", F.timestamp_micros("t").alias("ts"), "event_id", "props", "t")
    tokens = {i: max(1, len(p) // 4) for _, _, i, p in rows}
    want, quota = {}, {}
    for k, t, i, _ in rows:
        inside = [r for r in rows if r[0] == k and t - 60_000_000 < r[1] <= t]
        day = [r for r in rows if r[0] == k and r[1] // 86_400_000_000 == t // 86_400_000_000 and (r[1], r[2]) <= (t, i)]
        want[i] = (len(inside), sum(tokens[r[2]] for r in inside))
        quota[i] = (want[i][0] > 1, want[i][1] > 9, len(day) > 40, sum(tokens[r[2]] for r in day) > 300)
    got = E.rate_per_minute(df, "k")
    assert {r["event_id"]: (r["requests_window"], r["tokens_window"]) for r in got.collect()} == want
    got = E.over_quota(df, "k", {"rpm": 1, "tpm": 9, "rpd": 40, "tpd": 300})
    assert {r["event_id"]: (r["over_rpm"], r["over_tpm"], r["over_rpd"], r["over_tpd"]) for r in got.collect()} == quota
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_search_with_text_ids_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(SR, "BLOCK", 16)
    monkeypatch.setattr(SR, "QUERIES", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 4, "0")).alias("doc_id"), "text")
    index = RT.build_index(docs)
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").where("item_id < 8").select(F.concat(F.lit("q"), "item_id").alias("query_id"), "text")
    key = lambda r: (r["query_id"], r["rank"], r["doc_id"], r["chunk_no"], r["score"])
    tables = SR.search_tables(index, 16)
    assert sorted(map(key, RT.hybrid_search(index, queries, 4, tables=tables).collect())) == sorted(map(key, RT.hybrid_search_join(index, queries, 4).collect()))
    pairs = RT.lexical_scores(index, queries).collect()
    want = []
    for q in {r["query_id"] for r in pairs}:
        best = sorted(((-round(r["lexical"], 6), r["doc_id"], r["chunk_no"]) for r in pairs if r["query_id"] == q))[:3]
        want += [(q, k + 1, d, c, -s) for k, (s, d, c) in enumerate(best)]
    got = RT.lexical_search(index, queries, 3, tables=tables)
    assert sorted((r["query_id"], r["rank"], r["doc_id"], r["chunk_no"], r["lexical"]) for r in got.collect()) == sorted(want)


def test_vector_search_and_cells(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 16))
    rows = [(f"v{i:04d}", [float(x) for x in base[i % 20] + rng.normal(size=16) * 0.2]) for i in range(1500)] + [("null", None)]
    corpus = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    queries = corpus.where("vec_id < 'v0030'").withColumnRenamed("vec_id", "query_id")
    m = np.array([v for _, v in rows[:-1]])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    exact = {}
    for i in range(30):
        s = np.round(unit @ unit[i], 6)
        exact[f"v{i:04d}"] = [rows[j][0] for j in np.lexsort((np.arange(1500), -s))[:5]]
    got = {}
    for r in SR.vector_search(corpus, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item_id"])
    assert got == exact
    near = SR.approx_neighbours(corpus, queries, 5, probes=8).collect()
    assert sum(r["item_id"] in exact[r["query_id"]] for r in near) >= 0.9 * 150 and len(near) == 150


def test_dense_scores_shuffle_no_pairs(spark):
    """Documents are dealt once; term counts and (query, chunk) pairs are not shuffled again, whatever their number."""
    docs = spark.createDataFrame([(i, f"red fox number {i} ran\nover a hill") for i in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "red fox"), (2, "a hill")], "query_id int, text string")
    got = RT.dense_scores(RT.build_index(docs), queries)
    assert got.count() == 80
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [line for line in plan if "Exchange hashpartitioning" in line and "doc_id" in line]
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0], dealt


def test_weights_of_an_index_in_memory_shuffle_no_postings(spark):
    """Texts are dealt by id and terms go out once a part: neither postings nor block tables are shuffled."""
    rows = [(i, f"red fox number {i % 7} ran\nover a hill") for i in range(40)] + [(40, None), (41, " "), (42, "x"), (None, "red fox"), (None, "a hill ran")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([("b", "red fox 3"), ("a", "unseen words"), ("c", "")], "query_id string, text string")
    index = RT.build_index(docs)
    tc = RT.term_counts(index["chunks"], ["doc_id", "chunk_no"])
    n = index["chunks"].select("doc_id", "chunk_no").distinct().count()
    want, _ = RT.tfidf_index(index["chunks"], tc=tc)
    stored = {"chunks": index["chunks"], "dense": index["dense"], "postings": want, "terms": index["terms"]}
    key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.collect())
    got = index["postings"]
    assert n == 42 and index["chunks"].count() == index.chunk_sizes.agg(F.sum("n")).first()[0] == 43  # the two null ids are one
    assert key(got.select("doc_id", "chunk_no", "term", "w")) == key(want.select("doc_id", "chunk_no", "term", "w"))
    cols = ["query_id", "doc_id", "chunk_no", "lexical"]
    scores = RT.lexical_scores(index, queries)
    assert key(scores.select(*cols)) == key(RT.lexical_scores(stored, queries).select(*cols))
    best = sorted((-round(r["lexical"], 6), r["doc_id"] is None, r["doc_id"] or 0) for r in scores.collect() if r["query_id"] == "b")[:5]
    top = RT.lexical_search(index, queries, 5).where("query_id = 'b'").orderBy("rank").collect()
    assert [(-r["lexical"], r["doc_id"] is None, r["doc_id"] or 0) for r in top] == best  # null ids last, as in SQL
    for df in (got, scores):
        dealt = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        assert dealt and not any("term" in x or "chunk_no" in x or "doc_id" in x for x in dealt), dealt
