"""Terms hashed many at once, line splitting, and the searches on packed parts, held against plain forms."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabscope.operators import retrieval as RT
from tabscope.operators import wordhash as WH


@pytest.fixture(scope="module")
def odd(spark):
    """Documents and queries with repeated, null and text ids, empty texts, long words, long documents."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" + "é" * (i % 3) + "x" * (i * 7 % 70) for i in range(300)]
    text = lambda n: " ".join(words[j] + ("\n" if j % 9 == 0 else "") for j in rng.integers(0, 300, n))
    rows = [(f"d{i % 50}", text(int(n))) for i, n in enumerate(rng.integers(0, 900, 70))] + [(None, text(40)), (None, text(30)), ("e", None), ("f", "   "), ("g", "x")]
    queries = [(i, text(12)) for i in range(300)] + [(3, text(5)), (900, "unseen"), (901, ""), (None, text(9))]
    return spark.createDataFrame(rows, "doc_id string, text string").repartition(5), spark.createDataFrame(queries, "query_id int, text string")


def test_keys_are_md5():
    rng = np.random.default_rng(0)
    words = [f"w{i}" + "é" * (i % 3) + "x" * (i % 70) for i in range(400)]
    texts = [" ".join(words[j] for j in rng.integers(0, 400, rng.integers(0, 9))) for _ in range(300)] + [None, "", "a" * 300 + " b"]
    for col in (pa.array(texts), pa.array(texts).slice(3, 250), pa.array([], pa.string())):
        found = WH.Words(col)
        text, keys = found.text_of, found.md5()
        lists = [(t or "").split() for t in col.to_pylist()]
        want = [(i, w) for i, ws in enumerate(lists) for w in ws] + [(i, f"{a} {b}") for i, ws in enumerate(lists) for a, b in zip(ws, ws[1:])]
        assert list(zip(text.tolist(), found.strings(np.arange(len(keys))).to_pylist())) == want
        assert len(set(zip(found.terms().tolist(), keys.tolist()))) == len(set(found.terms().tolist())) == len(set(keys.tolist()))
        assert keys.tolist() == [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for _, w in want]


def test_order_of_keys():
    rng = np.random.default_rng(1)
    for keys in (rng.integers(0, 1 << 63, 5000, dtype=np.uint64)[rng.integers(0, 5000, 20_000)], np.zeros(0, np.uint64),
                 rng.integers(0, 200, 9000, dtype=np.uint64)):  # the last differ only in bits that make room for the places
        assert (WH.order_of(keys) == np.argsort(keys, kind="stable")).all()


def test_lines_of_odd_texts(spark):
    breaks = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
    texts = ["", "\n", "a", "a\n\n", "\n\na", " ", None, "\r\n\r\n"] + [f"a{x}{y}b{y}" for x in breaks for y in breaks] + [f"{x}a {x} b" for x in breaks]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = dict(df.select("i", RT.split_lines(F.col("text"))).collect())

    def want(t):
        parts = re.split("\r\n|[" + "".join(b for b in breaks if len(b) == 1) + "]", t)
        return parts[:-1] if re.search("(" + "|".join(breaks) + r")\Z", t) else parts

    assert got == {i: None if t is None else [] if t == "" else want(t) for i, t in enumerate(texts)}


def test_dense_scores_of_packed_counts(spark, odd):
    docs, queries = odd
    index = RT.build_index(docs)
    stored = {"dense": index["dense"]}
    key = lambda df: sorted((str(r.query_id), str(r.doc_id), r.chunk_no, round(r.dense, 9)) for r in df.collect())
    scores = RT.dense_scores(index, queries)
    assert key(scores) == key(RT.dense_scores(stored, queries))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "bucket" not in "".join(x for x in plan.splitlines() if "HashJoin" in x or "SortMergeJoin" in x)  # pairs come from matrices


def test_an_id_over_many_rows_of_chunks():
    batches = [pa.RecordBatch.from_arrays([pa.array([i // 30] * 10), pa.array(np.arange(10, dtype=np.int32) + i % 30), pa.array(["red fox"] * 10)], names=["id", "no", "w"])
               for i in range(0, 90, 10)]
    rows = list(WH.dense_rows(iter(batches), 16, chunks=20))
    assert sorted(x for r in rows for x in r.column(1)[0].as_py()) == sorted([0] * 30 + [1] * 30 + [2] * 30)
    assert all(len(set(r.column(1)[0].as_py()) & set(s.column(1)[0].as_py())) == 0 for i, r in enumerate(rows) for s in rows[:i])
    assert all(np.allclose((WH.counts_matrix(WH.unpack(r.column(3)[0].as_py()), 16) ** 2).sum(1), 1) for r in rows)


def test_packed_parts_are_stored_once_and_score_as_joins(spark, odd):
    docs, queries = odd
    q = queries.where("query_id IS NOT NULL")
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.chunk_no, r.score, r.dense, r.lexical) for r in df.collect())
    index = RT.build_index(docs.where("doc_id IS NOT NULL"))  # the joined twin never meets null ids
    stored = {c: index[c] for c in ("chunks", "dense", "postings", "terms")}
    assert key(RT.hybrid_search(index, q, 5)) == key(RT.hybrid_search_join(stored, q, 5))
    blocks, _ = index.ask(q.select("query_id", "text"), RT.HASH_DIMS)
    assert "packed" in blocks.columns and "at" not in blocks.columns  # small enough to be stored


def test_context_cuts_only_the_documents_that_were_hit(spark, odd):
    docs = odd[0].where("doc_id IS NOT NULL")
    index = RT.build_index(docs)
    hits = index["chunks"].where("doc_id IN ('d3', 'd17')").selectExpr("1L AS request_id", "7 AS query_id", "doc_id", "chunk_no", "1d / (1 + chunk_no) AS score").distinct()
    assert RT.context_block(hits, index).collect() == RT.context_block(hits, index["chunks"]).collect()
    met = index.chunks_of(hits, True)
    assert {r.doc_id for r in met.collect()} == {"d3", "d17"}
