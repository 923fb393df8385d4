import re

import numpy as np
import pytest
import xxhash

from tabscope.llm.graph import components
from tabscope.llm.simhash import BKTree, fingerprint, keep_one, links, shard_bits, simhash_classes
from tabscope.llm import queries as Q

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(rows, radius=3):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted(((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "A b", "Über A-B c d \x85 e", "x " * 70000, "One two three four"])
def test_fingerprint(text):
    assert fingerprint(text) == brute_fingerprint(text)


def test_bk_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)]))
    got = {(int(q), int(v)) for qs, vs in BKTree(values, leaf=4).within(values, 3) for q, v in zip(qs, vs)}
    q, v = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3)
    assert got == set(zip(q.tolist(), v.tolist()))


def test_trees_follow_few_edges():
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    tree = BKTree(values)
    nodes, todo = 0, [tree.root]
    while todo:
        _, children = todo.pop()
        nodes += len(children or ())
        todo += (children or {}).values()
    hits = sum(len(q) for q, _ in tree.within(values, 3))
    assert hits == len(values) and nodes > 500  # each value finds itself
    assert 0 < tree.followed < 0.6 * nodes * len(values)


def test_shards_hold_thousands_at_every_size():
    assert [shard_bits(n) for n in (0, 1, 4096, 4097, 8192, 8193, 10**6, 10**12)] == [0, 0, 0, 1, 1, 2, 8, 16]
    assert shard_bits(10**12, radius=4) == 12


def test_links_through_bits_and_blocks(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = [base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
            ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for _ in range(3)]
    values = np.unique(np.concatenate([base, *near]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    whole = {r.node: r.root for r in components(links(df, 3, block=100_000)).collect()}
    assert len(whole) >= 880  # one shard: three copies of each of 300 values
    for block in (700, 60):  # one bit, and four bits with shards of more than a block
        assert {r.node: r.root for r in components(links(df, 3, block=block)).collect()} == whole


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "same words here now"), (4, "Same WORDS here now"), (4, "Same WORDS here now"), (None, "same words here now"),
            (None, "lonely text without id"), (7, "x " * 5000), (8, "x " * 5001), (9, "one"), (10, "one two")]
    df = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, fp string, copies int")
    got = simhash_classes(df).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_classes(rows)
    kept = sorted([r.doc_id for r in keep_one(df).collect()], key=repr)
    assert kept == [1, 10, 3, 7, 9, None]  # the copy without an id goes, as its class has a row with one
    assert keep_one(df).columns == df.columns
    assert simhash_classes(df.limit(0)).count() == 0


def test_large_shards_are_dealt_into_blocks(spark):
    rng = np.random.default_rng(3)
    low = rng.integers(0, 1 << 12, 700)
    values = np.unique(low.astype(np.int64) | (5 << 40))
    df = spark.createDataFrame([(int(v),) for v in values], "fp long")
    got = {r.node: r.root for r in components(links(df, 3, block=100)).collect()}
    whole = {r.node: r.root for r in components(links(df, 3, block=100000)).collect()}
    assert got == whole and len(got) == len(values) - 1


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 150)}}


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Q.op10_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_classes(rows)


def test_keep_one_tells_rows_by_id_and_text(spark):
    from tabscope.llm.simhash import keep_one
    a, b, c = "one two three four five six seven " * 9, "other words stand here in this quite unlike text " * 9, "zebra apple lemon melon grape " * 12
    rows = [(1, a), (1, b), (2, a), (2, a), (3, c), (3, c), (None, a), (None, "nothing else is like this at all, is it"), (None, "nothing else is like this at all, is it"), (4, None), (5, "")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, h int")
    got = sorted(((r.doc_id, r.text) for r in keep_one(df).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (3, c), (None, rows[7][1]), (4, None)], key=repr)
    assert keep_one(df.limit(0)).count() == 0 and keep_one(df).columns == df.columns
