import os
import threading

import numpy as np
import pytest

from tabscope.llm import queries as Q
from tabscope.llm.covertree import CoverTree, Joined, greedy_cover, near_duplicates
from tabscope.llm.graph import local_roots

SF = "/root/testdata/sf0.001"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(rng, n, d, spread):
    return unit(rng.normal(size=(8, d))[rng.integers(0, 8, n)] + spread * rng.normal(size=(n, d)))


def brute(rows, cosine=0.9):
    """vec_id, n_links, component_id, kept by all pairs."""
    ok = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = {i: np.array(rows[i][1], dtype=float) / np.linalg.norm(np.array(rows[i][1], dtype=float) / np.abs(rows[i][1]).max()) / np.abs(rows[i][1]).max() for i in ok}
    pairs = [(i, j) for i in ok for j in ok if i < j and len(x[i]) == len(x[j]) and x[i] @ x[j] >= cosine]
    root = local_roots(len(rows), np.array([p[0] for p in pairs], dtype=int), np.array([p[1] for p in pairs], dtype=int))
    links = [0] * len(rows)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    return sorted(((d, links[i], d if d is None else least[root[i]], d is None or d == least[root[i]]) for i, (d, _) in enumerate(rows)), key=repr)


def test_levels_cover_and_separate():
    x = clustered(np.random.default_rng(0), 500, 6, 0.3)
    centres, owner = greedy_cover(x, 0.5, chunk=64)
    far = np.sqrt(np.maximum(2 - 2 * x[centres] @ x[centres].T, 0)) + 9 * np.eye(len(centres))
    assert far.min() > 0.5 and centres[0] == 0
    assert (np.linalg.norm(x - x[centres][owner], axis=1) <= 0.5 + 1e-9).all() and (owner[centres] == np.arange(len(centres))).all()
    tree = CoverTree(x)
    assert sorted(tree.order.tolist()) == list(range(500))
    for k, (s, e, reach, first, last) in enumerate(tree.levels):
        assert (s[1:] == e[:-1]).all() and s[0] == 0 and e[-1] == 500
        for i in range(len(s)):
            d = np.linalg.norm(tree.x[s[i]:e[i]] - tree.x[s[i]], axis=1)
            assert d.max() <= reach[i] + 1e-7 and reach[i] <= 2 / 2 ** k + 1e-7 or k == len(tree.levels) - 1


@pytest.mark.parametrize("spread", [0.02, 0.15, 0.4, 3.0])
def test_dual_traversal_finds_all_links(spread):
    rng = np.random.default_rng(4)
    x, y = clustered(rng, 300, 8, spread), clustered(rng, 200, 8, spread)
    y[:40] = x[:40]
    wa, wb = rng.integers(1, 4, 300), rng.integers(1, 4, 200)
    a, b = CoverTree(x), CoverTree(y)
    join = Joined(a, b, wa, wb, 0.9, rows=50)
    hit = x @ y.T >= 0.9
    la, lb = join.links()
    assert (la == (hit @ wb)[a.order]).all() and (lb == (wa @ hit)[b.order]).all()
    i, j = np.nonzero(hit)
    want = local_roots(500, i, 300 + j)
    place = np.r_[a.order, 300 + b.order]
    got = {}
    for p, label in enumerate(join.label):
        assert got.setdefault(label, want[place[p]]) == want[place[p]]
    linked = set(np.r_[i, 300 + j].tolist())
    assert len({want[v] for v in linked}) == len({join.label[p] for p in range(500) if place[p] in linked})


def test_edges(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.2]
    rows = [(5, v), (3, [2.0, 0.0, 0.0]), (4, v), (9, [0.95, 0.3, 0.0]), (10, w), (11, None), (12, []), (13, [0.0, 0.0, 0.0]), (14, [1.0, None, 0.0]),
            (15, [float("nan"), 1.0, 0.0]), (16, [float("inf"), 1.0, 0.0]), (17, [1.0, 0.0]), (18, [1e-300, 0.0, 0.0]), (19, [1e200, 1e199, 0.0]), (None, v), (10, w)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, n int, id int")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=repr)
    assert got == brute(rows)
    assert near_duplicates(df.limit(0)).count() == 0 and near_duplicates(df.where("vec_id = 11")).count() == 1


def test_query_and_small_blocks(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, Q.op3_embedding_near_dedup(spark, SF).collect()), key=repr) == brute(rows)
    rng = np.random.default_rng(2)
    rows = [(i, x.tolist()) for i, x in enumerate(clustered(rng, 260, 8, 0.16))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, near_duplicates(df, block=60).collect()), key=repr) == brute(rows)


def test_floats_zeros_and_copies(spark):
    rng = np.random.default_rng(5)
    x = clustered(rng, 60, 8, 0.16).astype(np.float32)
    rows = [(i, x[i % 60].tolist()) for i in range(300)] + [(i, [0.0, 1.0, -0.0]) for i in (400, 401)] + [(i, [-0.0, 1.0, 0.0]) for i in (402, 403)]
    rows += [(404, [float("nan"), 1.0]), (405, [float("-inf"), 1.0]), (406, [None, 1.0]), (407, [-0.0, 0.0]), (408, [-1.0, -2.0]), (409, [1e-45, 2e-45]), (409, [3.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted(map(tuple, near_duplicates(df, block=25).collect()), key=repr) == brute(rows)


def test_packed_tree():
    v = clustered(np.random.default_rng(6), 200, 6, 0.2).astype(np.float32) * 3
    tree = CoverTree(v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True))
    again, ids, n = CoverTree.unpack(tree.pack(v, np.arange(200), np.arange(200) * 2))
    assert (ids == tree.order).all() and (n == 2 * tree.order).all() and np.abs(again.x - tree.x).max() < 1e-12
    assert all((p == q).all() for a, b in zip(again.levels, tree.levels, strict=True) for p, q in zip(a, b, strict=True))


def test_disk_follows_vectors_not_pairs_of_blocks(spark):
    x = unit(np.random.default_rng(7).normal(size=(3000, 16))).astype(np.float32)  # no structure: all pairs of blocks meet
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def used():
        total = 0
        for top in folders:
            for base, _, names in os.walk(top):
                for name in names:
                    try:
                        total += os.path.getsize(os.path.join(base, name)) if name.startswith("shuffle") else 0
                    except FileNotFoundError:
                        pass
        return total

    most, begin, done = [0], used(), threading.Event()

    def watch():
        while not done.wait(0.05):
            most[0] = max(most[0], used() - begin)

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        got = near_duplicates(df, block=40).collect()
    finally:
        done.set()
        thread.join()
    links = (x.astype(float) @ x.T.astype(float) >= 0.9).sum(1) - 1
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(links.tolist()))
    assert most[0] < 20 * x.nbytes
