import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabscope.llm import queries as Q
from tabscope.llm.whitening import above, fit_whitening, inertia, leading, quantised, whiten

SF = "/root/testdata/sf0.001"


@given(st.integers(1, 12), st.integers(0, 10**6))
@settings(max_examples=200, deadline=None)
def test_inertia_counts(d, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(-3, 4, (d, d)).astype(float)
    a = a + a.T
    e = np.linalg.eigvalsh(a)
    if np.abs(e).min() > 1e-9:
        assert inertia(a) == ((e > 0).sum(), (e < 0).sum(), 0)
    shift = float(rng.normal())
    if np.abs(e - shift).min() > 1e-9:
        assert above(a, shift) == (e > shift).sum()


def spectrum(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("values", [[9, 5, 3, 2, 1, 0.5], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.1], [1e9, 1, 1e-3, 1e-4, 1e-6], [3, 3, 3, 1, 0], [2, 2, 2, 2, 2],
                                    [1e-12, 1e-13, 1e-14, 1e-15], [7], [4, 0, 0], list(np.linspace(1, 2, 64))])
def test_leading_pairs(values):
    v = spectrum(values, len(values))
    v = (v + v.T) / 2
    want = np.sort(np.linalg.eigvalsh(v))[::-1][:4]
    got = leading(v, 4)
    vectors = np.array([c.vector for c in got]).T
    assert len(got) == min(4, len(values)) and all(c.certified for c in got)
    assert np.allclose([c.value for c in got], want, rtol=1e-9, atol=1e-12 * want[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-9
    assert np.linalg.norm(v @ vectors - vectors * want, axis=0).max() <= 1e-13 * len(v) * want[0]


def plain(rows, k=4):
    """The contract by exact sums and numpy.linalg.eigh, for vectors of one dimension."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(col) for col in zip(*fit)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    c = np.array(fit, dtype=float) - mean
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    q = q * np.sign(q[np.abs(q).argmax(axis=0), range(q.shape[1])])
    out = {}
    for i, x in kept:
        white = (np.array(x, dtype=float) - mean) @ q / np.sqrt(e)
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for j in range(len(e)):
            out.setdefault((i, j + 1), []).append((n, deviation, white[j], e[j] / np.trace(v)))
    return out


def same(got, want, rtol=1e-8):
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        n, deviation, white, explained = want[(r["vec_id"], r["component"])][0]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"] - white) <= rtol * 10 and abs(r["explained"] - explained) <= rtol and r["identity_error"] <= 1e-9


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same(Q.op13_embedding_whitening(spark, SF).collect(), plain(rows))


def test_edge_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(40)]
    rows = good + [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [math.nan] * 6), (103, [math.inf] + [0.0] * 5), good[3], good[3],
                   (None, good[5][1]), (104, [-0.0] * 6)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, dim int, x string")
    got = whiten(frame).collect()
    same(got, plain(rows))
    assert whiten(frame.limit(0)).count() == 0
    assert {r["vec_id"] for r in got} == {i for i, _ in good} | {None, 104}


def test_flat_short_huge_and_mixed_dimensions(spark):
    rows = [(1, []), (2, [0.5]), (3, [0.25, 1.0]), (4, [0.5, 1.0]), (5, [1e300, 0.0, 0.0]), (6, [-1e300, 1e30, 3.4e18]), (7, [1.0] * 5), (8, [1.0] * 5)]
    got = {(r["vec_id"], r["component"]): r for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sorted(got) == [(2, 1), (3, 1), (3, 2), (4, 1), (4, 2), *[(i, c) for i in (5, 6) for c in (1, 2, 3)], *[(i, c) for i in (7, 8) for c in (1, 2, 3, 4)]]
    assert got[(2, 1)]["whitened"] is None and got[(2, 1)]["explained"] is None and got[(2, 1)]["deviation"] == 0
    assert abs(abs(got[(3, 1)]["whitened"]) - 1) < 1e-12 and got[(3, 2)]["whitened"] is None and got[(3, 1)]["explained"] == 1.0
    assert got[(5, 1)]["deviation"] is None and got[(7, 1)]["n"] == 1


def test_fit_keeps_copies_once(spark):
    rows = [(i, [float(i % 5), float(i % 3), 1.0 * (i % 2)]) for i in range(300)]
    fits, errors = fit_whitening(quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), 2)
    assert fits[3].n == 30 and errors[3] < 1e-9
