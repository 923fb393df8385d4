"""Statistics that go to the driver, dictionaries and ranks: what is scanned, shuffled and held, beside the results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.operators import autofeatures as AF
from tabscope.operators import quantiles as Q
from tabscope.operators.common import long_form


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_quantiles_equal_numpy_and_the_three_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 1501
    cols = {"normal": rng.normal(size=n), "few": rng.integers(0, 4, n).astype(float), "wide": np.exp(rng.normal(size=n) * 50), "one": np.full(n, 3.0),
            "far": np.where(rng.random(n) < 0.3, math.inf, rng.normal(size=n) * 1e300), "near": 1e9 + rng.random(n) * 1e-3}
    rows = [tuple(float(x) for x in r) + (None, math.nan if i % 3 else 1.0 * i) for i, r in enumerate(zip(*cols.values()))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*cols, "none", "nans"]))
    probs = [0, 0.01, 0.25, 0.5, 0.9, 1]
    names = [c for c in df.columns]
    three = {r["column"]: r["q"] for r in Q.quantile_table(long_form(df, names), probs).collect()}
    for slot_rows in (Q.SLOT_ROWS, 20):  # the second: crowded slots
        monkeypatch.setattr(Q, "SLOT_ROWS", slot_rows)
        got = Q.exact_quantiles(df, names, probs)
        assert set(got) == set(three) == set(names) - {"none"} and str(got) == str({c: three[c] for c in got})
        for c in ("normal", "few", "wide", "one", "near"):
            assert got[c] == pytest.approx(np.quantile(cols[c], probs), rel=1e-14)


def test_rounding_never_falls_where_values_rise(spark):
    powers = [float(2.0 ** k) for k in range(-1074, 1024, 7)]
    values = sorted({s * v for p in powers for v in (p, p * 1.0000001, float(np.nextafter(p, 0)), float(np.nextafter(p, math.inf))) for s in (1, -1)} | {math.inf, -math.inf})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for bits in Q.ROUNDED_BITS:
        got = [r["x"] for r in df.select("i", Q.rounded(F.col("v"), bits).alias("x")).orderBy("i").collect()]
        assert all(a <= b for a, b in zip(got, got[1:])) and got[0] == -math.inf and got[-1] == math.inf
        assert all(abs(a - v) <= abs(v) * 2.0 ** (bits - 53) for a, v in zip(got, values) if 1e-300 < abs(v) < 1e300)


def test_rows_stay_where_they_are_when_a_dictionary_is_small(spark):
    df = spark.range(3000).selectExpr("id AS k", "concat('m', id % 40) AS maker", "CAST(id % 7 AS DOUBLE) AS y", "CAST(id % 11 AS DOUBLE) AS price")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the table were large
    try:
        out, fitted = AF.auto_features(df, "y", ["k"], task="regression")
        assert "maker" in fitted.levels and "BroadcastHashJoin" in plan(out) and "Exchange hashpartitioning" not in plan(out)
        fitted.n_levels["maker"] = AF.BROADCAST_LEVELS + 1
        large = AF.apply_features(df, fitted, training=True)
        assert "SortMergeJoin" in plan(large)
        assert sorted(map(tuple, large.collect())) == sorted(map(tuple, out.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_distinct_values_are_told_without_a_shuffle_of_values(spark):
    from tabscope.operators.assoc import _some_distinct
    from tabscope.operators.schema import select_numeric_columns
    df = spark.range(200).selectExpr("CAST(id AS DOUBLE) AS many", "id % 3 AS three", "CAST(id % 2 AS INT) AS two", "1.5D AS one", "CAST(NULL AS DOUBLE) AS none",
                                     "IF(id % 50 = 0, id % 4, NULL) AS rare", "CASE id % 3 WHEN 0 THEN double('NaN') WHEN 1 THEN double('inf') ELSE -0.0D END AS odd")
    want = {"many": (200, 4), "three": (200, 3), "two": (200, 2), "one": (200, 1), "none": (0, 0), "rare": (4, 2), "odd": (200, 3)}
    assert _some_distinct(df, df.columns, 4) == want
    assert {c: _some_distinct(df, [c], 3)[c][1] for c in df.columns} == {c: min(3, d) for c, (_, d) in want.items()}
    chosen = select_numeric_columns(df.drop("odd"))
    assert [r["column"] for r in chosen.collect()] == ["many", "three"] and "xxhash64" not in plan(chosen)


def test_pairwise_deviations_are_shared_where_no_value_is_missing(spark):
    from tabscope.operators.assoc import pearson_pairs
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    rows = [(float(a), float(b), float(c) if i % 5 else None) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["col1"], r["col2"]): (r["pearson_r"], r["n_pairs"]) for r in pearson_pairs(df, with_p=False).collect()}
    some = np.array([i % 5 > 0 for i in range(400)])
    for i, j in ((0, 1), (0, 2), (1, 2)):
        rows = x if j == 1 else x[some]
        assert got["abc"[i], "abc"[j]] == (pytest.approx(np.corrcoef(rows[:, i], rows[:, j])[0, 1], abs=1e-6), len(rows))
    full = plan(pearson_pairs(df.drop("c"), with_p=False))
    assert "CASE WHEN isnotnull" not in full.split("Results")[-1] and "stddev_samp(CASE" not in full


def test_ranks_are_counted_in_tasks_by_the_rows_and_first_groups_are_of_their_column(spark, monkeypatch):
    from tabscope.operators import assoc as H
    from tabscope.operators import window as W
    rng = np.random.default_rng(6)
    rows = [("a" if i % 3 else "b", float(v), None if i % 3 else float(v)) for i, v in enumerate(rng.integers(0, 40, 900))]
    rows = [(g, 7.0 if i % 4 == 0 else x, y) for i, (g, x, y) in enumerate(rows)]  # a frequent value
    df = spark.createDataFrame(rows, "g string, x double, y double")  # y has no value in the first group
    a, b = (np.array([x for g, x, _ in rows if g == k]) for k in "ab")
    u = float((a[:, None] > b).sum() + (a[:, None] == b).sum() / 2)
    monkeypatch.setattr(W, "RANK_ROWS", 50)
    got = H.ttest_pairs(df, ["g"], ["x", "y"], with_p=False).collect()
    assert [(r["numeric_col"], r["n_group1"], r["mannwhitney_u"]) for r in got] == [("x", 600, u)]
    counts, parts = W.counted_values(df, [], "x", with_y=F.col("y"))
    assert parts == 18 and counts.rdd.getNumPartitions() == 18
    assert {r["x"]: (r["n"], r["with_y"]) for r in counts.collect()} == {v: (sum(x == v for _, x, _ in rows), sum(x == v and y is not None for _, x, y in rows)) for _, v, _ in rows}
