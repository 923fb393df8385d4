"""Profile, association and p-value operators on hand-made frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscope.functions import pvalues as PV
from tabscope.operators import assoc as H
from tabscope.operators import profile as P


def test_t_f_chi2_tails_match_commons_math(spark):
    jvm = spark.sparkContext._jvm
    dist = jvm.org.apache.commons.math3.distribution
    for t, df in [(0.5, 3), (2.1, 10), (-3.3, 25), (1.96, 1000)]:
        ref = 2 * (1 - dist.TDistribution(float(df)).cumulativeProbability(abs(t)))
        assert PV.t_two_sided(t, df) == pytest.approx(ref, rel=1e-7, abs=1e-12)
    for f, d1, d2 in [(1.2, 2, 10), (4.5, 3, 40), (0.3, 5, 5)]:
        ref = 1 - dist.FDistribution(float(d1), float(d2)).cumulativeProbability(f)
        assert PV.f_upper(f, d1, d2) == pytest.approx(ref, rel=1e-7, abs=1e-12)
    for x, k in [(0.5, 1), (3.84, 1), (12.0, 8), (60.0, 30)]:
        ref = 1 - dist.ChiSquaredDistribution(float(k)).cumulativeProbability(x)
        assert PV.chi2_upper(x, k) == pytest.approx(ref, rel=1e-7, abs=1e-12)
    assert PV.norm_two_sided([1.96])[0] == pytest.approx(0.04999579, rel=1e-6)


def test_describe_matches_pandas_and_edge_frames(spark):
    rng = np.random.default_rng(1)
    x = rng.gamma(2.0, 3.0, 500)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "c": 5.0}))
    d = {r["column"]: r for r in P.describe_numeric(df).collect()}
    s = pd.Series(x)
    assert d["x"]["median"] == pytest.approx(round(s.median(), 6))
    assert d["x"]["p99"] == pytest.approx(round(s.quantile(0.99), 6))
    assert d["x"]["skewness"] == pytest.approx(round(s.skew(), 6), abs=1e-6)
    assert d["x"]["kurtosis"] == pytest.approx(round(s.kurtosis(), 6), abs=1e-6)
    # constant column: iqr 0, skew 0 (pandas), no IQR outliers reported
    assert d["c"]["iqr"] == 0 and d["c"]["skewness"] == 0
    assert P.outliers_by_column(df, ["c"]).count() == 0
    one = spark.createDataFrame([(1.0,)], "x double")
    r = P.describe_numeric(one).first()
    assert r["std"] is None and r["skewness"] is None and r["skew_label"] == "unknown"


def test_missing_and_all_null(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    m = {r["column"]: r for r in P.missing_by_column(df).collect()}
    assert m["a"]["count"] == 1 and m["a"]["severity"] == "high"
    assert m["b"]["pct"] == 100.0 and m["b"]["severity"] == "critical"
    s = P.missing_summary(df).first()
    assert s["completely_null_cols"] == "b" and s["total_missing_cells"] == 4


def test_histogram_equals_numpy(spark):
    x = np.random.default_rng(3).normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    h = sorted((r["bin"], r["n"]) for r in P.histogram(df, ["x"]).collect())
    counts, _ = np.histogram(x, bins=30)
    assert [n for _, n in h] == counts.tolist()


def test_string_quality_text_dirty(spark):
    df = spark.createDataFrame([(" a",), ("A",), ("a",), ("",)], "s string")
    r = P.string_quality(df).first()
    assert r["n_empty"] == 1 and r["n_padded"] == 1 and r["extra_variants"] == 1


def test_chi_square_yates_two_by_two(spark):
    rows = [("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30 + [("y", "q")] * 15
    df = spark.createDataFrame(rows, "a string, b string")
    r = H.chi_square_pairs(df, ["a", "b"]).first()
    # hand computation with the continuity correction
    obs = np.array([[10, 20], [30, 15]], dtype=float)
    e = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    chi2 = (((np.abs(obs - e) - 0.5) ** 2) / e).sum()
    assert r["dof"] == 1 and r["chi2"] == pytest.approx(round(chi2, 6))
    assert r["p_value"] == pytest.approx(PV.chi2_upper(chi2, 1), abs=1e-6)


def test_ttest_and_mann_whitney_hand_values(spark):
    g1 = [1.0, 2.0, 3.0, 4.0, 5.0]
    g2 = [2.0, 4.0, 6.0, 8.0, 10.0, 12.0]
    df = spark.createDataFrame([("a", v) for v in g1] + [("b", v) for v in g2], "g string, v double")
    r = H.ttest_pairs(df, ["g"], ["v"]).first()
    a, b = np.array(g1), np.array(g2)
    se = math.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b))
    sp = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)
    t_student = (a.mean() - b.mean()) / math.sqrt(sp * (1 / len(a) + 1 / len(b)))
    t_welch = (a.mean() - b.mean()) / se
    assert r["t_statistic"] in (pytest.approx(round(t_student, 6)), pytest.approx(round(t_welch, 6)))
    # U of the first group: ranks of g1 in the pooled sample
    pooled = pd.Series(np.concatenate([a, b])).rank()
    u = pooled[:5].sum() - 5 * 6 / 2
    assert r["mannwhitney_u"] == pytest.approx(u)


def test_anova_and_kruskal(spark):
    groups = {"a": [1.0, 2.0, 3.0], "b": [2.0, 3.0, 4.0, 5.0], "c": [6.0, 7.0, 8.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "g string, v double")
    r = H.anova(df, ["g"], ["v"]).first()
    allv = np.concatenate([np.array(v) for v in groups.values()])
    gm = allv.mean()
    ssb = sum(len(v) * (np.mean(v) - gm) ** 2 for v in groups.values())
    ssw = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values())
    f = (ssb / 2) / (ssw / (len(allv) - 3))
    assert r["f_statistic"] == pytest.approx(round(f, 6))
    assert r["eta_squared"] == pytest.approx(round(ssb / (ssb + ssw), 6))
    ranks = pd.Series(allv).rank().to_numpy()
    n = len(allv)
    idx, rsum = 0, 0.0
    for v in groups.values():
        rsum += ranks[idx:idx + len(v)].sum() ** 2 / len(v)
        idx += len(v)
    _, cnt = np.unique(allv, return_counts=True)
    h = (12 / (n * (n + 1)) * rsum - 3 * (n + 1)) / (1 - (cnt ** 3 - cnt).sum() / (n ** 3 - n))
    assert r["kruskal_h"] == pytest.approx(round(h, 6))


def test_vif_perfect_collinearity_is_infinite(spark):
    x = np.arange(100, dtype=float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 2 * x + 1, "z": np.sin(x)}))
    rows = {r["feature"]: r for r in H.vif(df, ["x", "y", "z"]).collect()}
    assert rows["x"]["vif"] is None and rows["x"]["status"] == "severe_multicollinearity"


def test_normality_k2_on_normal_and_skewed(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(pd.DataFrame({"n": rng.normal(size=2000), "e": rng.exponential(size=2000)}))
    r = {x["column"]: x for x in P.normality_k2(df).collect()}
    assert r["e"]["normality_verdict"] == "non-normal"
    assert r["n"]["k2"] < 20


def test_compare_runs(spark):
    from tabscope.operators.ml import compare_runs
    schema = "task string, model string, status string, score double"
    raw = spark.createDataFrame([("t", "lin", "ok", 0.5), ("t", "rf", "ok", 0.6), ("t", "gbt", "error", None)], schema)
    eng = spark.createDataFrame([("t", "rf", "ok", 0.66), ("u", "lin", "ok", 0.1)], schema)
    got = {r["task"]: r for r in compare_runs(raw, eng).collect()}
    assert got["t"]["raw_model"] == "rf" and got["t"]["delta"] == pytest.approx(0.06) and got["t"]["pct"] == pytest.approx(10.0)
    assert got["u"]["raw_score"] is None and got["u"]["delta"] is None
