"""V2: every rule fires on some frame; a plan fitted on one table gives other rows the same features."""

import math

import pytest

from tabscope.operators import autofeatures as AF
from tabscope.operators.features import apply_feature_spec


def frame(spark, n=60):
    rows = [(i, f"c{i % 2}", float(i % 7), float(1 + i % 4), float(i % 5), float(10 + i), float(i % 3), float(i % 6), "yes" if i % 2 else "no", i % 2 == 0, i % 3 == 0,
             f"m{i % 30}", None if i == 5 else float(i), math.exp(i / 10)) for i in range(n)]
    return spark.createDataFrame(rows, "cust_id int, tier string, area double, qty double, `number` double, price double, rate double, age double, is_a string, "
                                       "has_b boolean, was_c boolean, maker string, plain double, y double")


def test_plan_of_a_regression_and_of_classes(spark):
    names = [s.name for s in AF.plan_features(frame(spark), "y", task="regression")]
    assert names == ["log_transform_target", "impute_missing_values", "drop_id_columns", "target_encode_high_cardinality", "area_per_qty", "price_per_age",
                     "aggregate_flag_score", "area_x_qty", "qty_to_number_ratio", "price_x_rate", "age_bin", "area_bin"]
    imp = spark.createDataFrame([("plain", 0.5), ("price", 0.4), ("maker", 0.001), (None, 0.9)], "feature string, importance double")
    steps = AF.plan_features(frame(spark), "tier", importance=imp, underfit=True)
    got = {s.rule: s.inputs for s in steps}
    assert got["B11"] == ("plain", "price") and got["C2"] == ("maker",) and {"B12", "C1"} <= got.keys() and "A1" not in got
    assert [s.priority for s in steps] == sorted(s.priority for s in steps)


def test_fitted_on_one_table_applied_to_another(spark):
    df = frame(spark)
    fitted = AF.fit_features(df, "y", AF.plan_features(df, "y", task="regression"))
    new = spark.createDataFrame([("c0", 3.0, 0.0, 2.0, 999.0, 1.0, 0.0, "YES", True, None, "m3", None), (None, None, 2.0, None, None, None, None, None, None, None, "new", 1.0)],
                                "tier string, area double, qty double, `number` double, price double, rate double, age double, is_a string, has_b boolean, was_c boolean, maker string, plain double")
    a, b = sorted(AF.apply_features(new.selectExpr("1 AS cust_id", "*"), fitted).collect(), key=lambda r: -r["price"])
    assert "cust_id" not in a.__fields__ and "y" not in a.__fields__
    assert (a["area_per_qty"], a["price_per_age"], a["flag_score"], a["is_a_bin"], a["area_bin"]) == (3.0, 999.0, 2.0, 1, "m")
    assert a["plain"] == pytest.approx(30.0) and a["age_bin"] == "low"  # the fitted median; a value on the first edge
    ys = [math.log1p(math.exp(i / 10)) for i in range(60)]
    assert a["maker"] == pytest.approx((ys[3] + ys[33]) / 2) and b["maker"] == pytest.approx(sum(ys) / 60)  # a level that was not fitted
    assert b["tier"] == "Unknown" and b["area"] == 3.0 and b["flag_score"] == 0.0
    train = {r["plain"]: r for r in AF.apply_features(df, fitted, training=True).collect()}
    assert train[3.0]["maker"] == pytest.approx(ys[33]) and train[3.0]["y"] == pytest.approx(ys[3])
    assert dict(fitted.spec)["qty_to_number_ratio"] and apply_feature_spec(df, fitted.spec).count() == 60


def test_classes_codes_and_products(spark):
    df = frame(spark).select("tier", "area", "qty", "is_a", "maker")
    out, fitted = AF.auto_features(df, "tier", underfit=True)
    rows = out.collect()
    assert {r["is_a"] for r in rows} == {0.0, 1.0} and {r["tier"] for r in rows} == {"c0", "c1"}
    assert {(r["maker"], r["tier"]) for r in rows} == {(0.0, "c0"), (1.0, "c1")}  # each maker has one class
    assert all(r["area_x_qty_poly"] == r["area"] * r["qty"] for r in rows) and "maker_x_is_a_poly" in out.columns or "is_a_x_maker_poly" in out.columns
    one = spark.createDataFrame([("c9", 1.0, 1.0, "perhaps", None)], df.schema)
    r = AF.apply_features(one, fitted).first()
    assert r["is_a"] == -1.0 and r["maker"] == pytest.approx(0.5) and r["area_bin"] == 4.0  # the bins are text and encoded too: l, m, s, xl, xs


def test_left_skew_far_values_and_empty(spark):
    left = spark.createDataFrame([(float(i % 3), 1000.0 if i == 0 else float(i % 9), -math.exp(i / 10)) for i in range(50)], "a double, b double, y double")
    out, fitted = AF.auto_features(left, "y", task="regression")
    assert [s.name for s in fitted.steps] == ["reflect_log_target", "winsorize_outliers", "polynomial_features"]
    assert out.agg({"b": "max"}).first()[0] < 1000 and "a_x_b_poly" in out.columns
    assert min(r["y"] for r in out.collect()) == pytest.approx(math.log1p(1.0))
    out, _ = AF.auto_features(frame(spark).limit(0), "y", task="regression")
    assert out.count() == 0 and "flag_score" in out.columns
