"""Ranges, draws, pruning, failures, members, stacks, weights, sparse one-hot."""

import math

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tabscope.operators import features as FE
from tabscope.operators import ml as M
from tabscope.operators import tuning as TU


@pytest.fixture(scope="module")
def line(spark):
    """y = 3x + noise, a class of x, a text level, a rare class weight."""
    return spark.range(400).select(
        F.col("id"), (F.col("id") % 37).cast("double").alias("x"), F.concat(F.lit("t"), F.col("id") % 3).alias("s"),
        ((F.col("id") % 37) * 3 + (F.col("id") % 5)).cast("double").alias("y"),
        F.when(F.col("id") % 37 > 24, "c").when(F.col("id") % 37 > 12, "b").otherwise("a").alias("k"))


def test_grid_follows_the_run(spark):
    runs = spark.createDataFrame([
        (1, "regression", "CatBoostRegressor", 5000, 0.95, 0.6, False, None),       # overfit, no linear
        (2, "regression", "LGBMRegressor", 500, 0.9, 0.88, False, None),            # healthy and small
        (3, "classification", None, 200000, None, None, True, True),                # nothing reported but dates, large, imbalanced
        (4, "regression", "Ridge", None, 0.3, 0.2, None, None),                     # underfit, no size
    ], "run_id long, task string, model string, n_samples long, train_r2 double, test_r2 double, has_datetime boolean, class_imbalance boolean")
    rows = TU.choose_grid(runs).collect()
    got = {i: [m for _, m in sorted({(r.priority, r.model) for r in rows if r.run_id == i})] for i in (1, 2, 3, 4)}
    assert got == {1: ["lightgbm", "catboost", "xgboost", "random_forest"], 2: ["catboost", "xgboost", "linear", "stacking"],
                   3: ["lightgbm", "catboost", "xgboost", "time_folds", "large_data"],
                   4: ["lightgbm", "catboost", "xgboost", "random_forest", "linear"]}
    deepest = {(r.run_id, r.model): r.high for r in rows if r.param == "maxDepth"}
    assert deepest[1, "catboost"] == 4 and deepest[2, "catboost"] == 8 and deepest[4, "random_forest"] == 20 and deepest[1, "random_forest"] == 8
    assert {r.weighted for r in rows if r.run_id == 3} == {True} and {r.folds for r in rows if r.model == "time_folds"} == {"time"}
    assert TU.choose_grid(runs.limit(0)).count() == 0 and TU.choose_grid(spark.createDataFrame([(9,)], "run_id long")).count() > 0


def test_draws_stay_in_their_ranges(spark):
    grid = spark.createDataFrame([("m", "f", "a", "int", 2.0, 4.0), ("m", "f", "b", "log", 0.001, 10.0), ("m", "f", "c", "uniform", -1.0, 1.0),
                                  ("m", "f", None, None, None, None)], "model string, family string, param string, kind string, low double, high double")
    rows = TU.draw_trials(grid, 400).collect()
    assert len(rows) == 1200 and all(r.low <= r.value <= r.high for r in rows)
    assert {r.value for r in rows if r.param == "a"} == {2.0, 3.0, 4.0}
    small = sum(r.value < 0.1 for r in rows if r.param == "b")
    assert 150 < small < 250  # half of the decades
    again = {(r.param, r.trial): r.value for r in TU.draw_trials(grid.repartition(5), 400).collect()}
    assert again == {(r.param, r.trial): r.value for r in rows}
    assert TU.draw_trials(grid, 400, seed=7).where("param = 'c'").first().value != again["c", 0]


def test_tune_takes_the_grid_unchanged_prunes_and_records_failures(spark, line):
    lab = line.withColumn("label", F.col("y"))
    grid = TU.choose_grid(spark.createDataFrame([(1, 400)], "run_id int, n_samples long")).where("model = 'linear'")
    trials = TU.tune(lab, M.build_preprocessor(["x"], ["s"]), grid, "regression", ["id"], trials=16, startup=4)
    rows = sorted(trials.collect(), key=lambda r: r.trial)
    assert [r.trial for r in rows] == list(range(16)) and {r.state for r in rows} == {"complete", "pruned"}
    seen: list = []
    for i in range(0, 16, 4):  # every verdict from the waves before
        for r in rows[i:i + 4]:
            first = sorted(seen)
            mid = (first[(len(first) - 1) // 2] + first[len(first) // 2]) / 2 if len(first) >= 4 else -math.inf
            assert (r.state == "pruned") == (r.scores[0] < mid) and r.step == len(r.scores) == (1 if r.state == "pruned" else 2)
            assert (r.score is None) == (r.state == "pruned")
        seen += [r.scores[0] for r in rows[i:i + 4]]
    (name, family, params), = TU.best_registry(trials)
    best = max((r for r in rows if r.state == "complete"), key=lambda r: (r.score, -r.trial))
    assert (name, family, params) == ("linear", "linear", best.params) and best.score > 0.9
    res, _ = M.run_models(line, "y", "regression", ["id"], ["x"], ["s"], [(name, family, params)], folds=2)
    assert res.first().status == "ok"
    bad = spark.createDataFrame([(1, "m", "linear", "regParam", "uniform", -2.0, -1.0)], "run_id int, model string, family string, param string, kind string, low double, high double")
    failed = TU.tune(lab, M.build_preprocessor(["x"]), bad, "regression", ["id"], trials=2).collect()
    assert [r.state for r in failed] == ["error"] * 2 and all(r.error for r in failed)
    with pytest.raises(ValueError):
        TU.tune(lab, [], bad.union(bad.withColumn("run_id", F.lit(2))), "regression", ["id"])


def test_members_of_each_family_then_by_score(spark):
    rows = [("x", "a1", "a", "ok", 0.9), ("x", "a2", "a", "ok", 0.8), ("x", "a3", "a", "ok", 0.7), ("x", "b1", "b", "ok", 0.1),
            ("y", "p", "p", "ok", 0.5), ("y", "q", "q", "ok", 0.5), ("y", "r", "r", "ok", 0.4), ("y", "s", "s", "ok", 0.3),
            ("z", "m", "m", "ok", 0.5), ("z", "n", "n", "error", 0.9), ("z", "o", "o", "ok", None), ("z", "w", "w", "ok", 0.1),
            ("t", "c", "a", "ok", 0.5), ("t", "b", "a", "ok", 0.5), ("t", "a", "a", "ok", 0.5), ("t", "d", "a", "ok", 0.5)]
    res = spark.createDataFrame(rows, "d string, model string, family string, status string, score double")
    got = {}
    for r in TU.stack_members(res, ["d"]).orderBy("d", "member").collect():
        got.setdefault(r.d, []).append(r.model)
    assert got == {"x": ["a1", "b1", "a2"], "y": ["p", "q", "r", "s"], "t": ["a", "b", "c"]}
    assert [r.model for r in TU.stack_members(res.where("d = 'x'")).orderBy("member").collect()] == ["a1", "b1", "a2"]


def test_stack_of_classes_reads_probabilities_and_texts(spark, line):
    reg = [("logistic", "logistic", {}), ("forest", "random_forest", {"numTrees": 5}), ("forest2", "random_forest", {"numTrees": 3})]
    res, _ = M.run_models(line, "k", "classification", ["id"], ["x"], ["s"], reg, folds=2)
    row = TU.stack_models(line, "k", "classification", ["id"], ["x"], ["s"], res, folds=2)
    assert row.columns == res.columns
    r = row.first()
    assert r.model == "StackingEnsemble" and r.family == "ensemble" and r.test_score > 0.9 and r.cv_mean > 0.9 and "logistic" in r.params
    lab, low, high, _ = M.prepare_frame(line, "k", "classification", ["x"], ["s"])
    oof = TU.out_of_fold(M.kfold_assign(lab, ["id"], 2), reg[:2], "classification", ["x"], low, high, 2, 3)
    assert oof.count() == 400 and {len(x.p_1) for x in oof.collect()} == {3}
    assert TU.stack_models(line, "k", "classification", ["id"], ["x"], ["s"], res.limit(1), folds=2).count() == 0


def test_boosted_trees_use_weights(spark, line):
    df = line.withColumn("label", (F.col("id") % 4 == 0).cast("double")).withColumn("w", F.when(F.col("label") == 1, 100.0).otherwise(1.0))
    stages = M.build_preprocessor(["x"])
    ones = [Pipeline(stages=stages + [M.estimator("boosted_trees", "classification", weight=w, maxIter=2)]).fit(df).transform(df)
            .where("prediction = 1").count() for w in (None, "w")]
    assert ones[0] < 200 < ones[1]


def test_sparse_one_hot_equals_dense(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, None, 20), (4, "a", 20), (4, "a", 20), (5, "z", 30)], "id long, u string, one_hot2 long")
    fit = df.where("id < 5")
    d = FE.one_hot_dictionary(fit, ["u", "one_hot2"])
    assert [(r.column, r.level, r["index"]) for r in d.orderBy("index").collect()] == [("one_hot2", "10", 0), ("one_hot2", "20", 1), ("u", "a", 2), ("u", "b", 3)]
    got = sorted((r.id, tuple(r.one_hot.indices), tuple(r.one_hot["values"]), r.one_hot.size) for r in FE.one_hot_sparse(df, d, ["u", "one_hot2"]).collect())
    assert got == [(1, (0, 2), (1.0, 1.0), 4), (2, (3,), (1.0,), 4), (3, (1,), (1.0,), 4), (4, (1, 2), (1.0, 1.0), 4), (4, (1, 2), (1.0, 1.0), 4), (5, (), (), 4)]
    assert {r.level for r in FE.one_hot_dictionary(fit, ["u"], drop_first=True).collect()} == {"b"}
    assert FE.one_hot_sparse(df.limit(0), d, ["u"]).count() == 0
    many = spark.range(300_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("u"))
    enc = FE.one_hot_sparse(many, FE.one_hot_dictionary(many, ["u"]), ["u"])
    assert enc.agg(F.count_distinct(F.col("one_hot.indices")[0])).first()[0] == 200_001 and enc.count() == 300_000


def test_rows_of_a_fit_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(M, "TASK_ROWS", 10)
    df = spark.createDataFrame([(i, float(i % 7), str(i % 3), 2.0 * i) for i in range(80)], "id long, x double, s string, y double").coalesce(1)
    got = M.dealt_rows(df, "y", ["id"], ["x"], ["s"])
    assert got.rdd.getNumPartitions() == 8 and sorted(got.select("id").toPandas()["id"]) == list(range(80))
