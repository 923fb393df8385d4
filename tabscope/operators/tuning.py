"""Recommended models with their ranges, seeded trials with median pruning, stacking of the best models.

``choose_grid`` makes rows of ranges from runs, ``draw_trials`` rows of parameters from ranges, ``tune`` a row per trial.
"""

from __future__ import annotations

import ast
import time
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from statistics import median

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ml as M
from .reports import run_state

# Trials a model, share of rows that judge a trial, trials before any is pruned.
TRIALS = 50
INNER_FRAC = 0.2
STARTUP = 10
#: Shares of the fitting rows on which a trial is judged, one after the other.
FRACTIONS = (0.25, 1.0)
#: Members that a stack needs at least.
LEAST_MEMBERS = 3

# Models in order of recommendation: (model, family, condition). Boosted trees stand for all boosting libraries.
RECOMMENDED = [
    ("lightgbm", "'boosted_trees'", "NOT model_now RLIKE 'lgbm|lightgbm' OR (model_now LIKE '%catboost%' AND overfit)"),
    ("catboost", "'boosted_trees'", "true"),
    ("xgboost", "'boosted_trees'", "true"),
    ("random_forest", "'random_forest'", "overfit OR underfit"),
    ("linear", "IF(regression, 'linear', 'logistic')", "n_samples < 1000 OR underfit"),
    ("time_folds", "'boosted_trees'", "has_datetime"),
    ("stacking", "'ensemble'", "healthy"),
    ("large_data", "'boosted_trees'", "n_samples > 100000"),
]
# Ranges, the ends mostly fixed values, in the names of pyspark.ml: (model, parameter, kind, low, high, condition); shallower and more regular where a run overfits.
RANGES = [
    ("lightgbm", "maxIter", "int", "100", "800", "true"),
    ("lightgbm", "stepSize", "log", "0.01", "0.15", "true"),
    ("lightgbm", "maxDepth", "int", "2", "IF(overfit, 5, 6)", "true"),
    ("lightgbm", "minInstancesPerNode", "int", "IF(overfit, 30, 10)", "100", "true"),
    ("lightgbm", "subsamplingRate", "uniform", "0.5", "1.0", "true"),
    ("catboost", "maxIter", "int", "200", "1000", "true"),
    ("catboost", "stepSize", "log", "0.01", "0.15", "true"),
    ("catboost", "maxDepth", "int", "3", "IF(overfit, 4, 8)", "true"),
    ("catboost", "minInstancesPerNode", "int", "5", "50", "true"),
    ("xgboost", "maxIter", "int", "100", "800", "true"),
    ("xgboost", "stepSize", "log", "0.01", "0.15", "true"),
    ("xgboost", "maxDepth", "int", "2", "IF(overfit, 4, 8)", "true"),
    ("xgboost", "minInstancesPerNode", "int", "IF(overfit, 10, 3)", "30", "true"),
    ("xgboost", "subsamplingRate", "uniform", "0.5", "1.0", "true"),
    ("random_forest", "numTrees", "int", "200", "800", "true"),
    ("random_forest", "maxDepth", "int", "3", "IF(underfit, 20, 8)", "true"),
    ("random_forest", "minInstancesPerNode", "int", "IF(overfit, 5, 2)", "15", "true"),
    ("linear", "regParam", "log", "0.01", "10.0", "regression"),
    ("linear", "elasticNetParam", "uniform", "0.1", "0.9", "regression"),
    ("linear", "regParam", "log", "0.1", "1000.0", "NOT regression"),
    ("time_folds", "maxIter", "int", "100", "500", "true"),
    ("time_folds", "stepSize", "log", "0.01", "0.15", "true"),
    ("time_folds", "maxDepth", "int", "2", "6", "true"),
    ("large_data", "maxIter", "int", "100", "500", "true"),
    ("large_data", "stepSize", "log", "0.01", "0.15", "true"),
    ("large_data", "maxDepth", "int", "2", "6", "true"),
]
_RANGE = "struct<param:string,kind:string,low:double,high:double>"


# ---------------------------------------------------------------- V3

def choose_grid(runs: DataFrame, id_col: str = "run_id") -> DataFrame:
    """V3: a table of runs or profiles (the columns of ``extract_fields``; absent ones count as not reported) ->
    (run_id, priority, model, family, weighted, folds, param, kind, low, high), one row per range.

    Boosting comes first, forests where a run overfits or underfits, a linear model below 1,000 rows or where it
    underfits, boosting over time folds with dates, a stack where the run is healthy. ``weighted`` asks for class weights.
    The stack has no ranges: its row has nulls. A map over the runs, without a shuffle.
    """
    x = run_state(runs, id_col)
    x = x.withColumns({"overfit": F.coalesce("overfit", F.lit(False)), "model_now": F.lower(F.coalesce("model", F.lit(""))),
                       "n_samples": F.coalesce("n_samples", F.lit(0)).cast("double"),
                       "has_datetime": F.coalesce("has_datetime", F.lit(False))})
    x = x.withColumn("healthy", F.expr("coalesce(test_score, 0) >= 0.65 AND NOT overfit AND NOT underfit"))
    chosen = []
    for model, family, condition in RECOMMENDED:
        ranges = [F.when(F.expr(when), F.struct(F.lit(p).alias("param"), F.lit(kind).alias("kind"), F.expr(low).cast("double").alias("low"),
                                                F.expr(high).cast("double").alias("high"))) for m, p, kind, low, high, when in RANGES if m == model]
        kept = F.filter(F.array(*ranges), lambda r: r.isNotNull()) if ranges else F.array().cast(f"array<{_RANGE}>")
        chosen.append(F.when(F.expr(condition), F.struct(F.lit(model).alias("model"), F.expr(family).alias("family"),
                                                         kept.cast(f"array<{_RANGE}>").alias("ranges"))))
    weighted = F.expr("NOT regression AND coalesce(class_imbalance, false)")
    rec = x.select("run_id", weighted.alias("weighted"), F.posexplode(F.filter(F.array(*chosen), lambda c: c.isNotNull())).alias("pos", "c"))
    return rec.select("run_id", (F.col("pos") + 1).cast("long").alias("priority"), "c.model", "c.family", "weighted",
                      F.when(F.col("c.model") == "time_folds", "time").otherwise("hash").alias("folds"), F.explode_outer("c.ranges").alias("r")) \
        .select("run_id", "priority", "model", "family", "weighted", "folds", "r.param", "r.kind", "r.low", "r.high")


# ---------------------------------------------------------------- M10

def draw_trials(grid: DataFrame, trials: int = TRIALS, seed: int = 42) -> DataFrame:
    """Every range of ``choose_grid`` -> its value in each trial (columns of ``grid``, ``trial``, ``value``).

    The draw is the md5 of (seed, model, param, trial) as a fraction of 2^32, so trials repeat on any engine and order.
    ``uniform`` and ``log`` lie between the ends, ``int`` includes both.
    """
    x = grid.where(F.col("param").isNotNull()).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    key = F.concat_ws("|", F.lit(str(seed)), "model", "param", F.col("trial").cast("string"))
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)
    low, high = F.col("low"), F.col("high")
    value = (F.when(F.col("kind") == "int", F.least(high, F.floor(low + u * (high - low + 1)).cast("double")))
             .when(F.col("kind") == "log", F.exp(F.ln(low) + u * (F.ln(high) - F.ln(low))))
             .otherwise(low + u * (high - low)))
    return x.withColumn("value", value)


def trial_params(draws: DataFrame) -> DataFrame:
    """(model, family, trial, params): the values of one run's trials as maps (a handful of parameters each)."""
    return draws.groupBy("model", "family", "trial").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("param", "value")))).alias("params"))


def _judge(task: str, label: str = "label"):
    if task == "regression":
        return RegressionEvaluator(labelCol=label, metricName="r2")
    return MulticlassClassificationEvaluator(labelCol=label, metricName="f1")


def tune(train: DataFrame, stages: list, grid: DataFrame, task: str, keys: Sequence[str], trials: int = TRIALS, seed: int = 42,
         parallelism: int = 4, startup: int = STARTUP, fractions: Sequence[float] = FRACTIONS, weight: str | None = None) -> DataFrame:
    """The trials of one run's ``grid`` (rows of ``choose_grid``), each a row (model, family, trial, params, state,
    step, scores, score, error).

    ``train`` has ``label``; an inner 80/20 split (stratified for classes) judges by R2 or weighted F1. Rows are prepared
    once. A trial is fitted on growing hash parts of the fitting rows; below the median of the earlier trials at the same
    step, once ``startup`` of them are there, it is pruned. Trials run in waves of ``parallelism``: a wave is judged by
    the waves before it, so results do not depend on which trial ends first. A failed trial is an ``error`` row.
    ``weight`` names a weight column for families that take one. Only the trials' parameters and scores reach the driver.
    """
    spark = train.sparkSession
    if "run_id" in grid.columns and grid.select("run_id").distinct().count() > 1:
        raise ValueError("the grid holds several runs: choose one")
    plan = trial_params(draw_trials(grid, trials, seed)).orderBy("model", "trial").collect()
    split = M.train_test_split(train, keys, INNER_FRAC, "label" if task != "regression" else None, seed)
    prepared = Pipeline(stages=stages).fit(split.where(~F.col("is_test"))).transform(split)
    part = M.key_hash(keys, seed + 1) % 1000
    ready = prepared.select("features", "label", *([weight] if weight else []), "is_test", part.alias("_part")).persist()
    n_classes = ready.select("label").distinct().count() if task != "regression" else 0
    held = ready.where("is_test")

    def attempt(row, seen: list[list[float]]):
        scores: list[float] = []
        try:
            for step, share in enumerate(fractions):
                rows = ready.where(~F.col("is_test") & (F.col("_part") < round(share * 1000)))
                est = M.estimator(row["family"], task, weight=weight, n_classes=n_classes, **row["params"])
                scores.append(float(_judge(task).evaluate(est.fit(rows).transform(held))))
                peers = [s[step] for s in seen if len(s) > step]
                if step + 1 < len(fractions) and len(peers) >= startup and scores[-1] < median(peers):
                    return scores, "pruned", None
            return scores, "complete", None
        except Exception as e:  # noqa: BLE001 - a failed trial is a result row
            return scores, "error", str(e)

    out, pool = [], ThreadPool(parallelism)
    try:
        for model in sorted({r["model"] for r in plan}):
            mine, seen = [r for r in plan if r["model"] == model], []
            for i in range(0, len(mine), parallelism):
                wave, before = mine[i:i + parallelism], list(seen)
                ended = pool.map(inheritable_thread_target(spark)(lambda r: attempt(r, before)), wave)
                for r, (scores, state, error) in zip(wave, ended):
                    if state != "error":
                        seen.append(scores)
                    out.append((r["model"], r["family"], r["trial"], r["params"], state, len(scores), scores,
                                scores[-1] if state == "complete" else None, error))
    finally:
        pool.close()
        ready.unpersist()
    return spark.createDataFrame(out, "model string, family string, trial int, params map<string,double>, state string, step int, "
                                      "scores array<double>, score double, error string")


def best_registry(trials: DataFrame) -> list[tuple[str, str, dict]]:
    """The best complete trial of each model as a registry for ``run_models`` (of equal scores the first trial)."""
    best = trials.where("state = 'complete'").groupBy("model", "family").agg(
        F.max_by("params", F.struct("score", (-F.col("trial")).alias("first"))).alias("params"))
    return [(r["model"], r["family"], dict(r["params"])) for r in best.orderBy("model").collect()]


# ---------------------------------------------------------------- M17

def stack_members(results: DataFrame, by: Sequence[str] = (), least: int = LEAST_MEMBERS) -> DataFrame:
    """The members of a stack, per group of ``by``: the best model of each family, filled to ``least`` by score.

    Adds ``member`` (1 for the first). Of equal scores the lesser name counts; failed models and those without a score do
    not. A group of fewer than ``least`` models has no stack. A member is among the first ``least`` of its family, so
    both windows see only those (the limit applies before the shuffle).
    """
    by = list(by)
    family = Window.partitionBy(*by, "family").orderBy(F.desc("score"), "model")
    x = results.where((F.col("status") == "ok") & F.col("score").isNotNull() & ~F.isnan("score"))
    x = x.withColumn("_place", F.row_number().over(family)).where(F.col("_place") <= least)
    order = Window.partitionBy(*by).orderBy(F.col("_place") > 1, F.desc("score"), "model")
    x = x.withColumns({"member": F.row_number().over(order), "_n": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    return x.where((F.col("_n") >= least) & ((F.col("_place") == 1) | (F.col("member") <= least))).drop("_place", "_n")


def _fit(train: DataFrame, family: str, params: dict, task: str, numeric, low, high, n_classes: int) -> PipelineModel:
    stages = M.build_preprocessor(numeric, low, high, scale=family in M.LINEAR_FAMILIES)
    return Pipeline(stages=stages + [M.estimator(family, task, n_classes=n_classes, **params)]).fit(train)


def _with_score(model: PipelineModel, rows: DataFrame, name: str, task: str) -> DataFrame:
    """``rows`` and what the model says of them: the prediction, or the class probabilities (raw scores where it has none)."""
    out = model.transform(rows)
    said = "prediction" if task == "regression" else "probability" if "probability" in out.columns else "rawPrediction"
    return out.select(*rows.columns, F.col(said).alias(name))


def out_of_fold(train: DataFrame, members: Sequence[tuple[str, str, dict]], task: str, numeric: Sequence[str], low: Sequence[str] = (),
                high: Sequence[str] = (), folds: int = M.N_FOLDS, n_classes: int = 0) -> DataFrame:
    """``train`` with ``p_0``, ``p_1`` ... from models that never saw the row's ``fold``; rows pass through all members'
    models of their fold, so nothing is joined."""
    parts = []
    for f in range(folds):
        rows, rest = train.where(F.col("fold") == f), train.where(F.col("fold") != f)
        for i, (_, family, params) in enumerate(members):
            rows = _with_score(_fit(rest, family, params, task, numeric, low, high, n_classes), rows, f"p_{i}", task)
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts)


def stack_models(df: DataFrame, target: str, task: str, keys: Sequence[str], numeric: Sequence[str], text: Sequence[str] = (),
                 results: DataFrame | None = None, folds: int = M.N_FOLDS) -> DataFrame:
    """The stack over the members that ``results`` (of ``run_models``, made here if not given) names: one row with the
    columns of ``run_models``, model ``StackingEnsemble``; none if there are too few models.

    A ridge or logistic model reads the members' out-of-fold predictions (class probabilities). Its cross-validation fits
    it on the other folds' out-of-fold rows; the members are not fitted once more inside each fold.
    """
    t0 = time.time()
    if results is None:
        results, _ = M.run_models(df, target, task, keys, numeric, text, folds=folds)
    chosen = stack_members(results).orderBy("member").collect()
    df = M.dealt_rows(df, target, keys, numeric, text)
    lab, low, high, _ = M.prepare_frame(df, target, task, numeric, text)
    lab = M.kfold_assign(M.train_test_split(lab, keys), keys, folds)
    train, test = lab.where(~F.col("is_test")), lab.where(F.col("is_test"))
    if not chosen:
        return M.results_frame(df.sparkSession, [], task, test)
    members = [(r["model"], r["family"], ast.literal_eval(r["params"])) for r in chosen]
    n_classes = lab.select("label").distinct().count() if task != "regression" else 0
    names = [f"p_{i}" for i in range(len(members))]
    oof = out_of_fold(train, members, task, numeric, low, high, folds, n_classes).select("label", "fold", *names).persist()
    n = oof.count()
    # the strengths alpha = 1 and C = 1 of the unscaled losses, over n rows
    strength = {"regParam": 1.0 / max(n, 1), "standardization": False, "featuresCol": "meta"}
    meta = LinearRegression(**strength) if task == "regression" else LogisticRegression(maxIter=1000, **strength)
    stack = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="meta"), meta])

    def score(pred: DataFrame):
        return M._primary(M._metric_row(pred, task), task)

    val, seen = [], []
    for f in range(folds):
        fitted = stack.fit(oof.where(F.col("fold") != f))
        val.append(score(fitted.transform(oof.where(F.col("fold") == f))))
        seen.append(score(fitted.transform(oof.where(F.col("fold") != f))))
    final = stack.fit(oof)
    scored = lab
    for name, (_, family, params) in zip(names, members):
        scored = _with_score(_fit(train, family, params, task, numeric, low, high, n_classes), scored, name, task)
    pred = final.transform(scored.select("label", "is_test", *names))
    tested = M._metric_row(pred.where("is_test"), task)
    mean, sd = M.mean_sd(val)
    row = ("StackingEnsemble", "ensemble", "ok", str([m[0] for m in members]), score(pred.where("NOT is_test")), M._primary(tested, task),
           mean, sd, M.mean_sd(seen)[0], tested.get("rmse"), round(time.time() - t0, 3), None)
    oof.unpersist()
    return M.results_frame(df.sparkSession, [row], task, test)
