"""Registered queries of V3, M10 and M17. Ranges, drawn parameters, members and out-of-fold rows have DuckDB oracles; the
scores of fitted models are held by tests. The oracle of the ranges states each model's ranges by cases of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import safe_round as R
from ..operators import ml as M
from ..operators import tuning as TU
from ..operators.reports import extract_fields
from .catalog import register
from .q_ml import CUST_NUM, _cust, _h_sql
from .q_reports import FIELDS_SQL, RUNS_SQL, _reports
from .sqlgen import r6
from .tables import t


def _grid_sql() -> str:
    """One SELECT per model: when it is recommended, its place, and its ranges as a list."""
    big = "('maxIter', 'int', 100, 500), ('stepSize', 'log', 0.01, 0.15), ('maxDepth', 'int', 2, 6)"
    models = [
        (1, "lightgbm", "boosted_trees", "NOT (md LIKE '%lgbm%' OR md LIKE '%lightgbm%') OR (md LIKE '%catboost%' AND overfits)",
         "('maxIter', 'int', 100, 800), ('stepSize', 'log', 0.01, 0.15), ('maxDepth', 'int', 2, CASE WHEN overfits THEN 5 ELSE 6 END), "
         "('minInstancesPerNode', 'int', CASE WHEN overfits THEN 30 ELSE 10 END, 100), ('subsamplingRate', 'uniform', 0.5, 1)"),
        (2, "catboost", "boosted_trees", "true", "('maxIter', 'int', 200, 1000), ('stepSize', 'log', 0.01, 0.15), "
         "('maxDepth', 'int', 3, CASE WHEN overfits THEN 4 ELSE 8 END), ('minInstancesPerNode', 'int', 5, 50)"),
        (3, "xgboost", "boosted_trees", "true", "('maxIter', 'int', 100, 800), ('stepSize', 'log', 0.01, 0.15), "
         "('maxDepth', 'int', 2, CASE WHEN overfits THEN 4 ELSE 8 END), ('minInstancesPerNode', 'int', CASE WHEN overfits THEN 10 ELSE 3 END, 30), "
         "('subsamplingRate', 'uniform', 0.5, 1)"),
        (4, "random_forest", "random_forest", "overfits OR under", "('numTrees', 'int', 200, 800), ('maxDepth', 'int', 3, CASE WHEN under THEN 20 ELSE 8 END), "
         "('minInstancesPerNode', 'int', CASE WHEN overfits THEN 5 ELSE 2 END, 15)"),
        (5, "linear", "linear", "reg AND (n < 1000 OR under)", "('regParam', 'log', 0.01, 10), ('elasticNetParam', 'uniform', 0.1, 0.9)"),
        (5, "linear", "logistic", "NOT reg AND (n < 1000 OR under)", "('regParam', 'log', 0.1, 1000)"),
        (6, "time_folds", "boosted_trees", "coalesce(has_datetime, false)", big),
        (7, "stacking", "ensemble", "coalesce(te, 0) >= 0.65 AND NOT overfits AND NOT under", "(NULL, NULL, NULL, NULL)"),
        (8, "large_data", "boosted_trees", "n > 100000", big)]
    parts = [f"SELECT doc_id, {place} AS place, '{m}' AS model, '{fam}' AS family, weighted, '{'time' if m == 'time_folds' else 'hash'}' AS folds, "
             f"v.param, v.kind, CAST(v.low AS DOUBLE) AS low, CAST(v.high AS DOUBLE) AS high "
             f"FROM st, LATERAL (VALUES {ranges}) v(param, kind, low, high) WHERE {when}" for place, m, fam, when, ranges in models]
    return f"""WITH {FIELDS_SQL}, {RUNS_SQL},
 st AS (SELECT *, coalesce(gap > 0.12, false) AS overfits, coalesce(n_samples, 0) AS n, NOT reg AND coalesce(class_imbalance, false) AS weighted FROM bad),
 al AS ({' UNION ALL '.join(parts)}),
 g AS (SELECT doc_id AS run_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY place) AS priority, model, family, weighted, folds, param, kind, low, high FROM al)"""


def _grid(spark, sf):
    return TU.choose_grid(extract_fields(_reports(spark, sf)), "doc_id")


register("choose_grid", f"{_grid_sql()} SELECT * FROM g")(_grid)


def _draws(spark, sf):
    ranges = _grid(spark, sf).select("model", "param", "kind", "low", "high").distinct()
    return TU.draw_trials(ranges).select("model", "param", "kind", "low", "high", "trial", R("value").alias("value"))


def _draw_sql(source: str) -> str:
    """Twin of the generator over rows (model, param, kind, low, high)."""
    return f"""SELECT model, param, kind, low, high, CAST(trial AS INTEGER) AS trial,
 {r6('''CASE kind WHEN 'int' THEN least(high, floor(low + u * (high - low + 1))) WHEN 'log' THEN exp(ln(low) + u * (ln(high) - ln(low)))
   ELSE low + u * (high - low) END''')} AS value
FROM (SELECT *, ('0x' || substr(md5(concat_ws('|', '42', model, param, CAST(trial AS VARCHAR))), 1, 8))::BIGINT / 4294967296.0 AS u
  FROM (SELECT * FROM ({source}) s, range(50) tr(trial)))"""


register("draw_trials", f"{_grid_sql()} {_draw_sql('SELECT DISTINCT model, param, kind, low, high FROM g WHERE param IS NOT NULL')}")(_draws)


def _tuned(spark, sf):
    """The linear model's trials on ``customer``, with the ranges that its baseline run asks for."""
    df = _cust(spark, sf)
    lab, low, high, _ = M.prepare_frame(df, "c_acctbal", "regression", CUST_NUM, ["c_mktsegment"])
    base = df.agg(F.count(F.lit(1)).alias("n_samples"), F.regr_r2("c_acctbal", "c_nationkey").alias("train_r2")).select(
        F.lit("customer").alias("run_id"), F.lit("regression").alias("task"), "n_samples", "train_r2", F.col("train_r2").alias("test_r2"))
    grid = TU.choose_grid(base).where("model = 'linear'")
    return TU.tune(lab, M.build_preprocessor(CUST_NUM, low, high, True), grid, "regression", ["c_custkey"], parallelism=8)


register("tune")(lambda spark, sf: _tuned(spark, sf).select("model", "trial", "state", "step", R("score").alias("score")))

register("tune_params", f"""WITH d AS ({_draw_sql('''SELECT 'linear' AS model, 'regParam' AS param, 'log' AS kind, 0.01::DOUBLE AS low, 10::DOUBLE AS high FROM customer
    UNION SELECT 'linear', 'elasticNetParam', 'uniform', 0.1::DOUBLE, 0.9::DOUBLE FROM customer''')})
SELECT trial, max(CASE WHEN param = 'regParam' THEN value END) AS reg_param, max(CASE WHEN param = 'elasticNetParam' THEN value END) AS elastic_net
FROM d GROUP BY trial""")(
    lambda spark, sf: _tuned(spark, sf).select("trial", R(F.col("params")["regParam"]).alias("reg_param"), R(F.col("params")["elasticNetParam"]).alias("elastic_net")))


def _results(spark, sf):
    """Results tables made by rule from ``orders``: a customer's orders are models, the status their family."""
    return t(spark, sf, "orders").select(
        F.col("o_custkey").alias("dataset"), F.col("o_orderkey").cast("string").alias("model"), F.col("o_orderstatus").alias("family"),
        F.when(F.col("o_orderkey") % 7 == 0, "error").otherwise("ok").alias("status"),
        F.when(F.col("o_orderkey") % 5 != 0, F.round(F.col("o_totalprice") / 50000)).alias("score"))


register("stack_members", """WITH r AS (SELECT o_custkey AS dataset, CAST(o_orderkey AS VARCHAR) AS model, o_orderstatus AS family, round(o_totalprice / 50000) AS score
  FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0),
 b AS (SELECT *, NOT EXISTS (SELECT 1 FROM r o WHERE o.dataset = r.dataset AND o.family = r.family
    AND (o.score > r.score OR (o.score = r.score AND o.model < r.model))) AS best, count(*) OVER (PARTITION BY dataset) AS n FROM r),
 p AS (SELECT *, sum(CAST(best AS INTEGER)) OVER (PARTITION BY dataset) AS n_best, row_number() OVER (PARTITION BY dataset, best ORDER BY score DESC, model) AS place FROM b WHERE n >= 3)
SELECT dataset, model, family, score, CAST(CASE WHEN best THEN place ELSE n_best + place END AS INTEGER) AS member FROM p WHERE best OR n_best + place <= 3""")(
    lambda spark, sf: TU.stack_members(_results(spark, sf), ["dataset"]).select("dataset", "model", "family", "score", "member"))

MEMBERS = [("ridge", "ridge", {"regParam": 0.1}), ("random_forest", "random_forest", {"numTrees": 10})]


def _oof(spark, sf):
    lab, low, high, _ = M.prepare_frame(_cust(spark, sf), "c_acctbal", "regression", CUST_NUM, ["c_mktsegment"])
    lab = M.kfold_assign(M.train_test_split(lab, ["c_custkey"]), ["c_custkey"], 3)
    out = TU.out_of_fold(lab.where(~F.col("is_test")), MEMBERS, "regression", CUST_NUM, low, high, 3)
    return out.select("c_custkey", "fold", "label", (F.col("p_0").isNotNull() & F.col("p_1").isNotNull()).alias("scored"))


register("stack_oof", f"""SELECT c_custkey, CAST({_h_sql(['c_custkey'])} % 3 AS INTEGER) AS fold, CAST(c_acctbal AS DOUBLE) AS label, true AS scored
FROM customer WHERE {_h_sql(['c_custkey'])} % 1000 >= 200""")(_oof)

REGISTRY = [("linear", "linear", {}), ("ridge", "ridge", {"regParam": 0.1}), ("random_forest", "random_forest", {"numTrees": 20})]


def _stack(spark, sf):
    df = _cust(spark, sf)
    res, _ = M.run_models(df, "c_acctbal", "regression", ["c_custkey"], CUST_NUM, ["c_mktsegment"], REGISTRY, folds=3)
    return TU.stack_models(df, "c_acctbal", "regression", ["c_custkey"], CUST_NUM, ["c_mktsegment"], res, folds=3)


register("stack_models")(_stack)
