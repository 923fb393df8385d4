"""Registered modelling queries (M1-M22). Splits, weights, metrics and the one-feature linear fit have
DuckDB oracles; fitted tree models are checked by row count (and by unit tests)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..functions.scalar import safe_round as R
from ..operators import ml as M
from .catalog import register
from .sqlgen import r6
from .tables import t

LK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _h_sql(cols, seed=42):
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"('0x' || substr(md5(concat_ws('|', {parts}, '{seed}')), 1, 8))::BIGINT"


register("train_test_split", f"SELECT {', '.join(LK)}, {_h_sql(LK)} % 1000 < 200 AS is_test FROM lineitem")(
    lambda spark, sf: M.train_test_split(t(spark, sf, "lineitem"), LK).select(*LK, "is_test"))

register("train_test_split_stratified", f"""SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY {_h_sql(['doc_id'])}, doc_id) - 1
  < round(count(*) OVER (PARTITION BY quality) * 0.2) AS is_test FROM labels""")(
    lambda spark, sf: M.train_test_split(t(spark, sf, "labels"), ["doc_id"], stratify="quality").select("doc_id", "is_test"))

register("kfold_assign", f"SELECT {', '.join(LK)}, CAST({_h_sql(LK)} % 5 AS INTEGER) AS fold FROM lineitem")(
    lambda spark, sf: M.kfold_assign(t(spark, sf, "lineitem"), LK).select(*LK, "fold"))

register("kfold_assign_stratified", f"""SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY {_h_sql(['doc_id'])}, doc_id) - 1) % 5 AS INTEGER) AS fold
FROM labels""")(lambda spark, sf: M.kfold_assign(t(spark, sf, "labels"), ["doc_id"], stratify="quality").select("doc_id", "fold"))

register("time_series_folds", """WITH c AS (SELECT quantile_cont(epoch_us(o_orderdate)::DOUBLE, [1/6, 2/6, 3/6, 4/6, 5/6]) AS q FROM orders)
SELECT o_orderkey, CAST(len(list_filter(q, lambda x: x < epoch_us(o_orderdate)::DOUBLE)) AS INTEGER) AS segment FROM orders, c""")(
    lambda spark, sf: M.time_series_folds(t(spark, sf, "orders"), "o_orderdate").select("o_orderkey", "segment"))

register("class_weights", f"""WITH c AS (SELECT quality, count(*) AS nc FROM labels GROUP BY 1)
SELECT doc_id, {r6('(SELECT sum(nc) FROM c) / ((SELECT count(*) FROM c) * nc)')} AS class_weight FROM labels JOIN c USING (quality)""")(
    lambda spark, sf: M.class_weights(t(spark, sf, "labels"), "quality").select("doc_id", R("class_weight").alias("class_weight")))


def _ols(spark, sf):
    li = t(spark, sf, "lineitem")
    va = VectorAssembler(inputCols=["l_quantity"], outputCol="features")
    lr = LinearRegression(featuresCol="features", labelCol="l_extendedprice", regParam=0.0, solver="normal")
    return Pipeline(stages=[va, lr]).fit(li), li


def _fit_linear(spark, sf):
    m, li = _ols(spark, sf)
    lr = m.stages[-1]
    return spark.createDataFrame([(float(lr.coefficients[0]), float(lr.intercept))], "slope double, intercept double") \
        .select(R("slope").alias("slope"), R("intercept").alias("intercept"))


register("fit_linear", f"SELECT {r6('regr_slope(l_extendedprice, l_quantity)')} AS slope, "
         f"{r6('regr_intercept(l_extendedprice, l_quantity)')} AS intercept FROM lineitem")(_fit_linear)


def _reg_metrics(spark, sf):
    m, li = _ols(spark, sf)
    return M.regression_metrics(m.transform(li), "l_extendedprice", "prediction")


register("regression_metrics", f"""WITH c AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
 p AS (SELECT l_extendedprice AS y, a + b * l_quantity AS p FROM lineitem, c)
SELECT {r6('sqrt(avg((y - p) * (y - p)))')} AS rmse, {r6('avg(abs(y - p))')} AS mae,
  {r6('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y))')} AS r2, {r6('avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END)')} AS mape,
  {r6('sqrt(avg(CASE WHEN y >= 0 AND p >= 0 THEN (ln(1 + p) - ln(1 + y)) ^ 2 END))')} AS rmsle FROM p""")(_reg_metrics)


def _cls_pred(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.select(F.col("l_returnflag").alias("label"),
                     F.when(F.col("l_discount") >= 0.05, "N").otherwise("A").alias("prediction"),
                     F.col("l_discount").alias("score"))


register("classification_metrics", f"""WITH p AS (SELECT l_returnflag AS y, CASE WHEN l_discount >= 0.05 THEN 'N' ELSE 'A' END AS p, l_discount AS s FROM lineitem),
 conf AS (SELECT y, p, count(*) AS n FROM p GROUP BY ALL),
 per AS (SELECT y AS c, sum(n) AS support, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp FROM conf GROUP BY 1),
 pp AS (SELECT p AS c, sum(n) AS pred_n FROM conf GROUP BY 1),
 j AS (SELECT per.*, coalesce(pred_n, 0) AS pred_n, CASE WHEN coalesce(pred_n, 0) > 0 THEN tp / pred_n ELSE 0.0 END AS prec,
   tp / support AS rec FROM per LEFT JOIN pp USING (c)),
 m AS (SELECT sum(tp) / sum(support) AS accuracy, sum(prec * support) / sum(support) AS precision,
   sum(rec * support) / sum(support) AS recall,
   sum(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END * support) / sum(support) AS f1 FROM j),
 rk AS (SELECT y = 'R' AS pos, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM p),
 a AS (SELECT (sum(CASE WHEN pos THEN r END) - count_if(pos) * (count_if(pos) + 1) / 2.0) / (count_if(pos) * count_if(NOT pos)) AS auc FROM rk)
SELECT {r6('accuracy')} AS accuracy, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, {r6('auc')} AS auc FROM m, a""")(
    lambda spark, sf: M.classification_metrics(_cls_pred(spark, sf), score="score", positive="R"))


def _linear_attr(spark, sf):
    m, li = _ols(spark, sf)
    return M.linear_attribution(li, {"l_quantity": float(m.stages[-1].coefficients[0])})


register("linear_attribution", f"""WITH c AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, avg(l_quantity) AS mq FROM lineitem)
SELECT 'l_quantity' AS feature, {r6('avg(abs(b * (l_quantity - mq)))')} AS attribution FROM lineitem, c""")(_linear_attr)


# ---------------------------------------------------------------- fitted models (row-count checks)

def _cust(spark, sf):
    return t(spark, sf, "customer")


def _docs_labels(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return t(spark, sf, "labels").join(d, "doc_id")


CUST_NUM = ["c_nationkey", "c_custkey"]


def _fit_family(family, task, df_fn, target, numeric, text, keys, **params):
    def q(spark, sf):
        df = df_fn(spark, sf)
        lab, low, high, _ = M.prepare_frame(df, target, task, numeric, text)
        lab = M.train_test_split(lab, keys)
        n_cls = lab.select("label").distinct().count() if task != "regression" else 0
        stages = M.build_preprocessor(numeric, low, high, scale=family in ("linear", "logistic"))
        model = Pipeline(stages=stages + [M.estimator(family, task, n_classes=n_cls, **params)]).fit(lab.where(~F.col("is_test")))
        pred = model.transform(lab.where(F.col("is_test")))
        return M.regression_metrics(pred) if task == "regression" else M.classification_metrics(pred)
    return q


register("fit_logistic")(_fit_family("logistic", "classification", _docs_labels, "quality", ["n_chars"], ["lang", "source"], ["doc_id"]))
register("fit_random_forest")(_fit_family("random_forest", "regression", _cust, "c_acctbal", CUST_NUM, ["c_mktsegment"],
                                          ["c_custkey"], numTrees=50))
register("fit_boosted_trees")(_fit_family("boosted_trees", "classification", _docs_labels, "quality", ["n_chars"],
                                          ["lang", "source"], ["doc_id"], maxIter=20))
register("build_preprocessor")(lambda spark, sf: Pipeline(stages=M.build_preprocessor(CUST_NUM, ["c_mktsegment"], [], True))
                               .fit(_cust(spark, sf)).transform(_cust(spark, sf)).select("c_custkey", "features"))


def _cv(spark, sf):
    df = _cust(spark, sf)
    lab, low, high, _ = M.prepare_frame(df, "c_acctbal", "regression", CUST_NUM, ["c_mktsegment"])
    lab = M.kfold_assign(lab, ["c_custkey"], 5)
    r = M.cross_validate(lab, M.build_preprocessor(CUST_NUM, low, high, True), M.estimator("linear", "regression"), "regression")
    return spark.createDataFrame([(r["cv_mean"], r["cv_std"], r["cv_train_mean"])], "cv_mean double, cv_std double, cv_train_mean double")


register("cross_validate")(_cv)

REGISTRY = [("linear", "linear", {}), ("ridge", "ridge", {"regParam": 0.1}), ("random_forest", "random_forest", {"numTrees": 30})]


def _run(spark, sf):
    res, _ = M.run_models(_cust(spark, sf), "c_acctbal", "regression", ["c_custkey"], CUST_NUM, ["c_mktsegment"], REGISTRY, folds=3)
    return res


register("run_models")(_run)
register("leaderboard")(lambda spark, sf: M.leaderboard(_run(spark, sf)).select("model", "score"))


def _perm(spark, sf):
    df = _cust(spark, sf)
    lab, low, high, _ = M.prepare_frame(df, "c_acctbal", "regression", CUST_NUM, [])
    model = Pipeline(stages=M.build_preprocessor(CUST_NUM, [], []) + [M.estimator("random_forest", "regression", numTrees=20)]).fit(lab)
    return M.permutation_importance(model, lab, CUST_NUM, ["c_custkey"], "regression")


register("permutation_importance")(_perm)


def _batch(spark, sf):
    df = _cust(spark, sf)
    lab, low, high, _ = M.prepare_frame(df, "c_mktsegment", "classification", ["c_acctbal", "c_nationkey"], [])
    model = Pipeline(stages=M.build_preprocessor(["c_acctbal", "c_nationkey"], [], []) +
                     [M.estimator("logistic", "classification")]).fit(lab)
    return M.batch_score(model, df, ["c_acctbal", "c_nationkey"], "c_custkey")


register("batch_score")(_batch)
register("baseline_train")(lambda spark, sf: M.baseline_train(_cust(spark, sf), "c_acctbal", ["c_custkey"], CUST_NUM, ["c_mktsegment"]))
