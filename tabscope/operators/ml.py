"""Splits, preprocessing, model families, evaluation and scoring on ``pyspark.ml``.

Splits and folds hash a row key with md5 (reproducible, order-free, identical in
DuckDB). Model fitting is distributed by ``pyspark.ml``; the driver only loops over
a handful of candidate models and folds.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_round as R
from ..functions.scalar import stable_bucket
from .common import spread

# Split, fold and scoring constants.
TEST_FRAC = 0.2
N_FOLDS = 5
LOW_CARD_MAX = 15
CV_STD_PENALTY = 0.5
GAP_ALLOWANCE = 0.10
UNDERFIT_PENALTY = 0.10
PERFECT_FIT = 0.9999
HIGH_REL_ERROR = 0.5
DROP_IMPORTANCE = 0.005
LINEAR_FAMILIES = ("linear", "ridge", "lasso", "logistic")
#: Rows in a task of a fit, about: a forest holds one weight per tree with each row.
TASK_ROWS = 25_000


def key_hash(keys: Sequence[str], seed: int = 42) -> Column:
    """32-bit md5 prefix of the row key (+ seed) as a long."""
    k = F.concat_ws("|", *[F.col(c).cast("string") for c in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(k), 1, 8), 16, 10).cast("long")


# ---------------------------------------------------------------- M1-M3

def train_test_split(df: DataFrame, keys: Sequence[str], test_frac: float = TEST_FRAC, stratify: str | None = None,
                     seed: int = 42) -> DataFrame:
    """M1: adds ``is_test``. Plain: hash bucket. Stratified: the first round(frac * n_c) rows of each class
    in hash order (a per-class position from the skew-safe prefix scan)."""
    from .window import join_on, row_index
    h = key_hash(keys, seed)
    if stratify is None:
        return df.withColumn("is_test", (h % 1000) < int(round(test_frac * 1000)))
    x = df.withColumn("_h", h)
    n = x.groupBy(stratify).agg(F.count(F.lit(1)).alias("_nc"))
    x = row_index(x, ["_h", *keys], [stratify], "_pos", skew_safe=True)
    x = join_on(x, n, [stratify])  # one row per class
    return x.withColumn("is_test", F.col("_pos") < F.round(F.col("_nc") * test_frac)).drop("_h", "_pos", "_nc")


def kfold_assign(df: DataFrame, keys: Sequence[str], k: int = N_FOLDS, stratify: str | None = None,
                 seed: int = 42) -> DataFrame:
    """M2: ``fold`` in 0..k-1: hash mod k, or position-in-class mod k when stratified."""
    from .window import row_index
    h = key_hash(keys, seed)
    if stratify is None:
        return df.withColumn("fold", F.pmod(h, F.lit(k)).cast("int"))
    x = row_index(df.withColumn("_h", h), ["_h", *keys], [stratify], "_pos", skew_safe=True)
    return x.withColumn("fold", F.pmod(F.col("_pos"), F.lit(k)).cast("int")).drop("_h", "_pos")


def time_series_folds(df: DataFrame, ts: str, k: int = N_FOLDS) -> DataFrame:
    """M3: ``segment`` = number of time cut points (quantiles i/(k+1)) before the row; fold f trains on
    segments < f and validates on segment f (expanding window)."""
    from .quantiles import quantile_scalars
    t = F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
    cuts = quantile_scalars(df, [t], [i / (k + 1) for i in range(1, k + 1)])["c0"]
    seg = sum((F.coalesce((F.get(cuts, i) < t).cast("int"), F.lit(0)) for i in range(k)), F.lit(0))
    return df.withColumn("segment", seg)


# ---------------------------------------------------------------- M4-M9

def build_preprocessor(numeric: Sequence[str], low_card: Sequence[str] = (), high_card: Sequence[str] = (),
                       scale: bool = False) -> list:
    """M4: median imputation (+ scaling for linear models), one-hot for low-cardinality text,
    ordinal codes (sorted levels) for high-cardinality text; unseen / null levels get their own slot."""
    stages = []
    num_out = [f"{c}__imp" for c in numeric]
    if numeric:
        stages.append(Imputer(inputCols=list(numeric), outputCols=num_out, strategy="median"))
    lo_idx = [f"{c}__idx" for c in low_card]
    hi_idx = [f"{c}__ord" for c in high_card]
    for c, o in zip(list(low_card) + list(high_card), lo_idx + hi_idx):
        stages.append(StringIndexer(inputCol=c, outputCol=o, handleInvalid="keep", stringOrderType="alphabetAsc"))
    lo_vec = [f"{c}__oh" for c in low_card]
    if low_card:
        stages.append(OneHotEncoder(inputCols=lo_idx, outputCols=lo_vec, handleInvalid="keep", dropLast=False))
    stages.append(VectorAssembler(inputCols=num_out + lo_vec + hi_idx, outputCol="features_raw", handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True))
    else:
        from pyspark.ml.feature import SQLTransformer
        stages.append(SQLTransformer(statement="SELECT *, features_raw AS features FROM __THIS__"))
    return stages


def estimator(family: str, task: str, label: str = "label", weight: str | None = None, n_classes: int = 2, **params):
    """M5-M8: one estimator per family name."""
    kw = {"featuresCol": "features", "labelCol": label}
    if family in ("linear", "ridge", "lasso"):
        if task == "regression":
            en = params.pop("elasticNetParam", {"linear": 0.0, "ridge": 0.0, "lasso": 1.0}[family])
            reg = params.pop("regParam", 0.0 if family == "linear" else 0.1)
            lin = LinearRegression(regParam=reg, elasticNetParam=en, **kw, **params)
            return lin.setWeightCol(weight) if weight else lin
        lr = LogisticRegression(family="multinomial", **kw, **params)
        return lr.setWeightCol(weight) if weight else lr
    if family == "logistic":
        lr = LogisticRegression(family="multinomial", **kw, **params)
        return lr.setWeightCol(weight) if weight else lr
    if family == "random_forest":
        est = (RandomForestRegressor if task == "regression" else RandomForestClassifier)(seed=42, **kw, **params)
        return est.setWeightCol(weight) if weight else est
    if family == "boosted_trees":
        est = (GBTRegressor if task == "regression" else GBTClassifier)(seed=42, **kw, **params)
        if weight:
            est = est.setWeightCol(weight)
        if task == "regression" or n_classes <= 2:
            return est
        many = OneVsRest(classifier=est, featuresCol="features", labelCol=label)
        return many.setWeightCol(weight) if weight else many
    raise ValueError(family)


def class_weights(df: DataFrame, target: str, out: str = "class_weight") -> DataFrame:
    """M9: balanced weights n / (k * n_c) attached to every row (class table: one row per class)."""
    c = df.groupBy(target).agg(F.count(F.lit(1)).alias("_nc"))
    tot = c.agg(F.sum("_nc").alias("n"), F.count(F.lit(1)).alias("k"))
    st = tot.select(F.struct("n", "k").alias("s")).scalar()
    w = c.select(target, (st["n"] / (st["k"] * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), target, "left")


# ---------------------------------------------------------------- M12-M15

def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rmse, mae, r2, mape (rows with label != 0), rmsle (non-negative rows)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    a = pred.agg(F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"),
                 F.sum((y - p) * (y - p)).alias("_sse"), F.var_pop(y).alias("_vy"), F.count(y).alias("_n"),
                 F.avg(F.when(y != 0, F.abs((y - p) / y))).alias("mape"),
                 F.sqrt(F.avg(F.when((y >= 0) & (p >= 0), (F.log1p(p) - F.log1p(y)) ** 2))).alias("rmsle"))
    r2 = 1 - F.col("_sse") / (F.col("_vy") * F.col("_n"))
    return a.select(R("rmse").alias("rmse"), R("mae").alias("mae"), R(r2).alias("r2"), R("mape").alias("mape"),
                    R("rmsle").alias("rmsle"))


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           score: str | None = None, positive=1) -> DataFrame:
    """Accuracy, weighted precision / recall / F1 from the confusion table; binary AUC by average rank."""
    y, p = F.col(label).cast("string"), F.col(prediction).cast("string")
    conf = pred.groupBy(y.alias("y"), p.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    per = conf.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"),
                                                    F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    pp = conf.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("pred_n"))
    j = per.join(pp, "c", "left").fillna(0, ["pred_n"])
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(0.0)
    rec = F.col("tp") / F.col("support")
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    m = j.agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
              (F.sum(prec * F.col("support")) / F.sum("support")).alias("precision"),
              (F.sum(rec * F.col("support")) / F.sum("support")).alias("recall"),
              (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1"))
    out = m.select(*[R(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])
    if score:
        from .window import rank_table
        pos = (F.col(label).cast("string") == F.lit(str(positive)))
        s = pred.select(F.col(score).cast("double").alias("s"), pos.alias("pos"))
        # ranks meet the classes' counts per distinct score, not the rows
        at = s.where(F.col("s").isNotNull()).groupBy("s").agg(F.count_if(F.col("pos")).alias("n1"), F.count_if(~F.col("pos")).alias("n0"))
        r = at.join(rank_table(s, "s").select(F.col("value").alias("s"), "avg_rank"), "s")
        st = r.agg(F.sum(F.col("n1") * F.col("avg_rank")).alias("rp"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        auc = (F.col("rp") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))
        out = out.withColumn("auc", R(st.select(auc.alias("a")).scalar()))
    return out


def composite_score(cv_mean: Column, cv_std: Column, train_score: Column, test_score: Column, task: str) -> dict:
    """cv_mean - .5 cv_sd - max(0, gap - .10) - .10 if underfit; returns gap, underfit, score columns."""
    lim = 0.6 if task == "regression" else 0.7
    under = (train_score < lim) & (test_score < lim)
    gap = F.coalesce(train_score - test_score, F.lit(0.0))
    pen = F.greatest(F.lit(0.0), gap - GAP_ALLOWANCE) + F.when(under, UNDERFIT_PENALTY).otherwise(0.0)
    score = F.coalesce(cv_mean, F.lit(0.0)) - CV_STD_PENALTY * F.coalesce(cv_std, F.lit(0.0)) - pen
    return {"gap": gap, "underfit": under, "score": score}


def sanity_check(train_score: Column, test_rmse: Column | None = None, mean_abs_y: Column | None = None) -> Column:
    """M15: 'perfect_fit' when train score > .9999, 'high_error' when rmse / mean|y| > .5, else 'ok'."""
    out = F.when(train_score > PERFECT_FIT, "perfect_fit")
    if test_rmse is not None and mean_abs_y is not None:
        out = out.when((mean_abs_y > 0) & (test_rmse / mean_abs_y > HIGH_REL_ERROR), "high_error")
    return out.otherwise("ok")


# ---------------------------------------------------------------- M10, M11, M16-M22

def _metric_row(pred: DataFrame, task: str) -> dict:
    if task == "regression":
        return regression_metrics(pred).first().asDict()
    return classification_metrics(pred).first().asDict()


def _primary(m: dict, task: str):
    return m.get("r2") if task == "regression" else m.get("f1")


def prepare_frame(df: DataFrame, target: str, task: str, numeric: Sequence[str], text: Sequence[str],
                  low_card_max: int = LOW_CARD_MAX):
    """Label column and the low / high cardinality split (T7) for the preprocessor."""
    from .profile import distinct_counts
    card = {r["column"]: r["n_unique"] for r in distinct_counts(df, text).collect()} if text else {}
    low = [c for c in text if card.get(c, 0) <= low_card_max]
    high = [c for c in text if c not in low]
    if task == "regression":
        lab = df.withColumn("label", F.col(target).cast("double"))
        return lab, low, high, None
    idx = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(df)
    return idx.transform(df), low, high, idx


def dealt_rows(df: DataFrame, target: str, keys: Sequence[str], numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """The columns that a fit reads, dealt by key to tasks of TASK_ROWS and stored once for its many passes."""
    from ..session import cut_lineage
    return cut_lineage(spread(df.select(*dict.fromkeys([*keys, *numeric, *text, target])), keys, TASK_ROWS))


def mean_sd(scores: Sequence[float | None]) -> tuple[float | None, float | None]:
    """Mean and population sd of the scores that are there."""
    v = [x for x in scores if x is not None]
    if not v:
        return None, None
    mean = sum(v) / len(v)
    return mean, math.sqrt(sum((x - mean) ** 2 for x in v) / len(v))


def cross_validate(df: DataFrame, stages: list, est, task: str, fold_col: str = "fold", k: int = N_FOLDS) -> dict:
    """Mean and population sd of the validation scores over the folds, and the train mean."""
    val, tr = [], []
    for f in range(k):
        train = df.where(F.col(fold_col) != f)
        test = df.where(F.col(fold_col) == f)
        model = Pipeline(stages=stages + [est]).fit(train)
        val.append(_primary(_metric_row(model.transform(test), task), task))
        tr.append(_primary(_metric_row(model.transform(train), task), task))
    mean, sd = mean_sd(val)
    return {"cv_mean": mean, "cv_std": sd, "cv_train_mean": mean_sd(tr)[0]}


def results_frame(spark, rows: list, task: str, test: DataFrame) -> DataFrame:
    """The results table of fitted models (one tuple each): the scores, their gap, composite score and sanity."""
    res = spark.createDataFrame(rows, "model string, family string, status string, params string, train_score double, "
                                      "test_score double, cv_mean double, cv_std double, cv_train_mean double, "
                                      "test_rmse double, elapsed_sec double, error string")
    cs = composite_score(F.col("cv_mean"), F.col("cv_std"), F.col("train_score"), F.col("test_score"), task)
    mean_abs = test.agg(F.avg(F.abs(F.col("label")))).scalar() if task == "regression" else None
    return res.withColumns({"gap": R(cs["gap"]), "underfit": cs["underfit"], "score": R(cs["score"]),
                           "sanity": sanity_check(F.col("train_score"), F.col("test_rmse") if task == "regression" else None,
                                                  mean_abs)})


def run_models(df: DataFrame, target: str, task: str, keys: Sequence[str], numeric: Sequence[str],
               text: Sequence[str] = (), registry: Sequence[tuple[str, str, dict]] | None = None,
               folds: int = N_FOLDS) -> tuple[DataFrame, dict]:
    """Fit every registry entry (name, family, params): hold-out metrics, CV, gap, composite score,
    seconds; a failure becomes an error row. Returns (results, fitted models)."""
    spark = df.sparkSession
    registry = registry or [("linear", "linear", {}), ("random_forest", "random_forest", {"numTrees": 50}),
                            ("boosted_trees", "boosted_trees", {"maxIter": 20})]
    df = dealt_rows(df, target, keys, numeric, text)
    lab, low, high, _ = prepare_frame(df, target, task, numeric, text)
    lab = kfold_assign(train_test_split(lab, keys), keys, folds)
    train, test = lab.where(~F.col("is_test")), lab.where(F.col("is_test"))
    n_classes = lab.select("label").distinct().count() if task != "regression" else 0
    rows, models = [], {}
    for name, family, params in registry:
        t0 = time.time()
        try:
            stages = build_preprocessor(numeric, low, high, scale=family in LINEAR_FAMILIES)
            est = estimator(family, task, n_classes=n_classes, **dict(params))
            model = Pipeline(stages=stages + [est]).fit(train)
            trm, tem = _metric_row(model.transform(train), task), _metric_row(model.transform(test), task)
            cv = cross_validate(train, stages, estimator(family, task, n_classes=n_classes, **dict(params)), task, "fold", folds)
            models[name] = model
            rows.append((name, family, "ok", str(params), _primary(trm, task), _primary(tem, task), cv["cv_mean"],
                         cv["cv_std"], cv["cv_train_mean"], tem.get("rmse"), round(time.time() - t0, 3), None))
        except Exception as e:  # noqa: BLE001 - a failed model is a result row
            rows.append((name, family, "error", str(params), None, None, None, None, None, None,
                         round(time.time() - t0, 3), str(e)))
    return results_frame(spark, rows, task, test), models


def leaderboard(results: DataFrame, k: int = 10) -> DataFrame:
    """K5: models by composite score, first k."""
    return results.where(F.col("status") == "ok").orderBy(F.desc("score"), "model").limit(k)


def permutation_importance(model: PipelineModel, test: DataFrame, features: Sequence[str], keys: Sequence[str],
                           task: str, seed: int = 7) -> DataFrame:
    """Score drop when one feature's values are permuted (value of row at hash rank r moved to rank
    r + shift, by a join on the global rank); features below .005 are marked for dropping."""
    from .window import global_row_index
    base = _primary(_metric_row(model.transform(test), task), task)
    ranked = global_row_index(test.withColumn("_h", key_hash(keys, seed)), ["_h", *keys], "_r")
    n = ranked.count()
    shift = max(1, n // 2)
    rows = []
    for c in features:
        donor = ranked.select((F.pmod(F.col("_r") + shift, F.lit(n))).alias("_r"), F.col(c).alias("_v"))
        perm = ranked.join(donor, "_r").withColumn(c, F.col("_v")).drop("_v", "_r", "_h")
        s = _primary(_metric_row(model.transform(perm), task), task)
        rows.append((c, None if s is None or base is None else float(base - s)))
    out = test.sparkSession.createDataFrame(rows, "feature string, importance double")
    return out.withColumn("importance", R("importance")).withColumn("drop", F.col("importance") < DROP_IMPORTANCE)


def linear_attribution(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean |w * (x - mean(x))| per feature (linear-model attribution)."""
    aggs = []
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in weights]).select(
        F.struct(*weights.keys()).alias("m")).scalar()
    for c, w in weights.items():
        aggs.append(F.avg(F.abs(F.lit(float(w)) * (F.col(c).cast("double") - means[c]))).alias(c))
    return df.agg(*aggs).unpivot([], list(weights), "feature", "attribution").withColumn("attribution", R("attribution"))


def batch_score(model: PipelineModel, df: DataFrame, required: Sequence[str], id_col: str) -> DataFrame:
    """Fail on missing required features, ignore extra ones; prediction and top class probability."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    out = model.transform(df.select(id_col, *[c for c in required if c != id_col]))
    cols = [id_col, "prediction"]
    if "probability" in out.columns:
        from pyspark.ml.functions import vector_to_array
        out = out.withColumn("confidence", F.array_max(vector_to_array("probability")))
        cols.append("confidence")
    return out.select(*cols)


def score_json_stream(model: PipelineModel, stream: DataFrame, schema: str, value_col: str = "value",
                      id_col: str = "id") -> DataFrame:
    """JSON records on a stream -> ``from_json`` with the saved feature schema -> ``transform``."""
    rec = stream.select(F.from_json(F.col(value_col).cast("string"), schema).alias("r")).select("r.*")
    return model.transform(rec).select(id_col, "prediction")


def baseline_train(df: DataFrame, target: str, keys: Sequence[str], numeric: Sequence[str], text: Sequence[str] = (),
                   trees: int = 200) -> DataFrame:
    """log1p of skewed numerics, median / one-hot preprocessing, a 200-tree forest, hold-out metrics."""
    from .features import log1p_skewed
    from .schema import infer_task_type
    df = dealt_rows(df, target, keys, numeric, text)
    task = infer_task_type(df, target).first()["task_type"]
    x, _ = log1p_skewed(df, list(numeric))
    lab, low, high, _ = prepare_frame(x, target, task, numeric, text)
    lab = train_test_split(lab, keys, stratify="label" if task != "regression" else None)
    stages = build_preprocessor(numeric, list(low) + list(high), ())
    est = estimator("random_forest", task, numTrees=trees)
    m = Pipeline(stages=stages + [est]).fit(lab.where(~F.col("is_test")))
    pred = m.transform(lab.where(F.col("is_test")))
    met = regression_metrics(pred) if task == "regression" else classification_metrics(pred)
    return met.withColumn("task", F.lit(task))


def compare_runs(raw: DataFrame, engineered: DataFrame, key: str = "task") -> DataFrame:
    """Best raw run vs best engineered run per key: scores, delta and pct change (full outer join)."""
    def best(df, tag):
        ok = df.where(F.col("status") == "ok")
        return ok.groupBy(key).agg(F.max_by("model", F.struct("score", "model")).alias(f"{tag}_model"),
                                   F.max("score").alias(f"{tag}_score"))
    j = best(raw, "raw").join(best(engineered, "eng"), key, "full_outer")
    delta = F.col("eng_score") - F.col("raw_score")
    return j.withColumn("delta", R(delta)).withColumn(
        "pct", R(F.when(F.col("raw_score") != 0, delta / F.abs(F.col("raw_score")) * 100)))
