"""Registered queries on report texts (R12, V1, V4) with DuckDB oracles.

The reports are the conversations' texts and texts made by rule from ``customer`` (one expression, valid in both
engines), in which every field and every finding occurs. The oracle's findings are written from the rules' meaning:
one independent condition per finding, not the ordered table.
"""

from __future__ import annotations

from ..operators import reports as RP
from .catalog import register
from .tables import t

_K = "c_custkey"


def _pick(n: int, *texts: str) -> str:
    """One of the texts (SQL expressions) by the key's remainder."""
    return f"CASE {_K} % {n} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(texts)) + " ELSE '' END"


_NUM = f"CAST({_K} % 50 + 50 AS STRING)"
_LOW = f"CAST({_K} % 89 + 10 AS STRING)"
_QUOTED = "chr(39)"  # a quotation mark, written alike in both engines


def _names(*names: str) -> str:
    return " || ', ' || ".join(f"{_QUOTED} || '{n}' || {_QUOTED}" for n in names)


_LINES = [
    _pick(4, "'Task type: Classification'", "'TASK: regression'"),
    _pick(11, "'Model: CatBoostRegressor'", "'Training RandomForestClassifier now'", "'Model: LGBMRegressor'", "'Model: XGBoostX'", "'Model: Ridge'",
          "''", "'Model - LightGBM'", "'Model: XGBoost'", "'Model: CatBoost'", "'Model: LinearRegression'"),
    _pick(3, f"'Total samples: 1,' || {_NUM} || '0'", "'Samples - 77'", "'shape (500, 12)'"),
    f"'Features: ' || CAST({_K} % 40 AS STRING)",
    _pick(3, "'Train samples: 80'", "'Training samples: 1,080'", "'Train: 12'"),
    _pick(3, "'Test  samples: 20'", "'Test: 7'"),
    _pick(5, "'Test ratio: 20.5%'", "'a test of 15% was held'"),
    _pick(4, f"'Train F1: 0.' || {_NUM}", f"'Train R2: 0.' || {_NUM}", f"'Train R^2: 0.' || {_LOW}"),
    _pick(4, f"'Test F1: 0.' || {_LOW}", f"'Test R2: ' || CASE WHEN {_K} % 9 = 0 THEN '-' ELSE '' END || '0.' || {_LOW}", f"'Test  R 2: 0.' || {_LOW}"),
    _pick(13, "'R2 gap: +0.30'", "'R2 gap: 0.15'", "'R2 gap: -0.20'", "'R^2 gap: 0.07'", "'R2 gap: 0.01'"),
    _pick(8, "'Train AUC: 0.91'", "''", "''", "'Train Accuracy: 0.88'", "'Train F1: 0.0'"),
    _pick(8, "'Test AUC: 0.72'", "''", "''", "'Test  Acc: 0.85'", "'Test F1: 0.0'"),
    _pick(16, "'Train Precision: 0.9'", "''", "''", "'Test Precision: 0.8'", "'Train Recall: 0.7'", "''", "''", "'Test Recall: 0.6'"),
    _pick(6, "'Train RMSE: 12.5'", "'Test RMSE: 13.25'", "'Train MAE: 3.5'", "'Test MAE: 4.5'", "'Train MAPE: 0.5'", "'Test MAPE: 0.75'"),
    _pick(7, "'Train RMSLE: 0.125'", "'Test RMSLE: 0.25'", "'learning_rate = 0.05'", "'l2_leaf_reg: 3.0'", "'Target mean: 10.5'", "'Target std: 2.5'",
          "'Std Score: 0.08'"),
    _pick(9, "'3 classes'", "'n_classes: 4'", "'num_classes: 5'", "'imbalance ratio: 3.5'", "'minority share 12.5%'", "'class ratio 0.25'",
          "'imbalanced but balanced'", "'imbalance handled by class weight'"),
    _pick(10, "'Mean Score: 0.0' || chr(10) || 'Std Score: 0.0'", "'CV Mean: 0.8' || chr(10) || 'CV Std: 0.09'", "'two folds failed: fold 2 fail'",
          "'CV Std: 0.01'"),
    _pick(6, "'Skewness: 1.25'", "'Skewness: -0.9'", "'Skewness: 0.1'"),
    _pick(7, "'12 duplicate rows (6.5%)'", "'3 duplicate rows (0.5%)'", "'0 duplicate rows'", "'7.5% of data is a duplicate; 9 duplicate rows'"),
    _pick(5, "'Total outlier samples: 14'", "'6 outliers'", "'0 outliers'"),
    _pick(8, "'missing values in 4.5%'", "'No missing value'", "'null values: 2.5%'", "'NaN detected'"),
    _pick(9, "'highly correlated features'", "'No highly correlated features'", "'multicollinearity seen'", "'leakage suspected'", "'No leakage'",
          "'leak was detected'"),
    _pick(9, "'low variance column'", "'No low variance'", "'constant feature x'", "'timestamp column'", "'high cardinality city'", "'unique 1234'",
          "'text columns'", "'tfidf'"),
    _pick(5, f"'COLUMNS: [' || {_names('area', 'price', 'mainroad', 'age')} || ']'", f"'COLUMNS - [' || chr(10) || {_names('x1', 'y', 'churn')} || ']'"),
    _pick(4, "'TARGET_COL: price'", f"'target column: ' || {_QUOTED} || 'y' || {_QUOTED} || ' here'"),
    _pick(6, "'5 categorical columns'", "'Categorical cols: 2'"),
    _pick(4, "'depth: 6'", "'max-depth = 8'"),
    _pick(5, "'iterations: 500'", "'n_estimators=200'", "'Trees built: 100'", "'n_trees: 50'"),
    _pick(6, "'Best iteration: 40'", "'Best iteration: 500'", "'best round: 190'", "'Best iteration: 0'"),
    _pick(12, "'trained on GPU'", "'cuda 12'"),
    _pick(7, "'PERMUTATION IMPORTANCE' || chr(10) || 'area 0.4 +- 0.1' || chr(10) || 'age 0.001 +- 0.0' || chr(10) || 'price 0.0'",
          "'Permutation importance' || chr(10) || 'rooms 30.5' || chr(10) || 'area 70.25' || chr(10) || 'STEP 4 end'",
          "'PERMUTATION IMPORTANCE' || chr(10) || 'a 0.2' || chr(10) || 'b 0.3' || chr(10) || 'a 0.5' || chr(10) || 'c 0.3'"),
]
REPORTS_SQL = ("(SELECT -1 - c_custkey AS doc_id, " + " || chr(10) || ".join(f"({x})" for x in _LINES) + " AS text FROM customer"
               " UNION ALL SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)")


def _reports(spark, sf):
    for name in ("customer", "conversations"):
        t(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM {REPORTS_SQL}")


def _q(p: str) -> str:
    return p.replace("'", "''")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _field_sql(kind: str, pats: list[str]) -> str:
    hits = [f"regexp_matches(tx, '(?i-s){_q(p)}')" for p in pats]
    if kind == "seen":
        return hits[0]
    if kind == "unless":
        return f"({hits[0]} AND NOT {hits[1]})"
    out = []
    for hit, p in zip(hits, pats):
        m = f"regexp_extract(tx, '(?i-s){_q(p)}', 1)"
        m = _strip(m) if kind == "word" else f"TRY_CAST(replace({m}, ',', '') AS DOUBLE)"
        out.append(f"CASE WHEN {hit} THEN {f'CAST(trunc({m}) AS BIGINT)' if kind == 'whole' else m} END")
    return f"coalesce({', '.join(out)})"


_SECTION = "regexp_replace(regexp_extract(tx, '(?is)PERMUTATION IMPORTANCE.*?(STEP [0-9]|$)', 0), '(?i)STEP [0-9]$', '')"
_ITEM = _q(RP.IMPORTANCE_ITEM)
FIELDS_SQL = f"""f0 AS (SELECT doc_id, coalesce(text, '') AS tx FROM {REPORTS_SQL}),
 f1 AS (SELECT doc_id, tx, {', '.join(f'{_field_sql(k, p)} AS {n}' for n, k, p in RP.REPORT_FIELDS)} FROM f0),
 f2 AS (SELECT * REPLACE (coalesce(model, 'Unknown') AS model, coalesce(target_col, 'target') AS target_col, coalesce(n_cat_cols, 0) AS n_cat_cols),
   CASE WHEN lower(coalesce(task_type, '')) LIKE '%classif%' THEN 'classification' WHEN lower(coalesce(task_type, '')) LIKE '%regress%' THEN 'regression'
     WHEN regexp_matches(tx, '(?i-s){RP.CLASSIFICATION_WORDS}') THEN 'classification' ELSE 'regression' END AS task,
   cv_fail_said OR coalesce(cv_mean = 0 AND cv_std = 0, false) AS cv_failed,
   CASE WHEN best_iter <> 0 AND iterations <> 0 THEN best_iter / iterations END AS used,
   regexp_extract_all(regexp_extract(tx, '(?s)COLUMNS\\s*[:\\-]\\s*\\[(.*?)\\]', 1), '''(\\w+)''', 1) AS cols,
   regexp_extract_all({_SECTION}, '{_ITEM}', 1) AS nm,
   list_transform(regexp_extract_all({_SECTION}, '{_ITEM}', 2), lambda v: CAST(v AS DOUBLE)) AS vl FROM f1),
 it AS (SELECT doc_id, target_col, name, min(pos) AS pos, arg_max(v, pos) AS v
   FROM (SELECT doc_id, target_col, unnest(nm) AS name, unnest(vl) AS v, generate_subscripts(nm, 1) AS pos FROM f2) GROUP BY doc_id, target_col, name),
 sc AS (SELECT doc_id, CASE WHEN max(v) > 1.5 THEN sum(v) ELSE 1.0 END AS scale FROM it GROUP BY doc_id),
 im AS (SELECT it.doc_id, count(*) AS n_importances, count_if(v / scale < 0.005 AND name <> target_col) AS n_near_zero,
   array_to_string(list(name ORDER BY v DESC, pos)[1:3], ',') AS top_predictors FROM it JOIN sc USING (doc_id) GROUP BY it.doc_id),
 fields AS (SELECT f2.* EXCLUDE (tx, task_type, cv_fail_said, used, cols, nm, vl), coalesce(used < 0.92, false) AS early_stop_triggered,
   coalesce(used < 0.6, false) AS capacity_wasted, coalesce(used >= 0.99, false) AS no_early_stop, array_to_string(cols, ',') AS columns,
   array_to_string(list_filter(cols, lambda c: c <> target_col AND NOT regexp_matches(c, '(?i){RP.KNOWN_BINARY_PATTERN}')), ',') AS numeric_features,
   coalesce(n_importances, 0) AS n_importances, coalesce(n_near_zero, 0) AS n_near_zero, coalesce(top_predictors, '') AS top_predictors
   FROM f2 LEFT JOIN im USING (doc_id))"""

register("extract_field", f"WITH {FIELDS_SQL} SELECT * FROM fields")(lambda spark, sf: RP.extract_fields(_reports(spark, sf)))

# Findings: (kind, code, condition), each standing alone.
ALONE = [
    ("issue", "negative_r2", "reg AND te < 0"), ("warning", "test_above_train", "gap < -0.05"), ("issue", "overfit_severe", "gap > 0.25"),
    ("issue", "overfit_moderate", "gap > 0.12 AND gap <= 0.25"), ("warning", "overfit_mild", "gap > 0.05 AND gap <= 0.12"),
    ("strength", "aligned", "gap >= -0.05 AND gap <= 0.05"), ("warning", "gap_unknown", "gap IS NULL"), ("issue", "underfit", "under"),
    ("strength", "excellent", "ok AND te >= 0.90"), ("strength", "strong", "ok AND te >= 0.80 AND te < 0.90"),
    ("warning", "decent", "ok AND reg AND te >= 0.70 AND te < 0.80"), ("warning", "moderate", "ok AND NOT reg AND te >= 0.70 AND te < 0.80"),
    ("issue", "weak", "ok AND reg AND te >= 0.50 AND te < 0.70"), ("issue", "very_weak", "ok AND reg AND te < 0.50"),
    ("issue", "low", "ok AND NOT reg AND te < 0.70"), ("issue", "duplicates", "n_duplicates > 0 AND coalesce(dup_pct, 0) > 5"),
    ("warning", "duplicates", "n_duplicates > 0 AND coalesce(dup_pct, 0) <= 5"), ("issue", "missing_values", "missing_vals"),
    ("warning", "outliers", "n_outliers <> 0"), ("warning", "multicollinearity", "has_multicollin"), ("issue", "leakage", "has_leakage"),
    ("warning", "low_variance", "has_low_variance"), ("warning", "high_cardinality", "has_high_card"), ("warning", "datetime_columns", "has_datetime"),
    ("warning", "text_columns", "has_text_cols"), ("issue", "class_imbalance", "class_imbalance"), ("issue", "right_skewed_target", "target_skewness > 0.75"),
    ("issue", "left_skewed_target", "target_skewness < -0.75"), ("strength", "mild_skew", "abs(target_skewness) <= 0.75"), ("issue", "cv_failed", "cv_failed"),
    ("warning", "cv_unstable", "NOT cv_failed AND cv_std > 0.05"), ("warning", "no_early_stop", "no_early_stop"), ("warning", "capacity_wasted", "capacity_wasted"),
    ("issue", "catboost_overparameterised", "gap > 0.12 AND md LIKE '%catboost%'"), ("issue", "lightgbm_overfit", "gap > 0.12 AND (md LIKE '%lightgbm%' OR md LIKE '%lgbm%')"),
    ("issue", "xgboost_overfit", "gap > 0.12 AND md LIKE '%xgb%'"), ("issue", "randomforest_overfit", "gap > 0.12 AND md LIKE '%randomforest%'"),
    ("issue", "linear_overfit", "gap > 0.12 AND (md LIKE '%linear%' OR md LIKE '%ridge%' OR md LIKE '%lasso%')"),
    ("strength", "catboost_categoricals", "md LIKE '%catboost%'"), ("strength", "gpu", "gpu_hint"), ("strength", "top_predictors", "n_importances > 0"),
    ("warning", "near_zero_importance", "n_near_zero > 0"), ("warning", "no_importance", "n_importances = 0"),
]


#: Runs with their scores judged, over the fields.
RUNS_SQL = """runs AS (SELECT *, task = 'regression' AS reg, lower(model) AS md,
   CASE WHEN task = 'regression' THEN train_r2 WHEN train_f1 <> 0 THEN train_f1 WHEN train_auc <> 0 THEN train_auc ELSE train_acc END AS tr,
   CASE WHEN task = 'regression' THEN test_r2 WHEN test_f1 <> 0 THEN test_f1 WHEN test_auc <> 0 THEN test_auc ELSE test_acc END AS te FROM fields),
 bad AS (SELECT *, coalesce(r2_gap, tr - te) AS gap, coalesce(CASE WHEN reg THEN tr < 0.6 AND te < 0.6 ELSE tr < 0.7 AND te < 0.7 END, false) AS under FROM runs),
 judged AS (SELECT *, coalesce(te >= 0, false) AND NOT under AS ok FROM bad)"""


def _findings_sql() -> str:
    parts = [f"SELECT doc_id AS run_id, '{k}' AS kind, '{c}' AS code FROM judged WHERE coalesce({cond}, false)" for k, c, cond in ALONE]
    return f"WITH {FIELDS_SQL}, {RUNS_SQL} " + " UNION ALL ".join(parts)


register("diagnose_reports", _findings_sql())(lambda spark, sf: RP.diagnose_reports(_reports(spark, sf)).select("run_id", "kind", "code"))

#: Findings that rest on the report's words alone.
FROM_TEXT = ("multicollinearity", "leakage", "low_variance", "high_cardinality", "datetime_columns", "text_columns")


def _runs(spark, sf):
    """Runs as a table, without the fields of FROM_TEXT."""
    f = RP.extract_fields(_reports(spark, sf))
    return f.select(*[c for c in f.columns if not c.startswith("has_")]).withColumnRenamed("doc_id", "run_id")


register("diagnose_fit", f"SELECT * FROM ({_findings_sql()}) WHERE code NOT IN {FROM_TEXT}")(
    lambda spark, sf: RP.diagnose_fit(_runs(spark, sf)).select("run_id", "kind", "code"))
