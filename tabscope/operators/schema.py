"""Schema, type and role inference.

Name-based rules run on a metadata DataFrame ``(ordinal, column, dtype)``
derived from the table's schema; data-based rules are single aggregates over
the long form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import div, to_number
from .common import INTEGRAL, NUMERIC, TEMPORAL, long_form, numeric_columns, text_columns
from .profile import KPI_KEYWORDS, distinct_counts

# Type-detection thresholds.
DATETIME_HIT_RATE = 0.80
HIGH_CARD_THR = 20
LOW_CARD_TRAIN_THR = 15
CLASSIFICATION_MAX_DISTINCT = 20

# Semantic role patterns (case-insensitive, first match wins, in this order).
ROLE_PATTERNS = [
    ("id", r"^id$|_id$|^id_|customerid|userid|empid|rownum|policy_number|account_number|order_id|transaction_id"),
    ("flag", r"^(is|has|can|was|did|will|got|had)[_-]|[_-](flag|ind|yn|bin|bool|active|enabled|allowed)$|"
             r"^(mainroad|basement|guestroom|hotwaterheating|airconditioning|prefarea|default|churn|fraud|attrition|"
             r"smoker|married|graduate|self_employed|international|senior_citizen|partner|dependents|paperless|overtime)$"),
    ("size", r"\barea\b|sqft|sq_ft|\bsize\b|\bspace\b|\bfloor\b|footage|sqm|\bm2\b|\bacreage\b|\bvolume\b|"
             r"\bcapacity\b|dimension|length|width|height|depth|\bspan\b"),
    ("count", r"\bnum_|\bn_|_count\b|\bqty\b|\bquantity\b|\btotal\b|\bnumber\b|no_of|\brooms\b|\bbeds\b|\bbaths\b|"
              r"\bfloors\b|\bseats\b|\bunits\b|\bmembers\b|\bbedrooms?\b|\bbathrooms?\b|\bstories\b|\bdoors?\b|"
              r"\bwindows?\b|\bemployees\b"),
    ("rate", r"\brate\b|\bratio\b|\bpct\b|percent|\bscore\b|\bindex\b|\bgrade\b|\brank\b|\brating\b|\bproportion\b|"
             r"\bshare\b|\bfraction\b|\bgpa\b|\bbmi\b|\bdensity\b"),
    ("duration", r"\bage\b|\btenure\b|\bduration\b|\bdays?\b|\bmonths?\b|\byears?\b|\bhours?\b|\bperiod\b|"
                 r"\belapsed\b|\bsince\b|\bvintage\b|\bexperience\b|\bseniority\b|contract_months?|loan_term"),
    ("money", r"\bprice\b|\bcost\b|\bsalary\b|\bincome\b|\brevenue\b|\bamount\b|\bbalance\b|\bpremium\b|\bfee\b|"
              r"\bwage\b|\bpayment\b|\bspend\b|\bbudget\b|\bvalue\b|\bworth\b|\bcredit\b|\bdebt\b|\bloan\b|"
              r"\bcharge\b|\bbill\b|\btax\b|\bprofit\b|\bloss\b|\bmargin\b"),
    ("distance", r"\bdist(ance)?\b|\bkm\b|\bmiles?\b|\blat\b|\blon\b|\bcoord\b|\bproximity\b|\bradius\b|"
                 r"\bnearness\b|\blocation\b"),
    ("category", r"\btype\b|\bcategory\b|\bclass\b|\bkind\b|\bbrand\b|\bproduct\b|\bsegment\b|\btier\b|"
                 r"\bdepartment\b|\bteam\b|\bregion\b|\bcity\b|\bcountry\b|\bstate\b|\bzone\b|\bgender\b|\bsex\b|"
                 r"\brace\b|\bethnicity\b|\beducation\b|\boccupation\b|\bcontract\b|payment_method|"
                 r"internet_service|\bfurnishing\b"),
]

# Flag-column name pattern (case-insensitive).
FLAG_PATTERN = (r"^(is|has|can|was|did|will|got|had)_?\w+|"
                r"\w+_(flag|ind|yn|bin|bool|status|active|enabled|allowed)$")

# Name pattern of known yes/no columns excluded from numeric features (case-insensitive).
KNOWN_BINARY_PATTERN = (r"road|guest|basement|heating|air|cond|pref|area.*status|furnish|status|"
                        r"gender|married|dependents|self.employ|education|loan|default|churn|fraud|"
                        r"smoker|insured|incident|collision|bodily|authorities|auto|umbrella|capital")


def column_meta(df: DataFrame) -> DataFrame:
    """Metadata table (ordinal, column, dtype) derived from the schema."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, dtype string")


def _ci(pattern: str) -> str:
    return "(?i)" + pattern


# ---------------------------------------------------------------- T1, T2

def column_tags(df: DataFrame, hit_rate: float = DATETIME_HIT_RATE) -> DataFrame:
    """Boolean, datetime, numeric, then text: datetime_string / mixed / categorical.

    A text column is judged on all its non-null values, all columns in one aggregate: datetime_string if at least
    ``hit_rate`` of them parse as times, mixed if they are of more than one kind (number, time, other).
    """
    tags, texts = {}, []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            tags[f.name] = "boolean"
        elif isinstance(f.dataType, TEMPORAL):
            tags[f.name] = "datetime"
        elif isinstance(f.dataType, NUMERIC):
            tags[f.name] = "numeric"
        elif isinstance(f.dataType, T.StringType):
            texts.append(f.name)
        else:
            tags[f.name] = "categorical"
    found = []
    for c in texts:
        v = F.col(c)
        is_num, is_ts = to_number(v).isNotNull(), v.try_cast("timestamp").isNotNull()
        kinds = [is_num, is_ts & ~is_num, v.isNotNull() & ~is_num & ~is_ts]
        hit = F.avg(F.when(v.isNotNull(), is_ts.cast("double")))
        mixed = sum((F.max(k.cast("int")) for k in kinds), F.lit(0)) > 1
        found.append(F.when(hit >= hit_rate, "datetime_string").when(mixed, "mixed").otherwise("categorical").alias(c))
    meta = column_meta(df)
    fixed = F.create_map(*[x for k, v in tags.items() for x in (F.lit(k), F.lit(v))]) if tags else None
    if texts:
        meta = meta.join(F.broadcast(df.agg(*found).unpivot([], texts, "column", "_tag")), "column", "left")
    else:
        meta = meta.withColumn("_tag", F.lit(None).cast("string"))
    tag = F.coalesce(F.element_at(fixed, F.col("column")) if fixed is not None else F.lit(None).cast("string"),
                     F.col("_tag"), F.lit("categorical"))
    return meta.select("ordinal", "column", "dtype", tag.alias("tag"))


def resolve_target(df: DataFrame, requested: str | None = None) -> tuple[str | None, str]:
    """Requested if present, else the last column (the inference module is absent)."""
    if requested and requested in df.columns:
        return requested, "manual"
    return (df.columns[-1] if df.columns else None), "fallback_last_column"


def overview(df: DataFrame, target: str | None = None) -> DataFrame:
    """Rows, columns, columns per tag, target and its source."""
    tgt, src = resolve_target(df, target)
    tags = column_tags(df)
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    t = tags.agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == k,
                                                                            F.struct("ordinal", "column")))),
                                              lambda s: s["column"]), ",").alias(f"{k}_cols")
                   for k in ("numeric", "categorical", "datetime", "datetime_string", "boolean", "mixed")])
    # one-row aggregates combined by union + fold (no join between them)
    u = n.select(F.col("n_rows").cast("string").alias("v"), F.lit("n_rows").alias("k"))
    for k in ("numeric", "categorical", "datetime", "datetime_string", "boolean", "mixed"):
        u = u.unionByName(t.select(F.col(f"{k}_cols").alias("v"), F.lit(f"{k}_cols").alias("k")))
    g = u.agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in
                ("n_rows", "numeric_cols", "categorical_cols", "datetime_cols", "datetime_string_cols",
                 "boolean_cols", "mixed_cols")])
    return g.select(F.col("n_rows").cast("long").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"),
                    "numeric_cols", "categorical_cols", "datetime_cols", "datetime_string_cols", "boolean_cols",
                    "mixed_cols", F.lit(tgt).alias("target"), F.lit(src).alias("target_source"))


# ---------------------------------------------------------------- T4-T7

def infer_task_type(df: DataFrame, target: str, max_classes: int = CLASSIFICATION_MAX_DISTINCT) -> DataFrame:
    """T4: classification if the target has <= 20 distinct non-null values, else regression."""
    g = df.where(F.col(target).isNotNull()).groupBy(F.col(target)).agg(F.count(F.lit(1)).alias("_n")) \
        .agg(F.count(F.lit(1)).alias("n_distinct"))
    return g.select(F.lit(target).alias("target"), "n_distinct",
                    F.when(F.col("n_distinct") <= max_classes, "classification").otherwise("regression").alias("task_type"))


def dtype_audit(df: DataFrame) -> DataFrame:
    """T5: numeric_as_object, possible_boolean_as_int, possible_id_column (last match wins)."""
    fields = df.schema.fields
    strs = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    ints = [f.name for f in fields if isinstance(f.dataType, INTEGRAL)]
    nonstr = [f.name for f in fields if not isinstance(f.dataType, T.StringType)]
    exprs = [F.count(F.lit(1)).alias("_rows")]
    for c in strs:
        exprs.append(F.avg(F.when(F.col(c).isNotNull(), to_number(F.col(c)).isNotNull().cast("double"))).alias(f"conv_{c}"))
    for c in ints:
        exprs.append(F.bool_and(F.coalesce(F.col(c).isin(0, 1), F.lit(True))).alias(f"bin_{c}"))
    agg = df.agg(*exprs)
    dc = distinct_counts(df, nonstr) if nonstr else None
    rows = []
    for f in fields:
        c = f.name
        cond_issue = F.lit(None).cast("string")
        if c in strs:
            cond_issue = F.when(F.col(f"conv_{c}") >= 0.95, "numeric_as_object").otherwise(cond_issue)
        if c in ints:
            cond_issue = F.when(F.col(f"bin_{c}"), "possible_boolean_as_int").otherwise(cond_issue)
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(f.dataType.simpleString()).alias("current_dtype"),
                             cond_issue.alias("issue")))
    base = agg.select("_rows", F.explode(F.array(*rows)).alias("r")).select("_rows", "r.*")
    if dc is not None:
        base = base.join(F.broadcast(dc), "column", "left")
        idc = F.when(F.col("n_unique") == F.col("_rows"), "possible_id_column").otherwise(F.col("issue"))
        base = base.withColumn("issue", idc)
    return base.where(F.col("issue").isNotNull()).select("column", "current_dtype", "issue")


def cardinality_audit(df: DataFrame, high_card: int = HIGH_CARD_THR) -> DataFrame:
    """Distinct (no nulls), pct of rows, tag constant / binary / id_like / low_card / high_card."""
    dc = distinct_counts(df)
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    u = dc.select("column", F.col("n_unique").cast("long").alias("v")).unionByName(
        rows.select(F.lit("\u0000rows").alias("column"), F.col("_rows").cast("long").alias("v")))
    # the row count rides along as one more (bounded) row; a window over <= columns+1 rows spreads it
    w = Window.partitionBy()
    u = u.withColumn("_rows", F.max(F.when(F.col("column") == "\u0000rows", F.col("v"))).over(w)) \
        .where(F.col("column") != "\u0000rows")
    meta = column_meta(df).select("column")
    j = meta.join(u, "column", "left").select("column", F.coalesce(F.col("v"), F.lit(0)).alias("n_unique"), "_rows")
    n = F.col("n_unique")
    tag = (F.when(n <= 1, "constant").when(n == 2, "binary").when(n == F.col("_rows"), "id_like")
           .when(n <= high_card, "low_card").otherwise("high_card"))
    return j.select("column", "n_unique", F.round(div(n, "_rows") * 100, 2).alias("pct_unique"), tag.alias("tag"))


def split_by_cardinality(df: DataFrame, cols: Sequence[str] | None = None, threshold: int = LOW_CARD_TRAIN_THR) -> DataFrame:
    """Categorical columns with <= threshold distinct values are low, else high."""
    cols = list(cols) if cols is not None else text_columns(df)
    dc = distinct_counts(df, cols)
    return dc.select("column", "n_unique", F.when(F.col("n_unique") <= threshold, "low").otherwise("high").alias("group"))


# ---------------------------------------------------------------- T8-T13 (names)

def role_of(name_col) -> "F.Column":
    expr = None
    for role, pat in ROLE_PATTERNS:
        cond = name_col.rlike(_ci(pat))
        expr = F.when(cond, role) if expr is None else expr.when(cond, role)
    return expr.otherwise("unknown")


def column_roles(df: DataFrame, target: str | None = None) -> DataFrame:
    """First matching role pattern per non-target column."""
    m = column_meta(df).where(F.col("column") != F.lit(target or "\u0000"))
    return m.select("column", role_of(F.col("column")).alias("role"))


def flag_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """Names that look like binary flags."""
    m = column_meta(df).where(F.col("column") != F.lit(target or "\u0000"))
    return m.where(F.col("column").rlike(_ci(FLAG_PATTERN))).select("column")


def numeric_feature_names(df: DataFrame, target: str | None = None) -> DataFrame:
    """Columns minus target minus known yes/no name patterns."""
    m = column_meta(df).where(F.col("column") != F.lit(target or "\u0000"))
    return m.where(~F.col("column").rlike(_ci(KNOWN_BINARY_PATTERN))).select("column")


def select_numeric_columns(df: DataFrame, cols: Sequence[str] | None = None, max_cols: int | None = None) -> DataFrame:
    """Keep non_null >= 25 and distinct >= 3; order by (non_null, |variance|) desc; the first ``max_cols`` if given.

    Numeric columns are taken as they are, text columns as the numbers they hold; one aggregate over both.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    num = df.select(*[(to_number(F.col(c)) if c in texts else F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in cols])
    long = long_form(num, cols)
    g = long.groupBy("column").agg(F.count(F.lit(1)).alias("non_null"), F.abs(F.coalesce(F.round(F.var_samp("value"), 6), F.lit(0.0))).alias("variance"),
                                   F.min("value").alias("least"), F.max("value").alias("most"))
    # three distinct values: one lies strictly between the least and the greatest
    third = long.join(F.broadcast(g.select("column", "least", "most")), "column").where("value > least AND value < most").select("column").distinct()
    g = g.where(F.col("non_null") >= 25).join(F.broadcast(third), "column")
    out = g.select("column", "non_null", "variance").orderBy(F.desc("non_null"), F.desc("variance"), "column")
    return out.limit(max_cols) if max_cols else out


def feature_schema(df: DataFrame, target: str, order_by: Sequence[str]) -> DataFrame:
    """Feature columns (all but target) with their type and one example value (first row by key)."""
    feats = [c for c in df.columns if c != target]
    key = F.struct(*[F.col(o) for o in order_by])
    agg = df.agg(*[F.min_by(F.col(c).cast("string"), key).alias(c) for c in feats])
    ex = agg.unpivot([], feats, "column", "example")
    return column_meta(df).join(ex, "column").select("ordinal", "column", "dtype", "example")


def kpi_column_names(df: DataFrame, keywords: Sequence[str] = KPI_KEYWORDS, k: int | None = None) -> DataFrame:
    """Numeric names containing a KPI keyword, default all numerics (the first k if given)."""
    nums = numeric_columns(df)
    m = column_meta(df).where(F.col("column").isin(nums))
    hit = F.lit(False)
    for kw in keywords:
        hit = hit | F.lower(F.col("column")).contains(kw)
    m = m.withColumn("_hit", hit)
    w = Window.partitionBy("_hit").orderBy("ordinal")
    any_hit = F.max(F.col("_hit").cast("int")).over(Window.partitionBy())
    m = m.withColumn("_rn", F.row_number().over(w)).withColumn("_any", any_hit == 1)
    return m.where((F.lit(k is None) | (F.col("_rn") <= (k or 0))) & (F.col("_hit") == F.col("_any"))).select("ordinal", "column")
