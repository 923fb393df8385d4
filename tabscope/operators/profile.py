"""Profiling and data-quality aggregates.

Plan shape: unpivot the chosen columns once to ``(column, value)`` and
aggregate by ``column``; per-column statistics are schema-bounded (one row per
column), so joining them back to rows is a broadcast of a proven-small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import div, safe_round, skew_label
from .common import date_columns, first_n, long_form, numeric_columns, safe_corr, sample_kurt, sample_skew, text_columns
from .quantiles import exact_quantiles, quantile_table

R = safe_round

# Keyword lists for numeric anomaly flags and KPI detection.
NEGATIVE_KEYWORDS = ["price", "age", "count", "qty", "quantity", "amount", "salary", "income", "area",
                     "size", "sqft", "population", "weight", "height", "distance", "duration", "rate"]
ZERO_KEYWORDS = ["price", "salary", "income", "area", "sqft", "revenue", "cost", "value"]
KPI_KEYWORDS = ["price", "revenue", "sales", "amount", "income", "salary", "cost", "profit", "value",
                "score", "rating", "age", "count", "qty", "quantity", "area", "sqft", "size"]

# Thresholds of the analysis template.
HIGH_CARD_THR = 20
MAX_CAT_FREQ_SHOW = 15
HIST_BINS = 30
SEGMENT_MAX_GROUPS = 10
OUTLIER_Z = 3.0

DESCRIBE_PROBS = [0.5, 0.01, 0.05, 0.25, 0.75, 0.95, 0.99]


def _lit_map(d: dict):
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def _dtype_name(df: DataFrame) -> dict:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


# ---------------------------------------------------------------- A1, A2

def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A1: per-column descriptive statistics with pandas' bias-corrected moments."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    long = long_form(df, cols)
    mom = long.groupBy("column").agg(
        F.count("value").cast("double").alias("_n"), F.avg("value").alias("_mean"),
        F.stddev_samp("value").alias("_sd"), F.var_samp("value").alias("_var"),
        F.var_pop("value").alias("_m2"), F.min("value").alias("_min"), F.max("value").alias("_max"),
        F.skewness("value").alias("_g1"), F.kurtosis("value").alias("_g2"))
    q = quantile_table(long, DESCRIBE_PROBS)
    j = mom.join(F.broadcast(q), "column")
    n = F.col("_n")
    sk = R(sample_skew(F.col("_g1"), n, F.col("_m2")))
    return j.select(
        "column", n.cast("long").alias("count"), R("_mean").alias("mean"), R(F.col("q")[0]).alias("median"),
        R("_sd").alias("std"), R("_var").alias("variance"), R("_min").alias("min"), R("_max").alias("max"),
        R(F.col("_max") - F.col("_min")).alias("range"), R(F.col("q")[1]).alias("p1"),
        R(F.col("q")[2]).alias("p5"), R(F.col("q")[3]).alias("q1"), R(F.col("q")[4]).alias("q3"),
        R(F.col("q")[5]).alias("p95"), R(F.col("q")[6]).alias("p99"),
        R(F.col("q")[4] - F.col("q")[3]).alias("iqr"), sk.alias("skewness"),
        R(sample_kurt(F.col("_g2"), n, F.col("_m2"))).alias("kurtosis"), skew_label(sk).alias("skew_label"),
        R(F.when(F.col("_mean") != 0, F.col("_sd") / F.col("_mean") * 100)).alias("cv_pct"))


# ---------------------------------------------------------------- A3-A7

def _severity(ratio):
    return (F.when(ratio > 0.5, "critical").when(ratio > 0.2, "high")
            .when(ratio > 0.05, "moderate").otherwise("low"))


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, n_missing, n_rows) for every column, one scan, one wide aggregate."""
    cols = list(cols) if cols is not None else df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return agg.unpivot(["_rows"], cols, "column", "n_missing").withColumnRenamed("_rows", "n_rows")


def missing_by_column(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = True) -> DataFrame:
    """A3: count, pct (2 dp), dtype, severity; columns with nulls only."""
    m = missing_counts(df, cols)
    if only_missing:
        m = m.where(F.col("n_missing") > 0)
    ratio = div("n_missing", "n_rows")
    return m.select(
        "column", F.col("n_missing").alias("count"), F.round(ratio * 100, 2).alias("pct"),
        F.element_at(_lit_map(_dtype_name(df)), F.col("column")).alias("dtype"), _severity(ratio).alias("severity"))


def missing_summary(df: DataFrame) -> DataFrame:
    """A4: total cells missing, pct, columns with nulls, all-null columns."""
    m = missing_counts(df)
    k = len(df.columns)
    return m.agg(
        F.sum("n_missing").cast("long").alias("total_missing_cells"),
        F.round(div(F.sum("n_missing"), F.max("n_rows") * k) * 100, 2).alias("total_missing_pct"),
        F.count_if(F.col("n_missing") > 0).alias("cols_with_missing"),
        F.array_join(F.sort_array(F.collect_list(
            F.when((F.col("n_missing") == F.col("n_rows")) & (F.col("n_rows") > 0), F.col("column")))), ",")
        .alias("completely_null_cols"))


def co_missingness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A5: rows where both columns of a pair are null (pairs with count > 0).

    Cost follows the nulls: each row emits only pairs of its own null columns.
    """
    cols = list(cols) if cols is not None else df.columns
    nulls = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    x = df.select(nulls.alias("nc")).where(F.size("nc") >= 2)
    a = x.select("nc", F.posexplode("nc").alias("i", "col1"))
    b = a.select("col1", "i", F.posexplode("nc").alias("j", "col2")).where(F.col("i") < F.col("j"))
    return b.groupBy("col1", "col2").agg(F.count(F.lit(1)).alias("n_both"))


def mar_signals(df: DataFrame, num_cols: Sequence[str] | None = None, max_missing: int | None = None,
                max_numeric: int | None = None, min_abs_r: float = 0.15, with_p: bool = True,
                p_max: float = 0.05) -> DataFrame:
    """Point-biserial r between a null indicator and a numeric column.

    Candidate columns come from A3 (schema-bounded list); all pairs are then one aggregate.
    """
    miss = [r["column"] for r in missing_by_column(df).select("column").collect()]
    order = {c: i for i, c in enumerate(df.columns)}
    miss = first_n(sorted(miss, key=order.get), max_missing)
    nums = first_n(num_cols if num_cols is not None else numeric_columns(df), max_numeric)
    pairs = [(m, x) for m in miss for x in nums if x != m]
    if not pairs:
        return df.sparkSession.createDataFrame(
            [], "missing_col string, predictor_col string, n long, correlation double" +
            (", p_value double" if with_p else ""))
    exprs = []
    for i, (m, x) in enumerate(pairs):
        ind = F.when(F.col(x).isNotNull(), F.col(m).isNull().cast("double"))
        exprs += [F.count(F.col(x)).alias(f"n{i}"), safe_corr(ind, F.col(x).cast("double")).alias(f"r{i}"),
                  F.stddev_samp(ind).alias(f"s{i}")]
    agg = df.agg(*exprs)
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("missing_col"), F.lit(x).alias("predictor_col"),
                                         F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"),
                                         F.col(f"s{i}").alias("s"))
                                for i, (m, x) in enumerate(pairs)]))
    out = agg.select(stack.alias("p")).select("p.*").where((F.col("n") >= 10) & (F.col("s") > 0))
    out = out.select("missing_col", "predictor_col", "n", R("r").alias("correlation"))
    if min_abs_r:
        out = out.where(F.abs("correlation") >= min_abs_r)
    if with_p:
        from ..functions.pvalues import pearson_p
        out = out.withColumn("p_value", R(pearson_p(F.col("correlation"), F.col("n"))))
        if p_max is not None:
            out = out.where(F.col("p_value") < p_max)
    return out


def null_rate_top(df: DataFrame, k: int = 5) -> DataFrame:
    """Null pct per column, top k (ties by column name)."""
    m = missing_by_column(df, only_missing=False)
    return m.select("column", "pct").orderBy(F.desc("pct"), "column").limit(k)


# ---------------------------------------------------------------- A8, A16

def _wide_table(df: DataFrame, cols: Sequence[str], aggs, chunk: int = 40) -> DataFrame:
    """One row per column of the aggregates that ``aggs`` makes of it as a double; columns of a scan side by side, rows never unpivoted."""
    named = [(c, F.col(c).cast("double")) for c in cols] or [("", F.lit(None).cast("double"))]
    out = None
    for s in range(0, len(named), chunk):
        row = df.agg(*[F.struct(F.lit(c).alias("column"), *[x.alias(n) for n, x in aggs(v).items()]).alias(f"s{i}") for i, (c, v) in enumerate(named[s:s + chunk])])
        part = row.select(F.explode(F.array(*row.columns)).alias("s")).select("s.*")
        out = part if out is None else out.unionByName(part)
    return out


def column_fences(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """J1 input: per-column n, mean, sd (sample, population), q1, median, q3, iqr, min, max."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    mom = _wide_table(df, cols, lambda v: {
        "n": F.count(v), "mean": F.avg(v), "sd": F.stddev_samp(v), "sd_pop": F.stddev_pop(v), "min": F.min(v), "max": F.max(v)}).where("n > 0")
    q = df.sparkSession.createDataFrame([*exact_quantiles(df, cols, [0.25, 0.5, 0.75]).items()], "column string, q array<double>")
    return (mom.join(F.broadcast(q), "column")
            .select("*", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
            .drop("q").withColumn("iqr", F.col("q3") - F.col("q1")))


def outliers_by_column(df: DataFrame, cols: Sequence[str] | None = None, only_flagged: bool = True) -> DataFrame:
    """IQR (1.5, 3.0) and z > 3 outlier counts with severity."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    st = column_fences(df, cols).where((F.col("n") >= 4) & (F.col("iqr") != 0))
    st = st.select("*", (F.col("q1") - 1.5 * F.col("iqr")).alias("lo"), (F.col("q3") + 1.5 * F.col("iqr")).alias("hi"),
                   (F.col("q1") - 3.0 * F.col("iqr")).alias("lo3"), (F.col("q3") + 3.0 * F.col("iqr")).alias("hi3"))
    fences = st.collect()
    st = df.sparkSession.createDataFrame(fences, st.schema)
    if not fences:
        cnt = st.select("column", *[F.lit(0).cast("long").alias(c) for c in ("iqr_outliers", "extreme_outliers", "zscore_outliers")])
    else:
        of = {r["column"]: r for r in fences}
        rows = {c: (F.col(c).cast("double"), {k: F.lit(of[c][k]).cast("double") for k in ("lo", "hi", "lo3", "hi3", "mean", "sd", "sd_pop")}) for c in of}
        row = df.agg(*[F.struct(
            F.lit(c).alias("column"), F.count_if((v < f["lo"]) | (v > f["hi"])).alias("iqr_outliers"),
            F.count_if((v < f["lo3"]) | (v > f["hi3"])).alias("extreme_outliers"),
            F.count_if((f["sd"] > 0) & (F.abs(v - f["mean"]) / F.nullif(f["sd_pop"], F.lit(0.0)) > OUTLIER_Z)).alias("zscore_outliers")).alias(f"s{i}")
            for i, (c, (v, f)) in enumerate(rows.items())])
        cnt = row.select(F.explode(F.array(*row.columns)).alias("s")).select("s.*")
    j = cnt.join(F.broadcast(st), "column")
    if only_flagged:
        j = j.where(F.col("iqr_outliers") > 0)
    ratio = div("iqr_outliers", "n")
    return j.select(
        "column", "iqr_outliers", F.round(ratio * 100, 2).alias("iqr_outlier_pct"), "zscore_outliers",
        "extreme_outliers", R("lo").alias("lower_fence"), R("hi").alias("upper_fence"),
        R("min").alias("min_value"), R("max").alias("max_value"),
        F.when(ratio > 0.10, "high").when(ratio > 0.03, "moderate").otherwise("low").alias("severity"))


def boxplot_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Quartiles, whiskers (extreme points inside 1.5 IQR), outlier count."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    st = column_fences(df, cols).where(F.col("n") >= 4)
    st = st.select("*", (F.col("q1") - 1.5 * F.col("iqr")).alias("lo"), (F.col("q3") + 1.5 * F.col("iqr")).alias("hi"))
    long = long_form(df, cols).join(F.broadcast(st.select("column", "lo", "hi")), "column")
    v = F.col("value")
    w = long.groupBy("column").agg(
        F.min(F.when(v >= F.col("lo"), v)).alias("lower_whisker"),
        F.max(F.when(v <= F.col("hi"), v)).alias("upper_whisker"),
        F.count_if((v < F.col("lo")) | (v > F.col("hi"))).alias("n_outliers"))
    j = w.join(F.broadcast(st), "column")
    return j.select("column", R("min").alias("min"), R("q1").alias("q1"), R("median").alias("median"),
                    R("q3").alias("q3"), R("max").alias("max"), R("iqr").alias("iqr"),
                    R("lower_whisker").alias("lower_whisker"), R("upper_whisker").alias("upper_whisker"),
                    "n_outliers")


def boxplot_outlier_sample(df: DataFrame, order_by: Sequence[str], cols: Sequence[str] | None = None,
                           k: int = 10) -> DataFrame:
    """Up to k outliers per column in row order (top-k per group, limited before the shuffle)."""
    cols = list(cols) if cols is not None else [c for c in numeric_columns(df) if c not in order_by]
    st = column_fences(df, cols).where(F.col("n") >= 4)
    st = st.select("column", (F.col("q1") - 1.5 * F.col("iqr")).alias("lo"),
                   (F.col("q3") + 1.5 * F.col("iqr")).alias("hi"))
    long = long_form(df, cols, ids=list(order_by)).join(F.broadcast(st), "column")
    out = long.where((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
    w = Window.partitionBy("column").orderBy(*[F.col(o) for o in order_by])
    return (out.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= k)
            .select("column", F.col("ordinal").cast("long").alias("ordinal"), R("value").alias("value")))


# ---------------------------------------------------------------- A9

def duplicate_summary(df: DataFrame, num_cols: Sequence[str] | None = None) -> DataFrame:
    """Duplicate rows beyond the first, pct, rows in any duplicate group, numeric-only duplicates."""
    nums = list(num_cols) if num_cols is not None else numeric_columns(df)
    full = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    a = full.agg(F.sum("_n").alias("n_rows"), F.sum(F.col("_n") - 1).alias("dup"),
                 F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("inv"))
    parts = [a.select(F.lit("rows").alias("k"), F.col("n_rows").cast("double").alias("v")),
             a.select(F.lit("dup").alias("k"), F.col("dup").cast("double").alias("v")),
             a.select(F.lit("inv").alias("k"), F.col("inv").cast("double").alias("v"))]
    if nums:
        nd = df.groupBy(*nums).agg(F.count(F.lit(1)).alias("_n")).agg(F.sum(F.col("_n") - 1).alias("v"))
        parts.append(nd.select(F.lit("num").alias("k"), F.col("v").cast("double").alias("v")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    g = u.agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("rows", "dup", "inv", "num")])
    return g.select(F.coalesce(F.col("dup"), F.lit(0)).cast("long").alias("duplicate_rows"),
                    F.round(F.coalesce(div("dup", "rows"), F.lit(0.0)) * 100, 2).alias("duplicate_rows_pct"),
                    F.coalesce(F.col("inv"), F.lit(0)).cast("long").alias("rows_involved_in_dups"),
                    F.coalesce(F.col("num"), F.lit(0)).cast("long").alias("numeric_only_dups"))


# ---------------------------------------------------------------- A10

def date_profile(df: DataFrame, cols: Sequence[str] | None = None, as_of: str = "2024-01-15") -> DataFrame:
    """A10: min, max, span days, parsed, failed, future vs a given as_of, distinct months and years."""
    cols = list(cols) if cols is not None else date_columns(df)
    long = long_form(df, cols, cast="string", drop_null=False)
    ts = F.col("value").try_cast("timestamp")
    long = long.select("column", ts.alias("t"))
    g = long.groupBy("column").agg(
        F.min("t").alias("_min"), F.max("t").alias("_max"), F.count("t").alias("n_parsed"),
        F.count_if(F.col("t").isNull()).alias("n_failed"),
        F.count_if(F.col("t") > F.lit(as_of).cast("timestamp")).alias("n_future_dates"),
        F.count_distinct(F.date_format("t", "yyyy-MM")).alias("unique_months"),
        F.count_distinct(F.year("t")).alias("unique_years"))
    g = g.where(F.col("n_parsed") > 0)
    span = F.floor((F.unix_micros("_max") - F.unix_micros("_min")) / F.lit(86400000000)).cast("long")
    return g.select("column", F.date_format("_min", "yyyy-MM-dd").alias("min_date"),
                    F.date_format("_max", "yyyy-MM-dd").alias("max_date"), span.alias("span_days"),
                    "n_parsed", "n_failed", "n_future_dates", "unique_months", "unique_years",
                    (F.col("n_future_dates") > 0).alias("has_future_dates"))


# ---------------------------------------------------------------- A11-A13

def _name_has(col_name: str, words: Sequence[str]) -> bool:
    low = col_name.lower()
    return any(w in low for w in words)


def numeric_anomalies(df: DataFrame, order_by: Sequence[str] | None = None, cols: Sequence[str] | None = None,
                      neg_keywords: Sequence[str] = NEGATIVE_KEYWORDS,
                      zero_keywords: Sequence[str] = ZERO_KEYWORDS) -> DataFrame:
    """Negatives where the name says they should not exist (with the first example), zeros likewise."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    neg = [c for c in cols if _name_has(c, neg_keywords)]
    zer = [c for c in cols if _name_has(c, zero_keywords)]
    schema = "column string, type string, count long, example double"
    if not neg and not zer:
        return df.sparkSession.createDataFrame([], schema)
    order = list(order_by or [])
    key = F.struct(*[F.col(o) for o in order]) if order else F.lit(0)
    exprs = []
    for c in neg:
        v = F.col(c).cast("double")
        exprs += [F.count_if(v < 0).alias(f"neg_n_{c}"), F.min_by(F.when(v < 0, v), F.when(v < 0, key)).alias(f"neg_x_{c}")]
    for c in zer:
        exprs.append(F.count_if(F.col(c).cast("double") == 0).alias(f"zero_n_{c}"))
    agg = df.agg(*exprs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit("negative_where_unexpected").alias("type"),
                     F.col(f"neg_n_{c}").cast("long").alias("count"), R(F.col(f"neg_x_{c}")).alias("example"))
            for c in neg]
    rows += [F.struct(F.lit(c).alias("column"), F.lit("zero_where_suspicious").alias("type"),
                      F.col(f"zero_n_{c}").cast("long").alias("count"), F.lit(None).cast("double").alias("example"))
             for c in zer]
    return agg.select(F.explode(F.array(*rows)).alias("a")).select("a.*").where(F.col("count") > 0)


def _py_strip(col):
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def string_quality(df: DataFrame, cols: Sequence[str] | None = None, only_issues: bool = True) -> DataFrame:
    """Empty-after-strip, padded, and case variants per text column (nulls excluded)."""
    cols = list(cols) if cols is not None else text_columns(df, with_bool=False)
    long = long_form(df, cols, cast="string")
    per_val = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    a = per_val.groupBy("column").agg(
        F.sum(F.when(_py_strip(F.col("value")) == "", F.col("n")).otherwise(0)).cast("long").alias("n_empty"),
        F.sum(F.when(F.col("value") != _py_strip(F.col("value")), F.col("n")).otherwise(0)).cast("long").alias("n_padded"),
        F.count(F.lit(1)).alias("unique_as_typed"))
    low = per_val.groupBy("column", F.lower("value").alias("lv")).agg(F.count(F.lit(1)).alias("_k"))
    b = low.groupBy("column").agg(F.count(F.lit(1)).alias("unique_lowercased"))
    j = a.join(F.broadcast(b), "column").select(
        "column", "n_empty", "n_padded", "unique_as_typed", "unique_lowercased",
        (F.col("unique_as_typed") - F.col("unique_lowercased")).alias("extra_variants"))
    if only_issues:
        j = j.where((F.col("n_empty") > 0) | (F.col("n_padded") > 0) | (F.col("extra_variants") > 0))
    return j


def anomaly_flags(df: DataFrame, order_by: Sequence[str] | None = None, as_of: str = "2024-01-15",
                  mixed_cols: Sequence[str] = ()) -> DataFrame:
    """Union of numeric anomalies, future dates, mixed columns and string-quality issues."""
    a = numeric_anomalies(df, order_by).select("column", "type", "count",
                                               F.col("example").cast("string").alias("detail"))
    d = date_profile(df, as_of=as_of).where(F.col("n_future_dates") > 0).select(
        "column", F.lit("future_dates").alias("type"), F.col("n_future_dates").alias("count"),
        F.lit(None).cast("string").alias("detail"))
    out = a.unionByName(d)
    if mixed_cols:
        m = df.sparkSession.createDataFrame([(c,) for c in mixed_cols], "column string").select(
            "column", F.lit("mixed_data_types").alias("type"), F.lit(None).cast("long").alias("count"),
            F.lit("Column contains values of multiple types").alias("detail"))
        out = out.unionByName(m)
    s = string_quality(df).select(
        "column", F.lit("string_quality_issues").alias("type"),
        (F.col("n_empty") + F.col("n_padded") + F.col("extra_variants")).alias("count"),
        F.concat_ws(";", F.concat(F.lit("empty="), F.col("n_empty")), F.concat(F.lit("padded="), F.col("n_padded")),
                    F.concat(F.lit("extra_variants="), F.col("extra_variants"))).alias("detail"))
    return out.unionByName(s)


# ---------------------------------------------------------------- A14, A15

def histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins over min..max (last bin closed), empty bins included; n >= 2."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    long = long_form(df, cols)
    rng = long.groupBy("column").agg(F.count("value").alias("n"), F.min("value").alias("mn"),
                                     F.max("value").alias("mx")).where(F.col("n") >= 2)
    rng = rng.select("column", F.when(F.col("mx") == F.col("mn"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                     F.when(F.col("mx") == F.col("mn"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    j = long.join(F.broadcast(rng), "column")
    b = F.least(F.floor((F.col("value") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))),
                F.lit(bins - 1)).cast("int")
    cnt = j.groupBy("column", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / bins
    out = grid.join(cnt, ["column", "bin"], "left")
    return out.select("column", "bin", R(F.col("lo") + F.col("bin") * step).alias("lo_edge"),
                      R(F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * step)).alias("hi_edge"),
                      F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def k2_frame(g: DataFrame, n: str = "n", g1: str = "g1", g2: str = "g2") -> DataFrame:
    """D'Agostino-Pearson K^2 from population skewness g1 and excess kurtosis g2.

    Built as staged projections so Catalyst keeps shared sub-terms as columns
    (one inlined expression would exceed the 64 KB codegen limit).
    """
    N = F.col(n)
    g = g.withColumns({
        "_y": F.col(g1) * F.sqrt((N + 1) * (N + 3) / (6.0 * (N - 2))),
        "_beta2": 3.0 * (N * N + 27 * N - 70) * (N + 1) * (N + 3) / ((N - 2) * (N + 5) * (N + 7) * (N + 9)),
        "_x": (F.col(g2) + 3 - 3.0 * (N - 1) / (N + 1))
        / F.sqrt(24.0 * N * (N - 2) * (N - 3) / ((N + 1) * (N + 1) * (N + 3) * (N + 5))),
        "_sb": 6.0 * (N * N - 5 * N + 2) / ((N + 7) * (N + 9)) * F.sqrt(6.0 * (N + 3) * (N + 5) / (N * (N - 2) * (N - 3))),
    })
    g = g.withColumns({"_w2": -1 + F.sqrt(2 * (F.col("_beta2") - 1)),
                       "_a": 6.0 + 8.0 / F.col("_sb") * (2.0 / F.col("_sb") + F.sqrt(1 + 4.0 / (F.col("_sb") * F.col("_sb"))))})
    g = g.withColumns({"_delta": 1 / F.sqrt(0.5 * F.log(F.col("_w2"))), "_alpha": F.sqrt(2.0 / (F.col("_w2") - 1)),
                       "_inner": (1 - 2 / F.col("_a")) / (1 + F.col("_x") * F.sqrt(2 / (F.col("_a") - 4.0)))})
    ya = F.col("_y") / F.col("_alpha")
    g = g.withColumns({
        "_z1": F.when(F.col("_y") == 0, F.lit(0.0)).otherwise(F.col("_delta") * F.log(ya + F.sqrt(ya * ya + 1))),
        "_z2": (1 - 2 / (9.0 * F.col("_a")) - F.signum("_inner") * F.pow(F.abs("_inner"), 1 / 3.0))
        / F.sqrt(2 / (9.0 * F.col("_a")))})
    g = g.withColumn("k2", F.col("_z1") * F.col("_z1") + F.col("_z2") * F.col("_z2"))
    return g.drop("_y", "_beta2", "_x", "_sb", "_w2", "_a", "_delta", "_alpha", "_inner", "_z1", "_z2")


def normality_k2(df: DataFrame, cols: Sequence[str] | None = None, min_n: int = 20, alpha: float = 0.05) -> DataFrame:
    """D'Agostino-Pearson K^2, p = exp(-K^2 / 2), verdict at alpha."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    long = long_form(df, cols)
    g = long.groupBy("column").agg(F.count("value").cast("double").alias("n"),
                                   F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"))
    g = k2_frame(g).withColumn("k2", F.when(F.col("n") >= min_n, F.col("k2")))
    k2 = F.col("k2")
    p = F.exp(-k2 / 2)
    return g.select("column", F.col("n").cast("long").alias("n"), R(k2).alias("k2"), R(p).alias("normality_p"),
                    F.when(k2.isNull(), "untested").when(p > alpha, "normal").otherwise("non-normal").alias("normality_verdict"))


# ---------------------------------------------------------------- A17-A19, A26

def value_counts(df: DataFrame, cols: Sequence[str], keep_null: bool = True) -> DataFrame:
    """(column, value, n) over text-cast columns; null kept as a value when asked."""
    long = long_form(df, cols, cast="string", drop_null=not keep_null)
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def category_frequencies(df: DataFrame, cols: Sequence[str] | None = None, k: int = MAX_CAT_FREQ_SHOW) -> DataFrame:
    """Top k values per text/boolean column with count and pct (null is a value); ties by value."""
    cols = list(cols) if cols is not None else text_columns(df)
    vc = value_counts(df, cols)
    tot = vc.groupBy("column").agg(F.sum("n").alias("_tot"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    top = vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(F.broadcast(tot), "column").select(
        "column", F.col("rank").cast("long").alias("rank"), "value", F.col("n").alias("count"),
        F.round(F.col("n") / F.col("_tot") * 100, 2).alias("pct"))


def category_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct (no nulls), mode and its pct, natural-log entropy (null counted)."""
    cols = list(cols) if cols is not None else text_columns(df)
    vc = value_counts(df, cols)
    ln = F.log(F.col("n").cast("double"))
    g = vc.groupBy("column").agg(
        F.count("value").alias("n_unique"), F.sum("n").alias("_tot"),
        F.sum(F.col("n") * ln).alias("_nlogn"), F.max("n").alias("_mode_n"))
    mode = (vc.join(F.broadcast(g.select("column", "_mode_n")), "column").where(F.col("n") == F.col("_mode_n"))
            .groupBy("column").agg(F.min("value").alias("mode")))
    ent = F.log(F.col("_tot").cast("double")) - F.col("_nlogn") / F.col("_tot")
    return g.join(F.broadcast(mode), "column", "left").select(
        "column", "n_unique", "mode", F.round(F.col("_mode_n") / F.col("_tot") * 100, 2).alias("mode_pct"),
        R(ent).alias("entropy"))


def category_entropy(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """-sum(p ln p) of value counts, null included."""
    return category_summary(df, cols).select("column", "entropy")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency table in long form (nulls dropped, as pandas does)."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(F.col(a).cast("string").alias("a_value"), F.col(b).cast("string").alias("b_value"))
            .agg(F.count(F.lit(1)).alias("n")))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct non-null values per column, exactly: ``column``, ``n_unique`` (columns without values have no row).

    One scan; a cell is shuffled as two 64-bit hashes of its typed value (a column number and 16 bytes whatever the
    value's length), of which a task sends each distinct one once.
    """
    cols = list(cols) if cols is not None else df.columns
    cells = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("i"), F.xxhash64(F.col(c)).alias("h1"), F.xxhash64(F.lit(i + 1), F.col(c)).alias("h2")))
                      for i, c in enumerate(cols)])
    seen = df.select(F.explode(cells).alias("c")).where(F.col("c").isNotNull()).select("c.*").distinct()
    names = F.array(*[F.lit(c) for c in cols])
    return seen.groupBy("i").agg(F.count(F.lit(1)).alias("n_unique")).select(F.get(names, F.col("i")).alias("column"), "n_unique")


#: log2 of the registers of a sketch: relative standard error about 1.04 / sqrt(2^12) = 1.6 %.
SKETCH_K = 12


def distinct_sketches(df: DataFrame, cols: Sequence[str] | None = None, lg_k: int = SKETCH_K) -> DataFrame:
    """A26 as mergeable sketches: ``column``, ``sketch`` (binary; store and merge them across runs). One scan, one row a task."""
    cols = list(cols) if cols is not None else df.columns
    agg = df.agg(*[F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c))), F.lit(lg_k)).alias(c) for c in cols])
    return agg.unpivot([], cols, "column", "sketch")


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of several runs or parts, merged per column."""
    return sketches.groupBy("column").agg(F.hll_union_agg("sketch").alias("sketch"))


def sketch_counts(sketches: DataFrame) -> DataFrame:
    """``column``, ``n_unique`` as the sketches estimate it."""
    return sketches.select("column", F.hll_sketch_estimate("sketch").alias("n_unique"))


# ---------------------------------------------------------------- A20-A23

def monthly_trend(df: DataFrame, date_col: str, num_cols: Sequence[str] | None = None, max_cols: int | None = None) -> DataFrame:
    """Month x numeric columns (the first ``max_cols`` if given): avg, total, n."""
    nums = first_n(num_cols if num_cols is not None else numeric_columns(df), max_cols)
    t = F.col(date_col).cast("string").try_cast("timestamp")
    base = df.select(F.date_format(t, "yyyy-MM").alias("month"), *[F.col(c) for c in nums]).where(F.col("month").isNotNull())
    long = long_form(base, nums, ids=["month"], drop_null=False)
    return long.groupBy("month", "column").agg(
        R(F.avg("value")).alias("avg"), R(F.coalesce(F.sum("value"), F.lit(0.0))).alias("total"),
        F.count("value").alias("n")).select(F.lit(date_col).alias("date_column"), "month", "column", "avg", "total", "n")


def kpi_columns(cols: Sequence[str], keywords: Sequence[str] = KPI_KEYWORDS, k: int | None = None) -> list[str]:
    """Numeric names with a KPI keyword, else all (the first k if given)."""
    return first_n([c for c in cols if _name_has(c, keywords)] or list(cols), k)


def monthly_cohorts(df: DataFrame, date_col: str | None = None, kpi: Sequence[str] | None = None) -> DataFrame:
    """Per month n rows and mean / total of the KPI columns (wide)."""
    date_col = date_col or date_columns(df)[0]
    kpi = list(kpi) if kpi is not None else kpi_columns(numeric_columns(df))
    t = F.col(date_col).cast("string").try_cast("timestamp")
    base = df.select(F.date_format(t, "yyyy-MM").alias("period"), *kpi).where(F.col("period").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in kpi:
        aggs += [R(F.avg(c)).alias(f"{c}_mean"), R(F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0))).alias(f"{c}_total")]
    return base.groupBy("period").agg(*aggs)


def segment_profile(df: DataFrame, seg_cols: Sequence[str] | None = None, num_cols: Sequence[str] | None = None,
                    max_num: int | None = None, max_groups: int = SEGMENT_MAX_GROUPS) -> DataFrame:
    """Per level of each 2..10-level column: n, pct, mean/median/std/min/max of the numerics (the first ``max_num`` if given)."""
    seg = list(seg_cols) if seg_cols is not None else text_columns(df)
    nums = first_n(num_cols if num_cols is not None else numeric_columns(df), max_num)
    card = {r["column"]: r["n_unique"] for r in distinct_counts(df, seg).collect()}
    seg = [c for c in seg if 2 <= card.get(c, 0) <= max_groups]
    if not seg or not nums:
        return df.sparkSession.createDataFrame(
            [], "segment_column string, level string, n long, pct double, column string, mean double, "
                "median double, std double, min double, max double")
    # (row, segment column, level) for every qualifying segment column
    segd = df.select(F.explode(F.array(*[F.struct(F.lit(s).alias("segment_column"), F.col(s).cast("string").alias("level"))
                                         for s in seg])).alias("s"), *[F.col(c) for c in nums]) \
        .select("s.*", *nums)
    # level sizes incl. the null level, so the per-column total is the row count (<= 11 rows per column)
    sizes = segd.groupBy("segment_column", "level").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy("segment_column"))
    sizes = sizes.select("segment_column", "level", "n", F.round(F.col("n") / tot * 100, 2).alias("pct")) \
        .where(F.col("level").isNotNull())
    segd = segd.where(F.col("level").isNotNull())
    long = long_form(segd, nums, ids=["segment_column", "level"])
    by = ["segment_column", "level", "column"]
    mom = long.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                F.min("value").alias("min"), F.max("value").alias("max"))
    med = quantile_table(long, [0.5], by=by)
    j = mom.join(med, by).join(F.broadcast(sizes), ["segment_column", "level"])
    return j.select("segment_column", "level", "n", "pct", "column", R("mean").alias("mean"),
                    R(F.col("q")[0]).alias("median"), R("std").alias("std"), R("min").alias("min"), R("max").alias("max"))


def kpi_summary(df: DataFrame, cols: Sequence[str] | None = None, keywords: Sequence[str] = KPI_KEYWORDS) -> DataFrame:
    """is_likely_kpi, total, mean, median, count, pct_nonzero per numeric column."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    long = long_form(df, cols)
    g = long.groupBy("column").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"),
                                   F.count("value").alias("count"), F.count_if(F.col("value") != 0).alias("_nz"))
    q = quantile_table(long, [0.5])
    kpi = [c for c in cols if _name_has(c, keywords)]
    return g.join(F.broadcast(q), "column").select(
        "column", F.col("column").isin(kpi).alias("is_likely_kpi"), R("total").alias("total"), R("mean").alias("mean"),
        R(F.col("q")[0]).alias("median"), "count",
        F.when(F.col("count") > 0, F.round(F.col("_nz") / F.col("count") * 100, 2)).alias("pct_nonzero"))


# ---------------------------------------------------------------- A24, A25

def quality_score(df: DataFrame, order_by: Sequence[str] | None = None, as_of: str = "2024-01-15") -> DataFrame:
    """Penalty score from the other quality sections, with a label.

    Each section is a one-row aggregate; they are unioned as (key, value) rows and
    folded by one aggregate, so no section is joined to another.
    """
    from .schema import cardinality_audit, dtype_audit
    parts = [
        missing_summary(df).select(F.lit("miss").alias("k"), F.col("total_missing_pct").cast("double").alias("v")),
        duplicate_summary(df).select(F.lit("dup").alias("k"), F.col("duplicate_rows_pct").cast("double").alias("v")),
        cardinality_audit(df).agg(F.count_if(F.col("tag") == "constant").cast("double").alias("v")).select(F.lit("const").alias("k"), "v"),
        outliers_by_column(df).agg(F.count_if(F.col("severity") == "high").cast("double").alias("v")).select(F.lit("out").alias("k"), "v"),
        dtype_audit(df).agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit("dtype").alias("k"), "v"),
        anomaly_flags(df, order_by, as_of).agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit("anom").alias("k"), "v"),
        string_quality(df).agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit("strq").alias("k"), "v"),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    g = u.agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))), F.lit(0.0)).alias(k)
                for k in ("miss", "dup", "const", "out", "dtype", "anom", "strq")])
    score = (F.lit(100.0) - F.least(F.lit(30.0), F.col("miss") * 2) - F.least(F.lit(15.0), F.col("dup") * 3)
             - F.col("const") * 3 - F.least(F.lit(20.0), F.col("out") * 4) - F.least(F.lit(10.0), F.col("dtype") * 2)
             - F.least(F.lit(10.0), F.col("anom") * 2) - F.least(F.lit(5.0), F.col("strq") * 1))
    s = F.round(F.greatest(F.lit(0.0), score), 1)
    return g.select(s.alias("quality_score"),
                    F.when(s >= 85, "Excellent").when(s >= 70, "Good").when(s >= 50, "Fair").otherwise("Poor").alias("quality_label"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Class counts, pct and the majority / minority ratio (class table is bounded by the class count)."""
    g = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return g.select("class", "n", F.round(F.col("n") / F.sum("n").over(w) * 100, 2).alias("pct"),
                    R(F.max("n").over(w) / F.min("n").over(w)).alias("imbalance_ratio"))
