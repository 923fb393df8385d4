"""Feature construction.

Statistics a feature needs (median, quantile edges, fences, mean/sd, max) are
one-row aggregates attached as scalar subqueries: Spark evaluates them once and
ships the value to every task, so no row-level join or cross join is needed.
Per-level statistics (ordinal codes, target encoding) are equi-joins on the level.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import c as _c
from ..functions.scalar import div
from .common import numeric_columns, sample_skew, text_columns
from .quantiles import quantile_scalars

EPS = 1e-8  # Fixed value: epsilon of the ratio and log features.


def stats_scalar(df: DataFrame, **aggs: Column) -> Column:
    """One scalar subquery holding a struct of aggregates; fields via ``s[name]``."""
    return df.agg(F.struct(*[v.alias(k) for k, v in aggs.items()]).alias("_s")).scalar()


# ---------------------------------------------------------------- P1-P11 arithmetic

def feature_product(a, b) -> Column:
    """A * b."""
    return _c(a).cast("double") * _c(b).cast("double")


def feature_difference(a, b) -> Column:
    """A - b."""
    return _c(a).cast("double") - _c(b).cast("double")


def ratio_eps(a, b, eps: float = EPS) -> Column:
    """A / (b + 1e-8)."""
    return div(_c(a), _c(b).cast("double") + F.lit(eps))


def ratio_zero_safe(a, b) -> Column:
    """A / b with a zero divisor replaced by 1."""
    b = _c(b).cast("double")
    return div(_c(a), F.when(b == 0, F.lit(1.0)).otherwise(b))


def ratio_zero_median(df: DataFrame, a: str, b: str) -> Column:
    """P5: a / b with a zero divisor replaced by the median of b."""
    med = quantile_scalars(df, [b], [0.5])["c0"][0]
    bb = F.col(b).cast("double")
    return div(F.col(a), F.when(bb == 0, med).otherwise(bb))


def log_eps(x, eps: float = EPS) -> Column:
    """ln(x + 1e-8); non-positive arguments give NULL."""
    v = _c(x).cast("double") + F.lit(eps)
    return F.when(v > 0, F.log(v))


def column_skews(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Sample skewness per column: one aggregate, k numbers to the driver (schema-bounded)."""
    if not cols:
        return {}
    exprs = []
    for c in cols:
        v = F.col(c).cast("double")
        n = F.count(v).cast("double")
        exprs.append(sample_skew(F.skewness(v), n, F.var_pop(v)).alias(c))
    row = df.agg(*exprs).first()
    return {c: row[c] for c in cols}


def log1p_skewed(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 1.0,
                 exclude: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """log1p(max(x, 0)) for each numeric column with skew > threshold (in place)."""
    cols = list(cols) if cols is not None else numeric_columns(df, exclude)
    sk = column_skews(df, cols)
    hit = [c for c in cols if sk.get(c) is not None and sk[c] > threshold]
    return df.withColumns({c: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in hit}), hit


def log1p_target(y) -> Column:
    """log1p(y); inverse is ``expm1``."""
    return F.log1p(_c(y).cast("double"))


def reflect_log_target(df: DataFrame, y: str) -> tuple[Column, Column]:
    """log1p(max + 1 - y), and the scalar ``max + 1`` for the inverse ``m - expm1(p)``."""
    m = stats_scalar(df, m=F.max(F.col(y).cast("double")) + 1)["m"]
    return F.log1p(m - F.col(y).cast("double")), m


def target_transform(df: DataFrame, y: str, threshold: float = 0.75) -> tuple[DataFrame, str]:
    """P8/P9 rule: right skew -> log1p, left skew -> reflected log, else unchanged."""
    s = column_skews(df, [y]).get(y)
    if s is not None and s > threshold:
        return df.withColumn(y, log1p_target(y)), "log1p"
    if s is not None and s < -threshold:
        col, _ = reflect_log_target(df, y)
        return df.withColumn(y, col), "reflect_log"
    return df, "none"


def linear_balance(terms: Sequence[tuple[float, str]]) -> Column:
    """P10: signed sum, e.g. [(1, 'pr'), (-1, 'evspsbl'), (-1, 'mrros')]."""
    out = None
    for w, c in terms:
        t = F.lit(float(w)) * F.col(c).cast("double")
        out = t if out is None else out + t
    return out


def residual_feature(target: str, a: str, b: str) -> Column:
    """Target - (a - b) (target-derived: flag it as leaky for modelling)."""
    return F.col(target).cast("double") - (F.col(a).cast("double") - F.col(b).cast("double"))


# ---------------------------------------------------------------- P12-P16 bins and clipping

def quantile_edges(df: DataFrame, x: str, q: int) -> Column:
    """Distinct linear quantile edges [0, 1/q, ..., 1] as a scalar array."""
    probs = [i / q for i in range(q + 1)]
    return F.array_distinct(quantile_scalars(df, [x], probs)["c0"])


def quantile_bin(df: DataFrame, x: str, q: int) -> Column:
    """Pandas qcut(duplicates='drop') code: right-closed bins, lowest edge included."""
    edges = quantile_edges(df, x, q)
    v = F.col(x).cast("double")
    # at most q + 1 edges: count those below v (unrolled; higher-order functions cannot hold a subquery)
    below = sum((F.coalesce((F.get(edges, i) < v).cast("int"), F.lit(0)) for i in range(q + 1)), F.lit(0))
    return F.when(v.isNotNull(), F.greatest(below - 1, F.lit(0))).cast("long")


# Quantile label sets.
LABELS_Q4 = ["low", "mid", "high", "very_high"]
LABELS_Q5 = ["xs", "s", "m", "l", "xl"]


def quantile_label(df: DataFrame, x: str, labels: Sequence[str] = LABELS_Q4) -> Column:
    """Quantile bin with labels (q = number of labels)."""
    code = quantile_bin(df, x, len(labels))
    return F.element_at(F.array(*[F.lit(s) for s in labels]), (code + 1).cast("int"))


def equal_width_bin(df: DataFrame, x: str, q: int) -> Column:
    """Q equal-width, right-closed bins over min..max (lowest value in bin 0)."""
    s = stats_scalar(df, lo=F.min(F.col(x).cast("double")), hi=F.max(F.col(x).cast("double")))
    v = F.col(x).cast("double")
    w = (s["hi"] - s["lo"]) / q
    code = F.ceil((v - s["lo"]) / w).cast("int") - 1
    return F.when(v.isNotNull(), F.when(w == 0, F.lit(0)).otherwise(F.least(F.greatest(code, F.lit(0)), F.lit(q - 1))))


def cap_iqr(fit_df: DataFrame, x: str, k: float = 3.0) -> Column:
    """Clip to [q1 - k*iqr, q3 + k*iqr] when iqr > 0 (fences fitted on ``fit_df``)."""
    q = quantile_scalars(fit_df, [x], [0.25, 0.75])["c0"]
    q1, q3 = q[0], q[1]
    iqr = q3 - q1
    v = F.col(x).cast("double")
    return F.when(iqr > 0, F.least(F.greatest(v, q1 - k * iqr), q3 + k * iqr)).otherwise(v)


def winsorize(fit_df: DataFrame, x: str, lower: float = 0.01, upper: float = 0.99) -> Column:
    """Clip at the 1st / 99th linear percentiles (fitted on ``fit_df``)."""
    q = quantile_scalars(fit_df, [x], [lower, upper])["c0"]
    return F.least(F.greatest(F.col(x).cast("double"), q[0]), q[1])


# ---------------------------------------------------------------- P17-P24 imputation and encoding

def impute_median(fit_df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Numeric nulls -> exact median of the fit rows."""
    s = quantile_scalars(fit_df, cols, [0.5])
    return {c: F.coalesce(F.col(c).cast("double"), s[f"c{i}"][0]) for i, c in enumerate(cols)}


def mode_value(fit_df: DataFrame, col: str) -> Column:
    """Most frequent non-null value, ties to the smallest: a distributed count, then a bounded fold."""
    vc = fit_df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    top = vc.agg(F.max("n").alias("m"))
    return vc.where(F.col("n") == top.scalar()).agg(F.min("v")).scalar()


def impute_mode(fit_df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """Categorical nulls -> mode (ties to the smallest)."""
    return {c: F.coalesce(F.col(c), mode_value(fit_df, c)) for c in cols}


def impute_constant(df: DataFrame, text_fill: str = "Unknown", num_fill: float = 0.0) -> DataFrame:
    """Text nulls -> 'Unknown', numeric nulls -> 0."""
    return df.fillna(text_fill, subset=text_columns(df, with_bool=False)).fillna(num_fill, subset=numeric_columns(df))


def _safe_suffix(v) -> str:
    return re.sub(r"[^A-Za-z0-9_]+", "_", str(v))


def category_levels(fit_df: DataFrame, col: str, max_levels: int = 15) -> list:
    """Sorted distinct levels, bounded: fails loudly above ``max_levels`` (one-hot needs a column per level)."""
    lv = fit_df.where(F.col(col).isNotNull()).select(col).distinct().limit(max_levels + 1).collect()
    if len(lv) > max_levels:
        raise ValueError(f"{col}: more than {max_levels} levels; use ordinal_encode or target_encode_loo")
    return sorted(r[0] for r in lv)


def one_hot(col: str, levels: Sequence, drop_first: bool = False) -> dict[str, Column]:
    """One 0/1 column per seen level; unseen values are all zero."""
    levels = list(levels)[1:] if drop_first else list(levels)
    return {f"{col}_{_safe_suffix(v)}": (F.col(col) == F.lit(v)).cast("int") if v is not None else F.lit(0)
            for v in levels}


def one_hot_frame(df: DataFrame, col: str, fit_df: DataFrame | None = None, max_levels: int = 15,
                  drop_first: bool = False) -> DataFrame:
    return df.withColumns({k: F.coalesce(v, F.lit(0)) for k, v in
                           one_hot(col, category_levels(fit_df or df, col, max_levels), drop_first).items()})


def one_hot_dictionary(fit_df: DataFrame, cols: Sequence[str], drop_first: bool = False) -> DataFrame:
    """P20 / P21 fit: (column, level, index) of all levels of ``cols`` as text, indexed 0.. in order of column and level.

    Any number of levels: they are sorted over range partitions. ``drop_first`` leaves out each column's least level.
    Nulls are no level.
    """
    from .window import global_row_index
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols])
    levels = fit_df.select(F.explode(cells).alias("c")).select("c.*").where(F.col("level").isNotNull()).distinct()
    if drop_first:
        first = levels.groupBy("column").agg(F.min("level").alias("level"))
        levels = levels.join(F.broadcast(first), ["column", "level"], "left_anti")  # one row per column
    return global_row_index(levels, ["column", "level"], out="index")


def one_hot_sparse(df: DataFrame, dictionary: DataFrame, cols: Sequence[str], out: str = "one_hot") -> DataFrame:
    """P20 / P21 with any number of levels: ``out`` = struct(size, indices, values), the ones of the row's levels.

    Levels find their index by a hash join with the ``dictionary``; null and unseen levels have no entry. A level of many
    rows is one side's skew, which the adaptive join splits. ``one_hot_frame`` is the dense form.
    """
    size = dictionary.agg(F.count(F.lit(1))).scalar()
    x, found = df, []
    for i, c in enumerate(cols):
        lv = dictionary.where(F.col("column") == c).select(F.col("level").alias(f"_level{i}"), F.col("index").alias(f"_index{i}"))
        x = x.join(lv, x[c].cast("string") == lv[f"_level{i}"], "left")
        found.append(F.col(f"_index{i}"))
    indices = F.array_sort(F.filter(F.array(*found), lambda v: v.isNotNull()))
    sparse = F.struct(size.alias("size"), indices.alias("indices"), F.transform(indices, lambda _: F.lit(1.0)).alias("values"))
    return x.select(*[df[c] for c in df.columns], sparse.alias(out))


def ordinal_levels(fit_df: DataFrame, col: str) -> DataFrame:
    """(level, code) with code = 0..k-1 in sorted order, computed by a global prefix scan (no one-task window)."""
    from .window import global_row_index
    lv = fit_df.where(F.col(col).isNotNull()).select(F.col(col).alias("_level")).distinct()
    return global_row_index(lv, ["_level"], out="_code")


def ordinal_encode(df: DataFrame, col: str, fit_df: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Sorted level -> 0..k-1, unseen -> -1 (left equi-join on the level)."""
    lv = ordinal_levels(fit_df or df, col)
    j = df.join(lv, df[col] == lv["_level"], "left")
    return j.withColumn(out or col, F.coalesce(F.col("_code"), F.lit(-1)).cast("long")).drop("_level", "_code")


def standard_scale(fit_df: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    """(x - mean) / population sd of the fit rows (sd 0 -> NULL)."""
    aggs = {}
    for i, c in enumerate(cols):
        aggs[f"m{i}"] = F.avg(F.col(c).cast("double"))
        aggs[f"s{i}"] = F.stddev_pop(F.col(c).cast("double"))
    s = stats_scalar(fit_df, **aggs)
    return {c: div(F.col(c).cast("double") - s[f"m{i}"], s[f"s{i}"]) for i, c in enumerate(cols)}


def target_encode_loo(df: DataFrame, col: str, target: str, out: str | None = None) -> DataFrame:
    """Leave-one-out target mean per level: (sum - y) / (n - 1); singletons and nulls -> global mean.

    Level sums are an aggregate joined back on the level (AQE splits a hot level).
    """
    y = F.col(target).cast("double")
    g = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_lvl")).agg(
        F.sum(y).alias("_s"), F.count(y).alias("_n"))
    gm = stats_scalar(df, m=F.avg(y))["m"]
    j = df.join(g, df[col] == g["_lvl"], "left")
    loo = F.when((F.col("_n") > 1) & y.isNotNull(), (F.col("_s") - y) / (F.col("_n") - 1)) \
        .when(F.col("_n") > 0, F.col("_s") / F.col("_n"))
    return j.withColumn(out or f"{col}_te", F.coalesce(loo, gm)).drop("_lvl", "_s", "_n")


# ---------------------------------------------------------------- P25-P31

def cyclical_date(col: str) -> dict[str, Column]:
    """P25: year, month and day-of-week on the unit circle (Monday = 0), weekend flag."""
    t = F.col(col).cast("timestamp")
    m = F.month(t).cast("double")
    d = F.weekday(t).cast("double")
    tau = 2 * math.pi
    return {f"{col}_year": F.year(t).cast("long"), f"{col}_month_sin": F.sin(F.lit(tau) * m / 12),
            f"{col}_month_cos": F.cos(F.lit(tau) * m / 12), f"{col}_dow_sin": F.sin(F.lit(tau) * d / 7),
            f"{col}_dow_cos": F.cos(F.lit(tau) * d / 7), f"{col}_is_weekend": (F.weekday(t) >= 5).cast("int")}


# Text read as "yes".
YES_VALUES = ["yes", "true", "1", "y"]


def yes_no_flag(x) -> Column:
    """lower(value) in yes/true/1/y -> 1 else 0."""
    return F.coalesce(F.lower(_c(x).cast("string")).isin(*YES_VALUES), F.lit(False)).cast("int")


def flag_score(df: DataFrame, flags: Sequence[str], min_flags: int = 3) -> Column | None:
    """Row sum of flags (text flags via P26) when there are at least 3."""
    if len(flags) < min_flags:
        return None
    types = dict(df.dtypes)
    out = None
    for f in flags:
        t = yes_no_flag(f) if types[f] == "string" else F.coalesce(F.col(f).cast("int"), F.lit(0))
        out = t if out is None else out + t
    return out


def pairwise_interactions(cols: Sequence[str]) -> dict[str, Column]:
    """Every x_i * x_j with i < j, no squares."""
    cols = list(cols)
    return {f"{a}_x_{b}": F.col(a).cast("double") * F.col(b).cast("double")
            for i, a in enumerate(cols) for b in cols[i + 1:]}


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P29."""
    return df.drop(*cols)


def drop_duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Exact duplicates removed."""
    return df.dropDuplicates(list(subset) if subset else None)


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Listwise deletion over ``subset``."""
    return df.dropna(subset=list(subset) if subset else None)


# ---------------------------------------------------------------- P40

def apply_feature_spec(df: DataFrame, spec: Sequence[tuple[str, str]]) -> DataFrame:
    """Ordered (name, SQL expression) list; later ones may use earlier ones; repeats overwrite."""
    for name, e in spec:
        df = df.withColumn(name, F.expr(e))
    return df
