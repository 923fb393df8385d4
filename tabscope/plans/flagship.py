"""Flagship composition: the full numeric profile of a table (A1 + A8 + A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile as P
from .tables import t


def table_profile(df: DataFrame, cols=None) -> DataFrame:
    """One row per numeric column: descriptive stats, outlier counts and missing counts.

    All three inputs are one row per column (schema-bounded), so the joins are
    broadcasts of tiny tables; the row-level work is three aggregates over the long form.
    """
    d = P.describe_numeric(df, cols)
    o = P.outliers_by_column(df, cols, only_flagged=False).select(
        "column", "iqr_outliers", "zscore_outliers", "extreme_outliers", "lower_fence", "upper_fence",
        F.col("severity").alias("outlier_severity"))
    m = P.missing_by_column(df, cols, only_missing=False).select(
        "column", F.col("count").alias("n_missing"), F.col("pct").alias("missing_pct"))
    return d.join(F.broadcast(o), "column", "left").join(F.broadcast(m), "column", "left")


def lineitem_profile(spark: SparkSession, sf: str) -> DataFrame:
    return table_profile(t(spark, sf, "lineitem"))
