"""Shared plan shapes: long (unpivoted) form, quantile profiles, column typing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in ex]


def text_columns(df: DataFrame, exclude: Iterable[str] = (), with_bool: bool = True) -> list[str]:
    ex = set(exclude)
    kinds = (T.StringType, T.BooleanType) if with_bool else (T.StringType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in ex]


def date_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TEMPORAL)]


def long_form(df: DataFrame, cols: Sequence[str], cast: str = "double", ids: Sequence[str] = (),
              drop_null: bool = True) -> DataFrame:
    """Unpivot once to (ids..., column, value) so one aggregate serves all columns."""
    cols = list(cols)
    if not cols:
        return df.select(*[F.col(i) for i in ids], F.lit(None).cast("string").alias("column"),
                         F.lit(None).cast(cast).alias("value")).where(F.lit(False))
    sel = [F.col(i) for i in ids] + [F.col(c).cast(cast).alias(c) for c in cols]
    out = df.select(*sel).unpivot(list(ids), cols, "column", "value")
    if drop_null:
        out = out.where(F.col("value").isNotNull())
    return out


def sample_skew(g1: Column, n: Column, m2: Column) -> Column:
    """Bias-corrected skewness from Spark's population g1 (pandas / DuckDB form)."""
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(m2 == 0, F.lit(0.0))
            .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def sample_kurt(g2: Column, n: Column, m2: Column) -> Column:
    """Bias-corrected excess kurtosis from Spark's population g2."""
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(m2 == 0, F.lit(0.0))
            .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))


def first_n(cols: Sequence[str], n: int | None) -> list[str]:
    cols = list(cols)
    return cols if n is None else cols[:n]


def safe_corr(a: Column, b: Column, a_full: bool = False, b_full: bool = False) -> Column:
    """Pearson r with pairwise deletion; NULL (not an ANSI error) when a side is constant. ``full`` sides are known to have no null."""
    a2 = a.cast("double") if b_full else F.when(b.isNotNull(), a.cast("double"))
    b2 = b.cast("double") if a_full else F.when(a.isNotNull(), b.cast("double"))
    return F.try_divide(F.covar_samp(a2, b2), F.stddev_samp(a2) * F.stddev_samp(b2))


def spread(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """The rows dealt by their keys to tasks of about ``rows`` rows, sorted by the keys there.

    For work that is heavy per row: a small file is read by one task, whatever its rows cost. The number of tasks
    follows the rows alone, so the same rows meet in a task on any cluster.
    """
    n = max(1, -(-df.count() // rows))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)
