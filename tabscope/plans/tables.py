"""Driver tables and rule-derived variants used by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return load(spark, sf, name)


def events_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Events with nulls made by rule (the driver's tables have none)."""
    e = load(spark, sf, "events")
    eid = F.col("event_id")
    return e.select(
        "event_id", "ts",
        F.when(eid % 11 == 0, F.lit(None)).otherwise(F.col("user_id")).cast("long").alias("user_id"),
        F.when(eid % 13 == 0, F.lit(None)).otherwise(F.col("event_type")).cast("string").alias("event_type"),
        F.when(eid % 7 == 0, F.lit(None)).otherwise(F.col("value")).cast("double").alias("value"),
        F.when((eid % 7 == 0) & (eid % 2 == 0), F.lit(None)).otherwise(F.col("props")).cast("string").alias("props"))


# Line items with outliers, negative and zero values made by rule (the driver's tables have none); both engines.
_SPIKES = {"l_quantity": "CASE WHEN l_orderkey % 89 = 0 THEN -l_quantity WHEN l_orderkey % 31 = 0 THEN l_quantity * 40 ELSE l_quantity END",
           "l_extendedprice": "CASE WHEN l_orderkey % 83 = 0 THEN 0.0 WHEN l_orderkey % 7 = 0 THEN l_extendedprice * 25 ELSE l_extendedprice END",
           "l_tax": "CASE WHEN l_orderkey % 23 = 0 THEN l_tax + 3 ELSE l_tax END"}
_SPIKED = ", ".join(f"{_SPIKES[c]} AS {c}" if c in _SPIKES else c for c in (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate"))
SPIKED_SQL = f"(SELECT {_SPIKED} FROM lineitem)"


def spiked(spark: SparkSession, sf: str) -> DataFrame:
    load(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(f"SELECT {_SPIKED} FROM lineitem")
