"""Registered window queries (W1-W8, prefix scan) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import safe_round as R
from ..operators import window as W
from .catalog import register
from .sqlgen import r6
from .tables import t

ORD = ["ts", "event_id"]
SPECS = {"mean3": ("mean", "value", 3), "mean7": ("mean", "value", 7), "sum5": ("sum", "value", 5),
         "sum7": ("sum", "value", 7), "std5": ("std", "value", 5), "diff1": ("diff", "value", 2)}


def _win_sql(part: str) -> str:
    p = f"PARTITION BY {part} " if part else ""
    w = lambda n: f"OVER ({p}ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""SELECT event_id, {r6('avg(value) ' + w(3))} AS mean3, {r6('avg(value) ' + w(7))} AS mean7,
  {r6('sum(value) ' + w(5))} AS sum5, {r6('sum(value) ' + w(7))} AS sum7,
  {r6('coalesce(stddev_samp(value) ' + w(5) + ', 0.0)')} AS std5,
  {r6(f'coalesce(value - lag(value) OVER ({p}ORDER BY ts, event_id), 0.0)')} AS diff1 FROM events"""


def _rolling(spark, sf, part, skew_safe=None):
    e = t(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    out = W.rolling(e, SPECS, ORD, part, skew_safe=skew_safe)
    return out.select("event_id", *[R(k).alias(k) for k in SPECS])


register("rolling_by_user", _win_sql("user_id"))(lambda spark, sf: _rolling(spark, sf, ["user_id"]))
register("rolling_global", _win_sql(""))(lambda spark, sf: _rolling(spark, sf, []))
register("rolling_by_user_skew_safe", _win_sql("user_id"))(lambda spark, sf: _rolling(spark, sf, ["user_id"], True))


def _one(kind, name, n):
    def q(spark, sf):
        e = t(spark, sf, "events").select("event_id", "ts", "user_id", "value")
        return W.rolling(e, {name: (kind, "value", n)}, ORD, ["user_id"]).select("event_id", R(name).alias(name))
    return q


def _one_sql(agg, name, n):
    return (f"SELECT event_id, {r6(f'{agg} OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)')} "
            f"AS {name} FROM events")


register("rolling_mean", _one_sql("avg(value)", "mean3", 3))(_one("mean", "mean3", 3))
register("rolling_sum", _one_sql("sum(value)", "sum5", 5))(_one("sum", "sum5", 5))
register("rolling_std", f"""SELECT event_id, {r6('coalesce(stddev_samp(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0.0)')} AS std5 FROM events""")(
    _one("std", "std5", 5))
register("diff", f"""SELECT event_id, {r6('coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0.0)')} AS diff1 FROM events""")(
    _one("diff", "diff1", 2))

register("cumulative_sum", f"""SELECT event_id, {r6('sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)')} AS cumsum,
  {r6('sum(value - 5.0) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)')} AS balance FROM events""")(
    lambda spark, sf: W.cumulative_sum(
        W.cumulative_sum(t(spark, sf, "events"), "value", ORD, ["user_id"], "cumsum"),
        F.col("value") - 5.0, ORD, ["user_id"], "balance").select("event_id", R("cumsum").alias("cumsum"), R("balance").alias("balance")))

register("prefix_scan", f"""SELECT {', '.join(['l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey'])},
  {r6('sum(l_quantity) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate ROWS UNBOUNDED PRECEDING)')} AS cum_qty
FROM lineitem""")(
    lambda spark, sf: W.cumulative_sum(t(spark, sf, "lineitem"), "l_quantity",
                                       ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                                        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"], out="cum_qty")
    .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R("cum_qty").alias("cum_qty")))

register("row_index", """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS user_row_index FROM events""")(
    lambda spark, sf: W.row_index(W.row_index(t(spark, sf, "events"), ORD), ORD, ["user_id"], "user_row_index")
    .select("event_id", "row_index", "user_row_index"))

register("average_rank", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {r6('rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0')} AS rank,
  {r6('rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0')} AS rank_in_flag
FROM lineitem""")(
    lambda spark, sf: W.average_rank(W.average_rank(t(spark, sf, "lineitem"), "l_quantity"), "l_quantity", ["l_returnflag"], "rank_in_flag")
    .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R("rank").alias("rank"), R("rank_in_flag").alias("rank_in_flag")))

register("group_share", """SELECT c_mktsegment, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct
FROM customer GROUP BY 1""")(lambda spark, sf: W.group_share(t(spark, sf, "customer"), ["c_mktsegment"]))
