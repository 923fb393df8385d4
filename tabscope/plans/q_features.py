"""Registered feature queries (P1-P40) with DuckDB oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalar as SC
from ..operators import features as FE
from .catalog import register
from .sqlgen import EVENTS_NULLS_SQL, r6
from .tables import events_nulls, t

R = SC.safe_round
LK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LKS = ", ".join(LK)


def _li(spark, sf):
    return t(spark, sf, "lineitem")


def _li_q(expr_fn, name):
    """Query over lineitem keys plus one expression (built lazily, inside the query)."""
    return lambda spark, sf: _li(spark, sf).select(*LK, R(expr_fn()).alias(name))


def _li_sql(expr_sql, name):
    return f"SELECT {LKS}, {r6(expr_sql)} AS {name} FROM lineitem"


register("feature_product", _li_sql("l_quantity * l_extendedprice", "qty_x_price"))(
    _li_q(lambda: FE.feature_product("l_quantity", "l_extendedprice"), "qty_x_price"))
register("feature_difference", _li_sql("l_quantity - l_discount", "qty_minus_disc"))(
    _li_q(lambda: FE.feature_difference("l_quantity", "l_discount"), "qty_minus_disc"))
register("ratio_eps", _li_sql("l_tax / (l_discount + 1e-8)", "tax_div_disc"))(
    _li_q(lambda: FE.ratio_eps("l_tax", "l_discount"), "tax_div_disc"))
register("ratio_zero_safe", _li_sql("l_tax / CASE WHEN l_discount = 0 THEN 1.0 ELSE l_discount END", "tax_div_disc"))(
    _li_q(lambda: FE.ratio_zero_safe("l_tax", "l_discount"), "tax_div_disc"))
register("ratio_zero_median", f"""SELECT {LKS}, {r6('l_tax / CASE WHEN l_discount = 0 THEN (SELECT quantile_cont(l_discount, 0.5) FROM lineitem) ELSE l_discount END')} AS tax_div_disc FROM lineitem""")(
    lambda spark, sf: _li(spark, sf).select(*LK, R(FE.ratio_zero_median(_li(spark, sf), "l_tax", "l_discount")).alias("tax_div_disc")))
register("log_eps", _li_sql("CASE WHEN l_discount + 1e-8 > 0 THEN ln(l_discount + 1e-8) END", "log_disc"))(
    _li_q(lambda: FE.log_eps("l_discount"), "log_disc"))


def _log1p_skewed(spark, sf):
    e = t(spark, sf, "events")
    out, _ = FE.log1p_skewed(e.select("event_id", "user_id", "value"), ["user_id", "value"])
    return out.select("event_id", R("user_id").alias("user_id"), R("value").alias("value"))


register("log1p_skewed", f"""WITH s AS (SELECT skewness(user_id) AS su, skewness(value) AS sv FROM events)
SELECT event_id, {r6('CASE WHEN su > 1 THEN ln(1 + greatest(user_id, 0.0)) ELSE user_id END')} AS user_id,
  {r6('CASE WHEN sv > 1 THEN ln(1 + greatest(value, 0.0)) ELSE value END')} AS value FROM events, s""")(_log1p_skewed)

register("log1p_target", f"SELECT o_orderkey, {r6('ln(1 + o_totalprice)')} AS y FROM orders")(
    lambda spark, sf: t(spark, sf, "orders").select("o_orderkey", R(FE.log1p_target("o_totalprice")).alias("y")))


def _reflect(spark, sf):
    o = t(spark, sf, "orders")
    col, m = FE.reflect_log_target(o, "o_totalprice")
    return o.select("o_orderkey", R(col).alias("y"), R(m - F.expm1(col)).alias("y_back"))


register("reflect_log_target", f"""WITH m AS (SELECT max(o_totalprice) + 1 AS m FROM orders)
SELECT o_orderkey, {r6('ln(1 + (m - o_totalprice))')} AS y, {r6('m - (exp(ln(1 + (m - o_totalprice))) - 1)')} AS y_back
FROM orders, m""")(_reflect)

register("linear_balance", _li_sql("l_quantity - l_discount - l_tax", "balance"))(
    _li_q(lambda: FE.linear_balance([(1, "l_quantity"), (-1, "l_discount"), (-1, "l_tax")]), "balance"))
register("residual_feature", _li_sql("l_extendedprice - (l_quantity - l_discount)", "resid"))(
    _li_q(lambda: FE.residual_feature("l_extendedprice", "l_quantity", "l_discount"), "resid"))


def _qbin_sql(table, key, x, q, labels=None):
    probs = ", ".join(repr(i / q) for i in range(q + 1))
    code = f"greatest(len(list_filter(e, lambda v: v < {x})) - 1, 0)"
    val = code if labels is None else f"[{', '.join(repr(s) for s in labels)}][{code} + 1]"
    return f"""WITH q AS (SELECT list_distinct(quantile_cont({x}, [{probs}])) AS e FROM {table})
SELECT {key}, CASE WHEN {x} IS NOT NULL THEN {val} END AS bin FROM {table}, q"""


register("quantile_bin", _qbin_sql("events", "event_id", "value", 4))(
    lambda spark, sf: t(spark, sf, "events").select("event_id", FE.quantile_bin(t(spark, sf, "events"), "value", 4).alias("bin")))

register("quantile_label", _qbin_sql("lineitem", LKS, "l_quantity", 5, FE.LABELS_Q5))(
    lambda spark, sf: _li(spark, sf).select(*LK, FE.quantile_label(_li(spark, sf), "l_quantity", FE.LABELS_Q5).alias("bin")))

register("equal_width_bin", """WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT event_id, CASE WHEN value IS NOT NULL THEN CASE WHEN (hi - lo) / 10 = 0 THEN 0
  ELSE least(greatest(CAST(ceil((value - lo) / ((hi - lo) / 10)) AS INTEGER) - 1, 0), 9) END END AS bin FROM events, s""")(
    lambda spark, sf: t(spark, sf, "events").select("event_id", FE.equal_width_bin(t(spark, sf, "events"), "value", 10).alias("bin")))

register("cap_iqr", f"""WITH s AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
SELECT {LKS}, {r6('CASE WHEN q3 - q1 > 0 THEN least(greatest(l_extendedprice, q1 - 3.0 * (q3 - q1)), q3 + 3.0 * (q3 - q1)) ELSE l_extendedprice END')} AS capped
FROM lineitem, s""")(
    lambda spark, sf: _li(spark, sf).select(*LK, R(FE.cap_iqr(_li(spark, sf), "l_extendedprice")).alias("capped")))

register("winsorize", f"""WITH s AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)
SELECT event_id, {r6('least(greatest(value, lo), hi)')} AS value FROM events, s""")(
    lambda spark, sf: t(spark, sf, "events").select("event_id", R(FE.winsorize(t(spark, sf, "events"), "value")).alias("value")))


def _impute_median(spark, sf):
    e = events_nulls(spark, sf)
    m = FE.impute_median(e, ["value", "user_id"])
    return e.select("event_id", R(m["value"]).alias("value"), R(m["user_id"]).alias("user_id"))


register("impute_median", f"""WITH s AS (SELECT quantile_cont(value, 0.5) AS mv, quantile_cont(user_id, 0.5) AS mu FROM {EVENTS_NULLS_SQL})
SELECT event_id, {r6('coalesce(value, mv)')} AS value, {r6('coalesce(user_id, mu)')} AS user_id FROM {EVENTS_NULLS_SQL}, s""")(_impute_median)


def _impute_mode(spark, sf):
    e = events_nulls(spark, sf)
    return e.select("event_id", FE.impute_mode(e, ["event_type"])["event_type"].alias("event_type"))


register("impute_mode", f"""WITH vc AS (SELECT event_type AS v, count(*) AS n FROM {EVENTS_NULLS_SQL} WHERE event_type IS NOT NULL GROUP BY 1),
 m AS (SELECT min(v) AS mode FROM vc WHERE n = (SELECT max(n) FROM vc))
SELECT event_id, coalesce(event_type, mode) AS event_type FROM {EVENTS_NULLS_SQL}, m""")(_impute_mode)


def _impute_const(spark, sf):
    e = FE.impute_constant(events_nulls(spark, sf))
    return e.select("event_id", "user_id", "event_type", R("value").alias("value"), "props")


register("impute_constant", f"""SELECT event_id, coalesce(user_id, 0) AS user_id, coalesce(event_type, 'Unknown') AS event_type,
  {r6('coalesce(value, 0.0)')} AS value, coalesce(props, 'Unknown') AS props FROM {EVENTS_NULLS_SQL}""")(_impute_const)


def _one_hot(spark, sf):
    o = t(spark, sf, "orders")
    return FE.one_hot_frame(o.select("o_orderkey", "o_orderstatus"), "o_orderstatus").drop("o_orderstatus")


register("one_hot", """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS o_orderstatus_F,
  CAST(o_orderstatus = 'O' AS INTEGER) AS o_orderstatus_O, CAST(o_orderstatus = 'P' AS INTEGER) AS o_orderstatus_P FROM orders""")(_one_hot)


def _dummies(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return FE.one_hot_frame(o, "o_orderpriority", drop_first=True).drop("o_orderpriority")


def _dummies_sql():
    lv = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    cols = ", ".join(f"CAST(o_orderpriority = '{v}' AS INTEGER) AS \"o_orderpriority_{v.replace('-', '_').replace(' ', '_')}\"" for v in lv)
    return f"SELECT o_orderkey, {cols} FROM orders"


register("dummies_drop_first", _dummies_sql())(_dummies)



def _one_hot_sparse(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cols = ["o_custkey", "o_orderpriority"]
    enc = FE.one_hot_sparse(o, FE.one_hot_dictionary(o, cols, drop_first=True), cols, "x")
    return enc.select("o_orderkey", F.col("x.size").alias("n_columns"), F.array_join("x.indices", ",").alias("indices"))


register("one_hot_sparse", """WITH lv AS (SELECT 'o_custkey' AS c, CAST(o_custkey AS VARCHAR) AS v FROM orders UNION SELECT 'o_orderpriority', o_orderpriority FROM orders),
 kept AS (SELECT c, v FROM lv WHERE v IS NOT NULL AND (c, v) NOT IN (SELECT (c, min(v)) FROM lv GROUP BY c)),
 ix AS (SELECT c, v, row_number() OVER (ORDER BY c, v) - 1 AS i FROM kept)
SELECT o_orderkey, (SELECT count(*) FROM ix) AS n_columns, concat_ws(',', a.i, b.i) AS indices FROM orders
 LEFT JOIN ix a ON a.c = 'o_custkey' AND a.v = CAST(o_custkey AS VARCHAR) LEFT JOIN ix b ON b.c = 'o_orderpriority' AND b.v = o_orderpriority""")(
    _one_hot_sparse)

register("ordinal_encode", """WITH lv AS (SELECT p_type AS lvl, row_number() OVER (ORDER BY p_type) - 1 AS code
  FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL))
SELECT p_partkey, coalesce(code, -1) AS p_type FROM part LEFT JOIN lv ON part.p_type = lv.lvl""")(
    lambda spark, sf: FE.ordinal_encode(t(spark, sf, "part").select("p_partkey", "p_type"), "p_type"))


def _std_scale(spark, sf):
    li = _li(spark, sf)
    s = FE.standard_scale(li, ["l_quantity", "l_discount"])
    return li.select(*LK, R(s["l_quantity"]).alias("l_quantity"), R(s["l_discount"]).alias("l_discount"))


register("standard_scale", f"""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md,
  stddev_pop(l_discount) AS sd FROM lineitem)
SELECT {LKS}, {r6('(l_quantity - mq) / sq')} AS l_quantity, {r6('(l_discount - md) / sd')} AS l_discount FROM lineitem, s""")(_std_scale)


def _te(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_type", "p_retailprice")
    out = FE.target_encode_loo(p, "p_type", "p_retailprice", "p_type_te")
    return out.select("p_partkey", R("p_type_te").alias("p_type_te"))


register("target_encode_loo", f"""WITH g AS (SELECT p_type AS lvl, sum(p_retailprice) AS s, count(p_retailprice) AS n FROM part
  WHERE p_type IS NOT NULL GROUP BY 1), gm AS (SELECT avg(p_retailprice) AS m FROM part)
SELECT p_partkey, {r6('coalesce(CASE WHEN n > 1 AND p_retailprice IS NOT NULL THEN (s - p_retailprice) / (n - 1) WHEN n > 0 THEN s / n END, m)')} AS p_type_te
FROM part LEFT JOIN g ON part.p_type = g.lvl, gm""")(_te)


def _cyc(spark, sf):
    e = t(spark, sf, "events")
    cols = FE.cyclical_date("ts")
    return e.select("event_id", *[(R(v) if "sin" in k or "cos" in k else v).alias(k) for k, v in cols.items()])


register("cyclical_date", f"""SELECT event_id, year(ts) AS ts_year, {r6(f'sin({2 * math.pi!r} * month(ts) / 12)')} AS ts_month_sin,
  {r6(f'cos({2 * math.pi!r} * month(ts) / 12)')} AS ts_month_cos, {r6(f'sin({2 * math.pi!r} * (isodow(ts) - 1) / 7)')} AS ts_dow_sin,
  {r6(f'cos({2 * math.pi!r} * (isodow(ts) - 1) / 7)')} AS ts_dow_cos, CAST(isodow(ts) - 1 >= 5 AS INTEGER) AS ts_is_weekend FROM events""")(_cyc)


def _flags(spark, sf):
    c = t(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey",
                    F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "no").when(k % 4 == 2, "TRUE").otherwise("1").alias("is_active"),
                    F.when(F.col("c_acctbal") < 0, "y").otherwise("n").alias("has_debt"),
                    (k % 3 == 0).cast("int").alias("promo_flag"))


FLAGS_SQL = """(SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Yes' WHEN c_custkey % 4 = 1 THEN 'no'
  WHEN c_custkey % 4 = 2 THEN 'TRUE' ELSE '1' END AS is_active, CASE WHEN c_acctbal < 0 THEN 'y' ELSE 'n' END AS has_debt,
  CAST(c_custkey % 3 = 0 AS INTEGER) AS promo_flag FROM customer)"""
_YES = "('yes', 'true', '1', 'y')"

register("yes_no_flag", f"""SELECT c_custkey, CAST(coalesce(lower(is_active) IN {_YES}, false) AS INTEGER) AS is_active_bin,
  CAST(coalesce(lower(has_debt) IN {_YES}, false) AS INTEGER) AS has_debt_bin FROM {FLAGS_SQL}""")(
    lambda spark, sf: _flags(spark, sf).select("c_custkey", FE.yes_no_flag("is_active").alias("is_active_bin"),
                                               FE.yes_no_flag("has_debt").alias("has_debt_bin")))

register("flag_score", f"""SELECT c_custkey, CAST(coalesce(lower(is_active) IN {_YES}, false) AS INTEGER)
  + CAST(coalesce(lower(has_debt) IN {_YES}, false) AS INTEGER) + coalesce(promo_flag, 0) AS flag_score FROM {FLAGS_SQL}""")(
    lambda spark, sf: (lambda d: d.select("c_custkey", FE.flag_score(d, ["is_active", "has_debt", "promo_flag"]).alias("flag_score")))(_flags(spark, sf)))


def _pairs(spark, sf):
    li = _li(spark, sf)
    p = FE.pairwise_interactions(["l_quantity", "l_discount", "l_tax"])
    return li.select(*LK, *[R(v).alias(k) for k, v in p.items()])


register("pairwise_interactions", f"""SELECT {LKS}, {r6('l_quantity * l_discount')} AS l_quantity_x_l_discount,
  {r6('l_quantity * l_tax')} AS l_quantity_x_l_tax, {r6('l_discount * l_tax')} AS l_discount_x_l_tax FROM lineitem""")(_pairs)

register("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")(
    lambda spark, sf: FE.drop_columns(t(spark, sf, "orders"), ["o_totalprice", "o_orderdate"]))
register("drop_duplicate_rows", "SELECT DISTINCT user_id, event_type FROM events")(
    lambda spark, sf: FE.drop_duplicate_rows(t(spark, sf, "events").select("user_id", "event_type")))
register("drop_null_rows", f"SELECT event_id, user_id, {r6('value')} AS value FROM {EVENTS_NULLS_SQL} WHERE value IS NOT NULL AND user_id IS NOT NULL")(
    lambda spark, sf: FE.drop_null_rows(events_nulls(spark, sf), ["value", "user_id"]).select("event_id", "user_id", R("value").alias("value")))

NUMTXT_SQL = """(SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 7 = 0 THEN ' ' || CAST(p_size AS VARCHAR) || ' '
  WHEN p_partkey % 11 = 0 THEN 'inf' ELSE CAST(p_retailprice AS VARCHAR) END AS txt FROM part)"""


def _numtxt(spark, sf):
    p = t(spark, sf, "part")
    k = F.col("p_partkey")
    txt = (F.when(k % 5 == 0, F.col("p_name")).when(k % 7 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")))
           .when(k % 11 == 0, F.lit("inf")).otherwise(F.col("p_retailprice").cast("string")))
    return p.select("p_partkey", txt.alias("txt"))


register("to_number", f"""SELECT p_partkey, {r6('CASE WHEN isinf(TRY_CAST(trim(txt) AS DOUBLE)) THEN NULL ELSE TRY_CAST(trim(txt) AS DOUBLE) END')} AS num FROM {NUMTXT_SQL}""")(
    lambda spark, sf: _numtxt(spark, sf).select("p_partkey", R(SC.to_number("txt")).alias("num")))

register("to_date", """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 9 = 0 THEN 'not a date' ELSE CAST(o_orderdate AS VARCHAR) END AS TIMESTAMP) AS d FROM orders""")(
    lambda spark, sf: t(spark, sf, "orders").select("o_orderkey", SC.to_date(
        F.when(F.col("o_orderkey") % 9 == 0, F.lit("not a date")).otherwise(F.col("o_orderdate").cast("string"))).cast("timestamp_ntz").alias("d")))

register("safe_round", f"SELECT {LKS}, {r6('l_tax / l_discount')} AS r FROM lineitem")(
    _li_q(lambda: SC.div("l_tax", "l_discount"), "r"))


def _strength_sql(e):
    return (f"CASE WHEN {e} IS NULL THEN 'unknown' WHEN {e} >= 0.8 THEN 'very strong' WHEN {e} >= 0.6 THEN 'strong' "
            f"WHEN {e} >= 0.4 THEN 'moderate' WHEN {e} >= 0.2 THEN 'weak' ELSE 'negligible' END")


register("strength_label", f"SELECT {LKS}, {_strength_sql('round(l_discount * 10, 6)')} AS strength FROM lineitem")(
    lambda spark, sf: _li(spark, sf).select(*LK, SC.strength_label(R(F.col("l_discount") * 10)).alias("strength")))

register("clean_name", """SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.\\-]+', '_', 'g'), '^_+|_+$', '', 'g') AS name,
  regexp_replace(regexp_replace(url, '[^A-Za-z0-9_\\-]+', '_', 'g'), '^_+|_+$', '', 'g') AS project FROM pages""")(
    lambda spark, sf: t(spark, sf, "pages").select("page_id", SC.clean_name("url").alias("name"),
                                                   SC.clean_name("url", project=True).alias("project")))


def _tag_sql():
    parts = []
    for tag, words in SC.MESSAGE_TAG_WORDS:
        cond = " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words)
        parts.append(f"WHEN {cond} THEN '{tag}'")
    return f"SELECT conv_id, turn, CASE {' '.join(parts)} ELSE 'STATUS' END AS tag FROM conversations"


register("message_tag", _tag_sql())(
    lambda spark, sf: t(spark, sf, "conversations").select("conv_id", "turn", SC.message_tag("text").alias("tag")))

register("token_estimate", "SELECT doc_id, CAST(greatest(1, floor(length(coalesce(text, '')) / 4)) AS BIGINT) AS tokens FROM documents")(
    lambda spark, sf: t(spark, sf, "documents").select("doc_id", SC.token_estimate("text").alias("tokens")))

register("preview_text", "SELECT conv_id, turn, substring(coalesce(text, ''), 1, 200) AS preview FROM conversations")(
    lambda spark, sf: t(spark, sf, "conversations").select("conv_id", "turn", SC.preview_text("text").alias("preview")))

SPEC = [("gross", "l_extendedprice * (1 - l_discount)"), ("gross_tax", "gross * (1 + l_tax)"),
        ("gross", "gross / 100")]

register("apply_feature_spec", f"""SELECT {LKS}, {r6('l_extendedprice * (1 - l_discount) / 100')} AS gross,
  {r6('l_extendedprice * (1 - l_discount) * (1 + l_tax)')} AS gross_tax FROM lineitem""")(
    lambda spark, sf: FE.apply_feature_spec(_li(spark, sf), SPEC).select(*LK, R("gross").alias("gross"), R("gross_tax").alias("gross_tax")))
