"""Registered source/sink (S), join (J), top-k (K) and set (U) queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_round as R
from ..operators import assoc as H
from ..operators import profile as P
from ..operators.common import long_form
from ..operators.quantiles import quantile_table
from ..operators.window import join_on
from ..sources import io as IO
from .catalog import register
from .q_profile import _outliers_sql
from .sqlgen import long_sql, r6
from .tables import t

CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]

register("head_sample", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 200")(
    lambda spark, sf: IO.head_sample(t(spark, sf, "orders"), ["o_orderkey"]))


def _fp_sql():
    h = "md5(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in CUST_COLS) + "))"
    return f"SELECT count(*) AS n_rows, CAST(sum(('0x' || substr({h}, 1, 8))::BIGINT) AS BIGINT) AS md5_sum FROM customer"


register("table_fingerprint", _fp_sql())(
    lambda spark, sf: IO.table_fingerprint(t(spark, sf, "customer"), CUST_COLS).select("n_rows", "md5_sum"))

MARK_B, MARK_E = "<<<RESULTS_BEGIN>>>", "<<<RESULTS_END>>>"


def _marked(spark, sf):
    e = t(spark, sf, "events")
    body = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", "}", ",}")).otherwise(F.col("props"))
    txt = F.concat(F.lit("log line\n" + MARK_B + "\n"), body, F.lit("\n" + MARK_E + "\ntrailer"))
    return e.select("event_id", IO.extract_marked_json(txt, MARK_B, MARK_E, "k long")["k"].alias("k"))


register("extract_marked_json", """SELECT event_id, CAST(json_extract(regexp_replace(CASE WHEN event_id % 3 = 0 THEN replace(props, '}', ',}') ELSE props END,
  ',\\s*([}\\]])', '\\1', 'g'), '$.k') AS BIGINT) AS k FROM events""")(_marked)

REQUIRED = ["k", "v", "ts"]


def _contract(spark, sf):
    e = t(spark, sf, "events")
    return e.select("event_id", F.array_join(IO.validate_contract(F.json_object_keys("props"), REQUIRED), ",").alias("missing"))


register("validate_contract", """SELECT event_id, array_to_string(list_sort(list_filter(['k', 'v', 'ts'], lambda x: NOT list_contains(json_keys(props), x))), ',') AS missing
FROM events""")(_contract)


def _attach_stats(spark, sf):
    c = t(spark, sf, "customer")
    cols = ["c_acctbal"]
    long = long_form(c, cols, ids=["c_custkey"])
    st = quantile_table(long_form(c, cols), [0.25, 0.75])
    return long.join(F.broadcast(st), "column").select("c_custkey", "column", R("value").alias("value"),
                                                      R(F.col("q")[0]).alias("q1"), R(F.col("q")[1]).alias("q3"))


register("attach_column_stats", f"""WITH l AS {long_sql('customer', ['c_acctbal'], ids=['c_custkey'])},
 s AS (SELECT "column", quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1)
SELECT c_custkey, l."column", {r6('value')} AS value, {r6('q1')} AS q1, {r6('q3')} AS q3 FROM l JOIN s USING ("column")""")(_attach_stats)


def _group_stats(spark, sf):
    c = t(spark, sf, "customer")
    by = ["c_mktsegment"]
    med = quantile_table(c.select(*by, F.col("c_acctbal").alias("value")), [0.5], by, bounded=False)
    g = join_on(c.groupBy(*by).agg(F.avg("c_acctbal").alias("seg_mean")), med.select(*by, F.col("q")[0].alias("seg_median")), by)
    return c.join(g, "c_mktsegment").select("c_custkey", R("seg_mean").alias("seg_mean"), R("seg_median").alias("seg_median"))


register("attach_group_stats", f"""WITH g AS (SELECT c_mktsegment, avg(c_acctbal) AS m, quantile_cont(c_acctbal, 0.5) AS md FROM customer GROUP BY 1)
SELECT c_custkey, {r6('m')} AS seg_mean, {r6('md')} AS seg_median FROM customer JOIN g USING (c_mktsegment)""")(_group_stats)

register("column_concat", "SELECT o_orderkey, o_totalprice * 2 AS doubled, upper(o_orderstatus) AS status FROM orders")(
    lambda spark, sf: t(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"),
                                                    F.upper("o_orderstatus").alias("status")))

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey", "l_partkey", "l_suppkey"]


def _pairs_sql(cols):
    from itertools import combinations
    parts = [f"SELECT '{a}' AS col1, '{b}' AS col2, covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) AS r FROM lineitem"
             for a, b in combinations(cols, 2)]
    return "(" + " UNION ALL ".join(parts) + ")"


register("top_pairs", f"""SELECT col1, col2, {r6('r')} AS pearson_r, round(abs({r6('r')}), 6) AS abs_r FROM {_pairs_sql(LI)}
ORDER BY abs_r DESC, col1, col2 LIMIT 20""")(
    lambda spark, sf: H.pearson_pairs(t(spark, sf, "lineitem"), LI, with_p=False)
    .orderBy(F.desc("abs_r"), "col1", "col2").limit(20).select("col1", "col2", "pearson_r", "abs_r"))


def _top_missing(spark, sf):
    from .tables import events_nulls
    return P.missing_by_column(events_nulls(spark, sf)).orderBy(F.desc("pct"), "column").limit(5).select("column", "pct")


register("top_missing_columns", """WITH m AS (SELECT 'user_id' AS "column", count_if(user_id IS NULL) AS n, count(*) AS r FROM ev
  UNION ALL SELECT 'event_type', count_if(event_type IS NULL), count(*) FROM ev UNION ALL SELECT 'value', count_if(value IS NULL), count(*) FROM ev
  UNION ALL SELECT 'props', count_if(props IS NULL), count(*) FROM ev)
SELECT "column", round(n / r * 100, 2) AS pct FROM m WHERE n > 0 ORDER BY pct DESC, "column" LIMIT 5""".replace(
    "FROM ev", "FROM (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 13 = 0 THEN NULL "
               "ELSE event_type END AS event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, "
               "CASE WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN NULL ELSE props END AS props FROM events)"))(_top_missing)

register("top_outlier_columns", f"""SELECT "column", iqr_outlier_pct FROM ({_outliers_sql("events", ["value", "user_id", "event_id"])})
ORDER BY iqr_outlier_pct DESC, "column" LIMIT 5""")(
    lambda spark, sf: P.outliers_by_column(t(spark, sf, "events"), ["value", "user_id", "event_id"])
    .orderBy(F.desc("iqr_outlier_pct"), "column").limit(5).select("column", "iqr_outlier_pct"))

register("top_k_per_group", """SELECT * FROM (SELECT n_nationkey, c_custkey, c_acctbal,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey)
WHERE rank <= 3""")(
    lambda spark, sf: t(spark, sf, "customer").join(F.broadcast(t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    .withColumn("rank", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long"))
    .where("rank <= 3").select("n_nationkey", "c_custkey", "c_acctbal", "rank"))

REQ_FEATURES = ["p_partkey", "p_name", "p_color", "p_size"]


def _missing_extra(spark, sf):
    from ..operators.schema import column_meta
    given = column_meta(t(spark, sf, "part")).agg(F.collect_list("column").alias("g"))
    req = F.array(*[F.lit(c) for c in REQ_FEATURES])
    return given.select(F.array_join(F.array_sort(F.array_except(req, "g")), ",").alias("missing"),
                        F.array_join(F.array_sort(F.array_except("g", req)), ",").alias("extra"))


register("missing_extra_features", """WITH g AS (SELECT list(column_name ORDER BY column_name) AS given FROM information_schema.columns WHERE table_name = 'part')
SELECT array_to_string(list_sort(list_filter(['p_partkey', 'p_name', 'p_color', 'p_size'], lambda x: NOT list_contains(given, x))), ',') AS missing,
  array_to_string(list_sort(list_filter(given, lambda x: NOT list_contains(['p_partkey', 'p_name', 'p_color', 'p_size'], x))), ',') AS extra FROM g""")(
    _missing_extra)

register("is_subset_binary", """SELECT 'quality' AS "column", bool_and(quality IN (0, 1)) AS is_binary FROM labels
UNION ALL SELECT 'toxic', bool_and(toxic IN (0, 1)) FROM labels UNION ALL SELECT 'doc_id', bool_and(doc_id IN (0, 1)) FROM labels""")(
    lambda spark, sf: t(spark, sf, "labels").agg(*[F.bool_and(F.col(c).isin(0, 1)).alias(c) for c in ["quality", "toxic", "doc_id"]])
    .unpivot([], ["quality", "toxic", "doc_id"], "column", "is_binary"))

register("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")(
    lambda spark, sf: t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct())


def _sorted_tests(spark, sf):
    """Tests with a p-value made by rule (null for every fifth), in K3's order."""
    from ..functions.scalar import test_order
    from ..operators.window import global_row_index
    p = t(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 7 / 7.0).alias("p_value"))
    keys = test_order("p_value", "p_partkey")
    ranked = global_row_index(p.withColumns({f"_k{i}": k for i, k in enumerate(keys)}), [f"_k{i}" for i in range(len(keys))], out="place")
    return ranked.select("p_partkey", R("p_value").alias("p_value"), "place")


register("sort_tests_by_p", """SELECT p_partkey, round(p, 6) AS p_value, row_number() OVER (ORDER BY coalesce(p, 1), p_partkey) - 1 AS place
FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 7 / 7.0 END AS p FROM part)""")(_sorted_tests)

register("alias_overlap", """SELECT a.p_partkey, lower(a.p_brand) = lower(b.p_brand) OR lower(a.p_type) = lower(b.p_type) OR lower(a.p_brand) = lower(b.p_type)
  OR lower(a.p_type) = lower(b.p_brand) AS overlap FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")(
    lambda spark, sf: (lambda p: p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.upper("p_brand").alias("b2"), F.col("p_type").alias("t2")), "p_partkey")
                       .select("p_partkey", IO.alias_overlap(F.array("p_brand", "p_type"), F.array("b2", "t2")).alias("overlap")))(t(spark, sf, "part")))

_HITS = "SELECT 1 + l_orderkey % 40 AS request_id, l_partkey AS doc_id, CAST(l_linenumber % 2 AS INTEGER) AS chunk_no, l_suppkey AS query_id, l_quantity AS score FROM lineitem"


def _union_hits(spark, sf):
    from ..operators.retrieval import union_hits
    t(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    hits = spark.sql(_HITS)
    return union_hits([hits.where("query_id % 2 = 0"), hits.where("query_id % 2 = 1")], ["doc_id", "chunk_no"], max_hits=12).withColumn("ord", F.col("ord").cast("long"))


register("union_hits", f"""WITH h AS ({_HITS}), b AS (SELECT *, row_number() OVER (PARTITION BY request_id, doc_id, chunk_no ORDER BY score DESC, query_id) AS r FROM h),
 o AS (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id, chunk_no) AS ord FROM b WHERE r = 1)
SELECT * FROM o WHERE ord <= 12""")(_union_hits)


def _report(spark, sf):
    from .tables import events_nulls, spiked
    out = P.outliers_by_column(spiked(spark, sf), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("column", "iqr_outliers", "severity")
    missing = P.missing_by_column(events_nulls(spark, sf)).select("column", "count", "severity")
    return IO.report_table({"outliers": (out, [-F.col("iqr_outliers")]), "missing": (missing, [-F.col("count")])}).where("ordinal <= 5")


def _report_sql():
    from .q_profile import EVENTS_NULLS_SQL, SPIKED_SQL
    out = " UNION ALL ".join(f"""SELECT '{c}' AS item, count_if(v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n, count(v) AS of
  FROM (SELECT {c} AS v FROM {SPIKED_SQL}), (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {SPIKED_SQL}) WHERE q3 > q1"""
                             for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    miss = " UNION ALL ".join(f"SELECT '{c}' AS item, count_if({c} IS NULL) AS n, count(*) AS of FROM {EVENTS_NULLS_SQL}" for c in ("user_id", "event_type", "value", "props"))
    return f"""WITH o AS (SELECT 'outliers' AS section, item, n, CASE WHEN n / of > 0.10 THEN 'high' WHEN n / of > 0.03 THEN 'moderate' ELSE 'low' END AS severity FROM ({out}) WHERE n > 0),
 m AS (SELECT 'missing' AS section, item, n, CASE WHEN n / of > 0.5 THEN 'critical' WHEN n / of > 0.2 THEN 'high' WHEN n / of > 0.05 THEN 'moderate' ELSE 'low' END AS severity
   FROM ({miss}) WHERE n > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, item) AS ordinal FROM (SELECT * FROM o UNION ALL SELECT * FROM m)),
 f AS (SELECT section, ordinal, item, CASE section WHEN 'outliers' THEN 'iqr_outliers' ELSE 'count' END AS field, CAST(n AS VARCHAR) AS value FROM r
   UNION ALL SELECT section, ordinal, item, 'severity', severity FROM r)
SELECT * FROM f WHERE ordinal <= 5"""


register("report_table", _report_sql())(_report)
