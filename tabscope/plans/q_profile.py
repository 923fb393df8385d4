"""Registered profile queries (A1-A26) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from .catalog import register
from .sqlgen import EVENTS_NULLS_SQL, long_sql, r6
from .tables import SPIKED_SQL, events_nulls, spiked, t

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_ALL = LI_NUM + ["l_returnflag", "l_linestatus", "l_shipdate"]
EV_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _skew_label_sql(e: str) -> str:
    return (f"CASE WHEN {e} IS NULL THEN 'unknown' WHEN {e} > 1 THEN 'heavy right skew' "
            f"WHEN {e} > 0.5 THEN 'moderate right skew' WHEN {e} < -1 THEN 'heavy left skew' "
            f"WHEN {e} < -0.5 THEN 'moderate left skew' ELSE 'approximately symmetric' END")


def _describe_sql(src: str) -> str:
    q = lambda p: f"quantile_cont(value, {p})"
    sk = r6("skewness(value)")
    return f"""SELECT "column", count(value) AS count, {r6('avg(value)')} AS mean, {r6(q(0.5))} AS median,
 {r6('stddev_samp(value)')} AS std, {r6('var_samp(value)')} AS variance, {r6('min(value)')} AS min,
 {r6('max(value)')} AS max, {r6('max(value) - min(value)')} AS range, {r6(q(0.01))} AS p1, {r6(q(0.05))} AS p5,
 {r6(q(0.25))} AS q1, {r6(q(0.75))} AS q3, {r6(q(0.95))} AS p95, {r6(q(0.99))} AS p99,
 {r6(q(0.75) + ' - ' + q(0.25))} AS iqr, {sk} AS skewness, {r6('kurtosis(value)')} AS kurtosis,
 {_skew_label_sql(sk)} AS skew_label,
 {r6('CASE WHEN avg(value) <> 0 THEN stddev_samp(value) / avg(value) * 100 END')} AS cv_pct
FROM {src} GROUP BY "column\""""


register("describe_numeric", _describe_sql(long_sql("lineitem", LI_NUM)))(
    lambda spark, sf: P.describe_numeric(t(spark, sf, "lineitem"), LI_NUM))


register("skew_label", f"""SELECT "column", {r6('skewness(value)')} AS skewness,
 {_skew_label_sql(r6('skewness(value)'))} AS skew_label
FROM {long_sql(EVENTS_NULLS_SQL, ['user_id', 'value'])} GROUP BY "column\"""")(
    lambda spark, sf: P.describe_numeric(events_nulls(spark, sf), ["user_id", "value"]).select("column", "skewness", "skew_label"))


def _missing_sql(cols, src, only_missing=True):
    parts = []
    for c in cols:
        parts.append(f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS n_missing, count(*) AS n_rows, "
                     f"'{{{c}}}' AS dtype FROM {src}")
    return "(" + " UNION ALL ".join(parts) + ")"


EV_DTYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
             "value": "double", "props": "string"}


def _missing_counts_sql(src):
    parts = [f"SELECT '{c}' AS \"column\", count_if({c} IS NULL) AS n_missing, count(*) AS n_rows, "
             f"'{EV_DTYPES[c]}' AS dtype, {i} AS ordinal FROM {src}" for i, c in enumerate(EV_COLS)]
    return "(" + " UNION ALL ".join(parts) + ")"


_SEV = ("CASE WHEN n_missing / n_rows > 0.5 THEN 'critical' WHEN n_missing / n_rows > 0.2 THEN 'high' "
        "WHEN n_missing / n_rows > 0.05 THEN 'moderate' ELSE 'low' END")

register("missing_by_column", f"""SELECT "column", n_missing AS count, round(n_missing / n_rows * 100, 2) AS pct,
 dtype, {_SEV} AS severity FROM {_missing_counts_sql(EVENTS_NULLS_SQL)} WHERE n_missing > 0""")(
    lambda spark, sf: P.missing_by_column(events_nulls(spark, sf)))

register("missing_summary", f"""SELECT CAST(sum(n_missing) AS BIGINT) AS total_missing_cells,
 round(sum(n_missing) / (max(n_rows) * {len(EV_COLS)}) * 100, 2) AS total_missing_pct,
 count_if(n_missing > 0) AS cols_with_missing,
 coalesce(string_agg(CASE WHEN n_missing = n_rows AND n_rows > 0 THEN "column" END, ',' ORDER BY "column"), '')
   AS completely_null_cols
FROM {_missing_counts_sql(EVENTS_NULLS_SQL)}""")(lambda spark, sf: P.missing_summary(events_nulls(spark, sf)))


def _co_missing_sql():
    pairs = [(EV_COLS[i], EV_COLS[j]) for i in range(len(EV_COLS)) for j in range(i + 1, len(EV_COLS))]
    parts = [f"SELECT '{a}' AS col1, '{b}' AS col2, count_if({a} IS NULL AND {b} IS NULL) AS n_both FROM {EVENTS_NULLS_SQL}"
             for a, b in pairs]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_both > 0"


register("co_missingness", _co_missing_sql())(lambda spark, sf: P.co_missingness(events_nulls(spark, sf)))


def _mar_sql():
    miss = ["user_id", "event_type", "value", "props"]
    nums = ["event_id", "user_id", "value"]
    parts = []
    for m in miss:
        for x in nums:
            if x == m:
                continue
            ind = f"CASE WHEN {x} IS NOT NULL THEN CAST({m} IS NULL AS DOUBLE) END"
            parts.append(f"SELECT '{m}' AS missing_col, '{x}' AS predictor_col, count({x}) AS n, "
                         f"corr({ind}, CAST({x} AS DOUBLE)) AS r, stddev_samp({ind}) AS s FROM {EVENTS_NULLS_SQL}")
    return (f"SELECT missing_col, predictor_col, n, {r6('r')} AS correlation FROM (" + " UNION ALL ".join(parts) +
            ") WHERE n >= 10 AND s > 0")


register("mar_signals", _mar_sql())(
    lambda spark, sf: P.mar_signals(events_nulls(spark, sf), min_abs_r=0.0, with_p=False))

register("null_rate_top", f"""SELECT "column", round(n_missing / n_rows * 100, 2) AS pct
FROM {_missing_counts_sql(EVENTS_NULLS_SQL)} ORDER BY pct DESC, "column" LIMIT 5""")(
    lambda spark, sf: P.null_rate_top(events_nulls(spark, sf)))


def _fences_cte(src):
    return f"""st AS (SELECT "column", count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd,
   stddev_pop(value) AS sd_pop, min(value) AS mn, max(value) AS mx, quantile_cont(value, 0.25) AS q1,
   quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM {src} GROUP BY "column"),
 f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi,
   q1 - 3.0 * (q3 - q1) AS lo3, q3 + 3.0 * (q3 - q1) AS hi3 FROM st)"""


OUT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]


def _outliers_sql(table=SPIKED_SQL, cols=OUT_COLS):
    src = long_sql(table, cols)
    return f"""WITH l AS {src}, {_fences_cte('l')},
 c AS (SELECT l."column", count_if(value < lo OR value > hi) AS iqr_outliers,
   count_if(value < lo3 OR value > hi3) AS extreme_outliers,
   count_if(sd > 0 AND abs(value - mean) / sd_pop > 3.0) AS zscore_outliers
   FROM l JOIN f ON l."column" = f."column" WHERE f.n >= 4 AND f.iqr <> 0 GROUP BY l."column")
SELECT c."column", iqr_outliers, round(iqr_outliers / n * 100, 2) AS iqr_outlier_pct, zscore_outliers,
  extreme_outliers, {r6('lo')} AS lower_fence, {r6('hi')} AS upper_fence, {r6('mn')} AS min_value,
  {r6('mx')} AS max_value,
  CASE WHEN iqr_outliers / n > 0.10 THEN 'high' WHEN iqr_outliers / n > 0.03 THEN 'moderate' ELSE 'low' END AS severity
FROM c JOIN f ON c."column" = f."column" WHERE iqr_outliers > 0"""


register("outliers_by_column", _outliers_sql())(
    lambda spark, sf: P.outliers_by_column(spiked(spark, sf), OUT_COLS))


def _boxplot_sql():
    src = long_sql("events", ["value", "user_id"])
    return f"""WITH l AS {src}, {_fences_cte('l')},
 w AS (SELECT l."column", min(CASE WHEN value >= lo THEN value END) AS lw, max(CASE WHEN value <= hi THEN value END) AS uw,
   count_if(value < lo OR value > hi) AS n_outliers FROM l JOIN f ON l."column" = f."column" WHERE f.n >= 4 GROUP BY l."column")
SELECT w."column", {r6('mn')} AS min, {r6('q1')} AS q1, {r6('med')} AS median, {r6('q3')} AS q3, {r6('mx')} AS max,
  {r6('iqr')} AS iqr, {r6('lw')} AS lower_whisker, {r6('uw')} AS upper_whisker, n_outliers
FROM w JOIN f ON w."column" = f."column\""""


register("boxplot_stats", _boxplot_sql())(
    lambda spark, sf: P.boxplot_stats(t(spark, sf, "events"), ["value", "user_id"]))


def _boxplot_sample_sql():
    src = long_sql("events", ["value"], ids=["event_id"])
    return f"""WITH l AS {src}, {_fences_cte('l')},
 o AS (SELECT l."column", l.event_id, value FROM l JOIN f ON l."column" = f."column"
       WHERE f.n >= 4 AND (value < lo OR value > hi)),
 r AS (SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY event_id) AS ordinal, value FROM o)
SELECT "column", ordinal, {r6('value')} AS value FROM r WHERE ordinal <= 10"""


register("boxplot_outlier_sample", _boxplot_sample_sql())(
    lambda spark, sf: P.boxplot_outlier_sample(t(spark, sf, "events"), ["event_id"], ["value"]))


register("duplicate_summary", """WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
 a AS (SELECT sum(n) AS rows_, sum(n - 1) AS dup, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS inv FROM g),
 nd AS (SELECT sum(n - 1) AS num FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id))
SELECT CAST(dup AS BIGINT) AS duplicate_rows, round(dup / rows_ * 100, 2) AS duplicate_rows_pct,
  CAST(inv AS BIGINT) AS rows_involved_in_dups, CAST(num AS BIGINT) AS numeric_only_dups FROM a, nd""")(
    lambda spark, sf: P.duplicate_summary(t(spark, sf, "events").select("user_id", "event_type")))


register("date_profile", """WITH l AS (SELECT 'o_orderdate' AS "column", o_orderdate AS t FROM orders)
SELECT "column", strftime(min(t), '%Y-%m-%d') AS min_date, strftime(max(t), '%Y-%m-%d') AS max_date,
  CAST(floor((epoch_us(max(t)) - epoch_us(min(t))) / 86400000000) AS BIGINT) AS span_days,
  count(t) AS n_parsed, count_if(t IS NULL) AS n_failed, count_if(t > TIMESTAMP '1998-01-01') AS n_future_dates,
  count(DISTINCT strftime(t, '%Y-%m')) AS unique_months, count(DISTINCT year(t)) AS unique_years,
  count_if(t > TIMESTAMP '1998-01-01') > 0 AS has_future_dates
FROM l GROUP BY "column" HAVING count(t) > 0""")(
    lambda spark, sf: P.date_profile(t(spark, sf, "orders"), as_of="1998-01-01"))


LI_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _anomalies_sql():
    # events: 'value' is a zero keyword; lineitem names hit quantity / price
    parts = []
    for c in ["l_quantity", "l_extendedprice"]:
        parts.append(f"""SELECT '{c}' AS "column", 'negative_where_unexpected' AS type, count_if({c} < 0) AS count,
  {r6(f"arg_min(CASE WHEN {c} < 0 THEN {c} END, CASE WHEN {c} < 0 THEN ({', '.join(LI_ORDER)}) END)")} AS example
  FROM {SPIKED_SQL}""")
    parts.append("""SELECT 'l_extendedprice' AS "column", 'zero_where_suspicious' AS type,
  count_if(l_extendedprice = 0) AS count, CAST(NULL AS DOUBLE) AS example FROM """ + SPIKED_SQL)
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE count > 0"


register("numeric_anomalies", _anomalies_sql())(
    lambda spark, sf: P.numeric_anomalies(spiked(spark, sf), LI_ORDER))


def _pystrip(e):
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def _string_quality_sql(table, cols, only_issues=True):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column",
  count_if({_pystrip(c)} = '') AS n_empty, count_if({c} <> {_pystrip(c)}) AS n_padded,
  count(DISTINCT {c}) AS unique_as_typed, count(DISTINCT lower({c})) AS unique_lowercased,
  count(DISTINCT {c}) - count(DISTINCT lower({c})) AS extra_variants FROM {table} WHERE {c} IS NOT NULL""")
    q = "SELECT * FROM (" + " UNION ALL ".join(parts) + ")"
    if only_issues:
        q += " WHERE n_empty > 0 OR n_padded > 0 OR extra_variants > 0"
    return q


STR_TABLE_SQL = """(SELECT p_name, p_brand, p_type,
  CASE WHEN p_partkey % 9 = 0 THEN upper(p_type) WHEN p_partkey % 10 = 0 THEN ' ' || p_brand || ' '
       WHEN p_partkey % 17 = 0 THEN '  ' ELSE p_brand END AS p_label FROM part)"""


def _str_table(spark, sf):
    p = t(spark, sf, "part")
    k = F.col("p_partkey")
    lab = (F.when(k % 9 == 0, F.upper("p_type")).when(k % 10 == 0, F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")))
           .when(k % 17 == 0, F.lit("  ")).otherwise(F.col("p_brand")))
    return p.select("p_name", "p_brand", "p_type", lab.alias("p_label"))


register("string_quality", _string_quality_sql(STR_TABLE_SQL, ["p_name", "p_brand", "p_type", "p_label"], False))(
    lambda spark, sf: P.string_quality(_str_table(spark, sf), only_issues=False))


def _anomaly_flags_sql():
    sq = _string_quality_sql(STR_TABLE_SQL, ["p_name", "p_brand", "p_type", "p_label"], True)
    return f"""SELECT "column", 'string_quality_issues' AS type, n_empty + n_padded + extra_variants AS count,
  'empty=' || n_empty || ';padded=' || n_padded || ';extra_variants=' || extra_variants AS detail FROM ({sq})"""


register("anomaly_flags", _anomaly_flags_sql())(
    lambda spark, sf: P.anomaly_flags(_str_table(spark, sf)))


def _histogram_sql(table, cols, bins=30):
    src = long_sql(table, cols)
    return f"""WITH l AS {src},
 rg0 AS (SELECT "column", count(value) AS n, min(value) AS mn, max(value) AS mx FROM l GROUP BY "column"),
 rg AS (SELECT "column", CASE WHEN mx = mn THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mx = mn THEN mx + 0.5 ELSE mx END AS hi
        FROM rg0 WHERE n >= 2),
 c AS (SELECT l."column", CAST(least(floor((value - lo) * ({float(bins)} / (hi - lo))), {bins - 1}) AS INTEGER) AS bin,
        count(*) AS n FROM l JOIN rg ON l."column" = rg."column" GROUP BY ALL),
 g AS (SELECT "column", lo, hi, CAST(unnest(range(0, {bins})) AS INTEGER) AS bin FROM rg)
SELECT g."column", g.bin, {r6(f'lo + g.bin * ((hi - lo) / {bins})')} AS lo_edge,
  {r6(f'CASE WHEN g.bin = {bins - 1} THEN hi ELSE lo + (g.bin + 1) * ((hi - lo) / {bins}) END')} AS hi_edge,
  coalesce(c.n, 0) AS n
FROM g LEFT JOIN c ON g."column" = c."column" AND g.bin = c.bin"""


register("histogram", _histogram_sql("events", ["value", "user_id"]))(
    lambda spark, sf: P.histogram(t(spark, sf, "events"), ["value", "user_id"]))


def _k2_sql():
    # population g1 from DuckDB's sample skewness; kurtosis_pop is the uncorrected excess form
    g1 = "(skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1.0)))"
    return f"""WITH l AS {long_sql('lineitem', ['l_quantity', 'l_discount', 'l_extendedprice'])},
 m AS (SELECT "column", CAST(count(value) AS DOUBLE) AS n, {g1} AS g1, kurtosis_pop(value) AS g2 FROM l GROUP BY "column"),
 a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y,
   3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
   (g2 + 3 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
   6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM m),
 b AS (SELECT *, -1 + sqrt(2 * (beta2 - 1)) AS w2, 6.0 + 8.0 / sb * (2.0 / sb + sqrt(1 + 4.0 / (sb * sb))) AS aa FROM a),
 c AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2.0 / (w2 - 1)) AS alpha,
   (1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4.0))) AS inner_ FROM b),
 d AS (SELECT *, CASE WHEN y = 0 THEN 0.0 ELSE delta * ln(y / alpha + sqrt((y / alpha) * (y / alpha) + 1)) END AS z1,
   (1 - 2 / (9.0 * aa) - sign(inner_) * pow(abs(inner_), 1 / 3.0)) / sqrt(2 / (9.0 * aa)) AS z2 FROM c),
 e AS (SELECT *, CASE WHEN n >= 20 THEN z1 * z1 + z2 * z2 END AS k2 FROM d)
SELECT "column", CAST(n AS BIGINT) AS n, {r6('k2')} AS k2, {r6('exp(-k2 / 2)')} AS normality_p,
  CASE WHEN k2 IS NULL THEN 'untested' WHEN exp(-k2 / 2) > 0.05 THEN 'normal' ELSE 'non-normal' END AS normality_verdict
FROM e"""


register("normality_k2", _k2_sql())(
    lambda spark, sf: P.normality_k2(t(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"]))

CAT_COLS = ["o_orderstatus", "o_orderpriority"]


def _vc_sql(table, cols):
    return f"(SELECT \"column\", value, count(*) AS n FROM {long_sql(table, cols, cast='VARCHAR', keep_null=True)} GROUP BY ALL)"


register("category_frequencies", f"""WITH vc AS {_vc_sql('orders', CAT_COLS)},
 tot AS (SELECT "column", sum(n) AS tot FROM vc GROUP BY "column"),
 r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC NULLS LAST) AS rank FROM vc)
SELECT r."column", rank, value, n AS count, round(n / tot * 100, 2) AS pct FROM r JOIN tot USING ("column") WHERE rank <= 15""")(
    lambda spark, sf: P.category_frequencies(t(spark, sf, "orders"), CAT_COLS))


def _cat_summary_sql(table, cols):
    return f"""WITH vc AS {_vc_sql(table, cols)},
 g AS (SELECT "column", count(value) AS n_unique, sum(n) AS tot, sum(n * ln(n)) AS nlogn, max(n) AS mode_n FROM vc GROUP BY "column"),
 m AS (SELECT vc."column", min(value) AS mode FROM vc JOIN g ON vc."column" = g."column" AND vc.n = g.mode_n GROUP BY vc."column")
SELECT g."column", n_unique, mode, round(mode_n / tot * 100, 2) AS mode_pct, {r6('ln(tot) - nlogn / tot')} AS entropy
FROM g LEFT JOIN m ON g."column" = m."column\""""


register("category_summary", _cat_summary_sql("orders", CAT_COLS + ["o_custkey"]))(
    lambda spark, sf: P.category_summary(t(spark, sf, "orders"), CAT_COLS + ["o_custkey"]))

register("category_entropy", f"SELECT \"column\", entropy FROM ({_cat_summary_sql('customer', ['c_mktsegment', 'c_nationkey'])})")(
    lambda spark, sf: P.category_entropy(t(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"]))

register("crosstab", """SELECT CAST(o_orderstatus AS VARCHAR) AS a_value, CAST(o_orderpriority AS VARCHAR) AS b_value,
  count(*) AS n FROM orders GROUP BY ALL""")(
    lambda spark, sf: P.crosstab(t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))

register("distinct_counts", "SELECT \"column\", count(DISTINCT value) AS n_unique FROM " +
         long_sql("lineitem", LI_ALL, cast="VARCHAR") + " GROUP BY \"column\"")(
    lambda spark, sf: P.distinct_counts(t(spark, sf, "lineitem"), LI_ALL))



def _sketch_error(spark, sf):
    li = t(spark, sf, "lineitem")
    halves = P.distinct_sketches(li.where("l_orderkey % 2 = 0")).unionByName(P.distinct_sketches(li.where("l_orderkey % 2 = 1")))
    near = P.sketch_counts(P.merge_sketches(halves)).withColumnRenamed("n_unique", "near")
    return P.distinct_counts(li).join(near, "column").select("column", "n_unique", (F.abs(F.col("near") / F.col("n_unique") - 1) <= 0.05).alias("within_5_pct"))


register("distinct_sketches", "SELECT \"column\", count(DISTINCT value) AS n_unique, true AS within_5_pct FROM " +
         long_sql("lineitem", LI_ALL, cast="VARCHAR") + " GROUP BY \"column\"")(_sketch_error)

ORD_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]

register("monthly_trend", f"""SELECT 'o_orderdate' AS date_column, month, "column", {r6('avg(value)')} AS avg,
  {r6('coalesce(sum(value), 0.0)')} AS total, count(value) AS n
FROM {long_sql("(SELECT strftime(o_orderdate, '%Y-%m') AS month, * FROM orders WHERE o_orderdate IS NOT NULL)", ORD_NUM, ids=['month'], keep_null=True)}
GROUP BY month, "column\"""")(lambda spark, sf: P.monthly_trend(t(spark, sf, "orders"), "o_orderdate", ORD_NUM))

register("monthly_cohorts", f"""SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n,
  {r6('avg(o_totalprice)')} AS o_totalprice_mean, {r6('coalesce(sum(o_totalprice), 0.0)')} AS o_totalprice_total
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY period""")(
    lambda spark, sf: P.monthly_cohorts(t(spark, sf, "orders"), "o_orderdate"))


def _segment_sql():
    segs = ["c_mktsegment", "c_nationkey"]
    nums = ["c_custkey", "c_acctbal"]
    # c_nationkey has 25 levels: excluded by the 2..10 rule
    seg = "c_mktsegment"
    src = long_sql(f"(SELECT CAST({seg} AS VARCHAR) AS level, * FROM customer)", nums, ids=["level"])
    return f"""WITH sizes AS (SELECT CAST({seg} AS VARCHAR) AS level, count(*) AS n,
    round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct FROM customer GROUP BY ALL),
 l AS {src},
 m AS (SELECT level, "column", avg(value) AS mean, quantile_cont(value, 0.5) AS med, stddev_samp(value) AS sd,
   min(value) AS mn, max(value) AS mx FROM l WHERE level IS NOT NULL GROUP BY ALL)
SELECT '{seg}' AS segment_column, m.level, n, pct, "column", {r6('mean')} AS mean, {r6('med')} AS median,
  {r6('sd')} AS std, {r6('mn')} AS min, {r6('mx')} AS max FROM m JOIN sizes ON m.level = sizes.level"""


register("segment_profile", _segment_sql())(
    lambda spark, sf: P.segment_profile(t(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"], ["c_custkey", "c_acctbal"]))


def _kpi_sql():
    kpi = [c for c in LI_NUM if any(k in c.lower() for k in P.KPI_KEYWORDS)]
    inlist = ", ".join(f"'{c}'" for c in kpi) or "''"
    return f"""SELECT "column", "column" IN ({inlist}) AS is_likely_kpi, {r6('sum(value)')} AS total,
  {r6('avg(value)')} AS mean, {r6('quantile_cont(value, 0.5)')} AS median, count(value) AS count,
  CASE WHEN count(value) > 0 THEN round(count_if(value <> 0) / count(value) * 100, 2) END AS pct_nonzero
FROM {long_sql('lineitem', LI_NUM)} GROUP BY "column\""""


register("kpi_summary", _kpi_sql())(lambda spark, sf: P.kpi_summary(t(spark, sf, "lineitem"), LI_NUM))

register("class_balance", """SELECT CAST(quality AS VARCHAR) AS class, count(*) AS n,
  round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct,
  round(max(count(*)) OVER () / min(count(*)) OVER (), 6) AS imbalance_ratio
FROM labels WHERE quality IS NOT NULL GROUP BY ALL""")(lambda spark, sf: P.class_balance(t(spark, sf, "labels"), "quality"))


def _quality_sql():
    # events with rule nulls: missing pct; no full duplicates; cardinality constants none; etc. computed below
    return None


register("quality_score")(lambda spark, sf: P.quality_score(events_nulls(spark, sf), ["event_id"]))
