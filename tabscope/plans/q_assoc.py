"""Registered association queries (H1-H19) with DuckDB oracles (statistics; p-values are unit-tested)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import assoc as H
from .catalog import register
from .sqlgen import r6
from .tables import t

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(a, b, src):
    x = f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
    y = f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
    return f"covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y}))"


def _strength(e):
    return (f"CASE WHEN {e} IS NULL THEN 'unknown' WHEN {e} >= 0.8 THEN 'very strong' WHEN {e} >= 0.6 THEN 'strong' "
            f"WHEN {e} >= 0.4 THEN 'moderate' WHEN {e} >= 0.2 THEN 'weak' ELSE 'negligible' END")


def _pairs_sql(src, cols):
    parts = [f"SELECT '{a}' AS col1, '{b}' AS col2, {_corr_sql(a, b, src)} AS r, count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {src}"
             for a, b in combinations(cols, 2)]
    return "(" + " UNION ALL ".join(parts) + ")"


def _pearson_sql(src, cols):
    return f"""SELECT col1, col2, {r6('r')} AS pearson_r, round(abs({r6('r')}), 6) AS abs_r, n AS n_pairs,
  {_strength(f'abs({r6("r")})')} AS strength, CASE WHEN {r6('r')} >= 0 THEN 'positive' ELSE 'negative' END AS direction
FROM {_pairs_sql(src, cols)} WHERE r IS NOT NULL"""


register("pearson_pairs", _pearson_sql("lineitem", LI))(lambda spark, sf: H.pearson_pairs(t(spark, sf, "lineitem"), LI, with_p=False))
register("pearson_pvalues")(lambda spark, sf: H.pearson_pairs(t(spark, sf, "lineitem"), LI, with_p=True))

register("pearson_matrix", f"""WITH p AS (SELECT col1, col2, {r6('r')} AS r FROM {_pairs_sql('lineitem', LI)} WHERE r IS NOT NULL)
SELECT col1, col2, r FROM p UNION ALL SELECT col2, col1, r FROM p UNION ALL
SELECT c, c, 1.0 FROM (VALUES {', '.join(f"('{c}')" for c in LI)}) v(c)""")(
    lambda spark, sf: H.pearson_matrix(t(spark, sf, "lineitem"), LI))


def _rank_expr(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


SP = ["l_quantity", "l_discount", "l_tax"]
register("spearman_pairs", f"""WITH rk AS (SELECT {', '.join(f'{_rank_expr(c)} AS {c}' for c in SP)} FROM lineitem)
SELECT col1, col2, {r6('r')} AS spearman_r, n AS n_pairs FROM {_pairs_sql('rk', SP)} WHERE r IS NOT NULL""")(
    lambda spark, sf: H.spearman_pairs(t(spark, sf, "lineitem"), SP))

PC = ["l_extendedprice", "l_quantity", "l_discount"]  # order = (non_null, variance) desc


def _partial_sql():
    src = f"(SELECT {', '.join(PC)} FROM lineitem WHERE {' AND '.join(f'{c} IS NOT NULL' for c in PC)})"
    r = {}
    for a, b in combinations(PC, 2):
        r[(a, b)] = r[(b, a)] = f"corr({a}, {b})"
    parts = []
    for a, b in combinations(PC, 2):
        z = [c for c in PC if c not in (a, b)][0]
        pc = f"(({r[(a, b)]} - {r[(a, z)]} * {r[(b, z)]}) / sqrt((1 - {r[(a, z)]} * {r[(a, z)]}) * (1 - {r[(b, z)]} * {r[(b, z)]})))"
        parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, {r6(pc)} AS partial_r, {r6(f'abs({pc})')} AS abs_r, count(*) AS n FROM {src}")
    return " UNION ALL ".join(parts)


register("partial_correlation", _partial_sql())(
    lambda spark, sf: H.partial_correlation(t(spark, sf, "lineitem"), PC).select("col1", "col2", "partial_r", "abs_r", "n"))

VF = ["l_quantity", "l_extendedprice"]
register("vif", f"""WITH c AS (SELECT round(corr(l_quantity, l_extendedprice) * corr(l_quantity, l_extendedprice), 6) AS r2 FROM lineitem)
SELECT f AS feature, r2 AS r2_against_others, round(1 / greatest(1e-12, 1 - r2), 6) AS vif,
  CASE WHEN 1 / greatest(1e-12, 1 - r2) >= 10 THEN 'severe_multicollinearity' WHEN 1 / greatest(1e-12, 1 - r2) >= 5 THEN 'moderate' ELSE 'ok' END AS status
FROM c, (VALUES ('l_quantity'), ('l_extendedprice')) v(f)""")(lambda spark, sf: H.vif(t(spark, sf, "lineitem"), VF))


def _ord(spark, sf):
    o = t(spark, sf, "orders")
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey",
                    F.when(F.col("o_totalprice") > 150000, "big").otherwise("small").alias("o_big"),
                    F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "y").otherwise("n").alias("o_urgent"))


ORD_SQL = """(SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, o_custkey,
  CASE WHEN o_totalprice > 150000 THEN 'big' ELSE 'small' END AS o_big,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'y' ELSE 'n' END AS o_urgent FROM orders)"""
CAT4 = ["o_orderstatus", "o_orderpriority", "o_big", "o_urgent"]


def _chi_sql():
    parts = []
    for a, b in combinations(CAT4, 2):
        parts.append(f"""SELECT '{a}' AS col1, '{b}' AS col2, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b
  FROM {ORD_SQL} WHERE {a} IS NOT NULL AND {b} IS NOT NULL""")
    rec = " UNION ALL ".join(parts)
    return f"""WITH rec AS ({rec}),
 obs AS (SELECT col1, col2, a, b, count(*) AS o FROM rec GROUP BY ALL),
 ra AS (SELECT col1, col2, a, sum(o) AS ra FROM obs GROUP BY ALL),
 cb AS (SELECT col1, col2, b, sum(o) AS cb FROM obs GROUP BY ALL),
 dims AS (SELECT col1, col2, (SELECT count(*) FROM ra WHERE ra.col1 = x.col1 AND ra.col2 = x.col2) AS r,
   (SELECT count(*) FROM cb WHERE cb.col1 = x.col1 AND cb.col2 = x.col2) AS c, sum(o) AS n FROM obs x GROUP BY col1, col2),
 cells AS (SELECT ra.col1, ra.col2, ra.a, cb.b, ra.ra, cb.cb, coalesce(obs.o, 0) AS o, dims.r, dims.c, dims.n,
   ra.ra * cb.cb / dims.n AS e FROM ra JOIN cb ON ra.col1 = cb.col1 AND ra.col2 = cb.col2
   JOIN dims ON dims.col1 = ra.col1 AND dims.col2 = ra.col2
   LEFT JOIN obs ON obs.col1 = ra.col1 AND obs.col2 = ra.col2 AND obs.a = ra.a AND obs.b = cb.b),
 adj AS (SELECT *, CASE WHEN (r - 1) * (c - 1) = 1 THEN o + sign(e - o) * least(0.5, abs(e - o)) ELSE o END AS oa FROM cells),
 st AS (SELECT col1, col2, sum((oa - e) * (oa - e) / e) AS chi2, CAST(any_value((r - 1) * (c - 1)) AS BIGINT) AS dof,
   any_value(n) AS n, any_value(least(r, c) - 1) AS md FROM adj GROUP BY col1, col2)
SELECT col1, col2, {r6('chi2')} AS chi2, dof, {r6('CASE WHEN n * md > 0 THEN sqrt(chi2 / (n * md)) END')} AS cramers_v,
  CASE WHEN {r6('CASE WHEN n * md > 0 THEN sqrt(chi2 / (n * md)) END')} IS NULL OR {r6('CASE WHEN n * md > 0 THEN sqrt(chi2 / (n * md)) END')} = 0 THEN 'unknown'
       WHEN {r6('sqrt(chi2 / (n * md))')} >= 0.5 THEN 'strong' WHEN {r6('sqrt(chi2 / (n * md))')} >= 0.3 THEN 'moderate'
       WHEN {r6('sqrt(chi2 / (n * md))')} >= 0.1 THEN 'weak' ELSE 'negligible' END AS association
FROM st"""


register("chi_square_pairs", _chi_sql())(
    lambda spark, sf: H.chi_square_pairs(_ord(spark, sf), CAT4, with_p=False))
register("chi_square_pvalues")(lambda spark, sf: H.chi_square_pairs(_ord(spark, sf), CAT4, with_p=True))

NUM2 = ["o_totalprice", "o_custkey"]


def _group_long_sql(cats, nums):
    parts = [f"SELECT '{c}' AS cat_col, CAST({c} AS VARCHAR) AS level, '{x}' AS \"column\", CAST({x} AS DOUBLE) AS value "
             f"FROM {ORD_SQL} WHERE {c} IS NOT NULL AND {x} IS NOT NULL" for c in cats for x in nums]
    return "(" + " UNION ALL ".join(parts) + ")"


def _ttest_sql():
    return f"""WITH l AS {_group_long_sql(['o_big', 'o_urgent'], NUM2)},
 m0 AS (SELECT cat_col, "column", level, count(value) AS n, avg(value) AS mean, var_samp(value) AS var,
   quantile_cont(value, 0.5) AS median FROM l GROUP BY ALL),
 m AS (SELECT *, row_number() OVER (PARTITION BY cat_col, "column" ORDER BY level) AS g FROM m0),
 z AS (SELECT l.cat_col, l."column", l.level, abs(l.value - m.median) AS z FROM l JOIN m USING (cat_col, "column", level)),
 zg AS (SELECT cat_col, "column", level, count(*) AS n, avg(z) AS zm, sum(z * z) AS zz, sum(z) AS zs FROM z GROUP BY ALL),
 lev AS (SELECT cat_col, "column", sum(n) AS nn, count(*) AS k, sum(zs) AS ZS, sum(zz - n * zm * zm) AS ssw,
   sum(n * zm * zm) AS nzm2 FROM zg GROUP BY ALL),
 levw AS (SELECT cat_col, "column", (nn - k) * (nzm2 - nn * (ZS / nn) * (ZS / nn)) / ((k - 1) * ssw) AS levene_w FROM lev),
 rk AS (SELECT cat_col, "column", level, rank() OVER (PARTITION BY cat_col, "column" ORDER BY value)
   + (count(*) OVER (PARTITION BY cat_col, "column", value) - 1) / 2.0 AS rnk FROM l),
 u AS (SELECT rk.cat_col, rk."column", sum(rnk) - count(*) * (count(*) + 1) / 2.0 AS u FROM rk
   JOIN m ON m.cat_col = rk.cat_col AND m."column" = rk."column" AND m.level = rk.level AND m.g = 1 GROUP BY ALL),
 a AS (SELECT * FROM m WHERE g = 1), b AS (SELECT * FROM m WHERE g = 2),
 j AS (SELECT a.cat_col, a."column", a.level AS l1, b.level AS l2, a.n AS n1, b.n AS n2, a.mean AS m1, b.mean AS m2,
   a.var AS v1, b.var AS v2, a.median AS md1, b.median AS md2 FROM a JOIN b USING (cat_col, "column") WHERE a.n >= 3 AND b.n >= 3)
SELECT j.cat_col, j."column" AS numeric_col, l1 AS group1_label, l2 AS group2_label, n1 AS n_group1, n2 AS n_group2,
  {r6('m1')} AS group1_mean, {r6('m2')} AS group2_mean, {r6('md1')} AS group1_median, {r6('md2')} AS group2_median,
  {r6('levene_w')} AS levene_w, {r6('u')} AS mannwhitney_u,
  {r6('CASE WHEN sqrt((v1 + v2) / 2) > 0 THEN (m1 - m2) / sqrt((v1 + v2) / 2) END')} AS cohens_d,
  {r6('(m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2))')} AS t_student,
  {r6('(m1 - m2) / sqrt(v1 / n1 + v2 / n2)')} AS t_welch
FROM j JOIN levw USING (cat_col, "column") JOIN u USING (cat_col, "column")"""


def _effect(e):
    return (f"CASE WHEN {e} IS NULL OR {e} = 0 THEN 'unknown' WHEN abs({e}) >= 0.8 THEN 'large' WHEN abs({e}) >= 0.5 THEN 'medium' "
            f"WHEN abs({e}) >= 0.2 THEN 'small' ELSE 'negligible' END")


register("ttest_pairs", f"SELECT *, {_effect('cohens_d')} AS effect_size FROM ({_ttest_sql()})")(
    lambda spark, sf: H.ttest_pairs(_ord(spark, sf), ["o_big", "o_urgent"], NUM2, with_p=False))
register("ttest_pvalues")(lambda spark, sf: H.ttest_pairs(_ord(spark, sf), ["o_big", "o_urgent"], NUM2, with_p=True))
register("cohens_d", f"SELECT cat_col, numeric_col, cohens_d, {_effect('cohens_d')} AS effect_size FROM ({_ttest_sql()})")(
    lambda spark, sf: H.ttest_pairs(_ord(spark, sf), ["o_big", "o_urgent"], NUM2, with_p=False)
    .select("cat_col", "numeric_col", "cohens_d", "effect_size"))


def _levene_sql(cat, num):
    return f"""WITH l AS {_group_long_sql([cat], [num])},
 m AS (SELECT cat_col, "column", level, quantile_cont(value, 0.5) AS median FROM l GROUP BY ALL),
 zg AS (SELECT l.cat_col, l."column", l.level, count(*) AS n, avg(abs(value - median)) AS zm,
   sum(abs(value - median) * abs(value - median)) AS zz, sum(abs(value - median)) AS zs FROM l JOIN m USING (cat_col, "column", level) GROUP BY ALL),
 lev AS (SELECT cat_col, "column", sum(n) AS nn, count(*) AS k, sum(zs) AS ZS, sum(zz - n * zm * zm) AS ssw, sum(n * zm * zm) AS nzm2 FROM zg GROUP BY ALL)
SELECT cat_col, "column", {r6('(nn - k) * (nzm2 - nn * (ZS / nn) * (ZS / nn)) / ((k - 1) * ssw)')} AS levene_w, k - 1 AS d1, CAST(nn - k AS BIGINT) AS d2 FROM lev"""


register("levene", _levene_sql("o_orderstatus", "o_totalprice"))(
    lambda spark, sf: H.levene(_ord(spark, sf), "o_orderstatus", "o_totalprice", with_p=False))

register("mann_whitney", f"""WITH l AS {_group_long_sql(['o_urgent'], ['o_totalprice'])},
 rk AS (SELECT cat_col, "column", level, rank() OVER (PARTITION BY cat_col, "column" ORDER BY value)
   + (count(*) OVER (PARTITION BY cat_col, "column", value) - 1) / 2.0 AS rnk FROM l)
SELECT cat_col, "column", {r6('sum(rnk) - count(*) * (count(*) + 1) / 2.0')} AS mannwhitney_u FROM rk
WHERE level = (SELECT min(level) FROM l) GROUP BY ALL""")(
    lambda spark, sf: H.mann_whitney(_ord(spark, sf), "o_urgent", "o_totalprice", with_p=False))


def _anova_sql():
    return f"""WITH l AS {_group_long_sql(['o_orderpriority', 'o_orderstatus'], NUM2)},
 g AS (SELECT cat_col, "column", level, count(value) AS n, avg(value) AS mean, var_samp(value) AS var FROM l GROUP BY ALL),
 keep AS (SELECT * FROM g WHERE n >= 3),
 gm AS (SELECT 'o_totalprice' AS "column", avg(o_totalprice) AS gm FROM orders UNION ALL SELECT 'o_custkey', avg(o_custkey) FROM orders),
 ag AS (SELECT cat_col, keep."column", count(*) AS k, sum(n) AS nn, sum(n * mean) / sum(n) AS im,
   sum((n - 1) * coalesce(var, 0.0)) AS ssw, sum(n * (mean - gm) * (mean - gm)) AS ssb_g FROM keep JOIN gm USING ("column") GROUP BY ALL),
 ab AS (SELECT ag.*, (SELECT sum(n * (mean - ag.im) * (mean - ag.im)) FROM keep WHERE keep.cat_col = ag.cat_col AND keep."column" = ag."column") AS ssb FROM ag WHERE k >= 2),
 inc AS (SELECT l.* FROM l JOIN keep USING (cat_col, "column", level)),
 rk AS (SELECT cat_col, "column", level, rank() OVER (PARTITION BY cat_col, "column" ORDER BY value)
   + (count(*) OVER (PARTITION BY cat_col, "column", value) - 1) / 2.0 AS rnk FROM inc),
 rs AS (SELECT cat_col, "column", sum(rg * rg / ng) AS r2n FROM (SELECT cat_col, "column", level, sum(rnk) AS rg, count(*) AS ng FROM rk GROUP BY ALL) GROUP BY ALL),
 ties AS (SELECT cat_col, "column", sum(c * c * c - c) AS tsum FROM (SELECT cat_col, "column", value, count(*) AS c FROM inc GROUP BY ALL) GROUP BY ALL)
SELECT ab.cat_col, ab."column" AS numeric_col, k AS n_groups, CAST(nn AS BIGINT) AS N,
  {r6('(ssb / (k - 1)) / (ssw / (nn - k))')} AS f_statistic,
  {r6('(12.0 / (nn * (nn + 1)) * r2n - 3 * (nn + 1)) / (1 - tsum / (nn * nn * nn - nn))')} AS kruskal_h,
  {r6('ssb_g / (ssw + ssb_g)')} AS eta_squared
FROM ab JOIN rs USING (cat_col, "column") JOIN ties USING (cat_col, "column")"""


def _eta_effect(e):
    return (f"CASE WHEN {e} IS NULL OR {e} = 0 THEN 'unknown' WHEN {e} >= 0.14 THEN 'large' WHEN {e} >= 0.06 THEN 'medium' "
            f"WHEN {e} >= 0.01 THEN 'small' ELSE 'negligible' END")


def _anova_q(spark, sf):
    return H.anova(_ord(spark, sf), ["o_orderpriority", "o_orderstatus"], NUM2, with_p=False)


register("anova", f"SELECT *, {_eta_effect('eta_squared')} AS effect_size FROM ({_anova_sql()})")(_anova_q)
register("anova_pvalues")(lambda spark, sf: H.anova(_ord(spark, sf), ["o_orderpriority", "o_orderstatus"], NUM2, with_p=True))
register("kruskal_wallis", f"SELECT cat_col, numeric_col, kruskal_h FROM ({_anova_sql()})")(
    lambda spark, sf: _anova_q(spark, sf).select("cat_col", "numeric_col", "kruskal_h"))
register("eta_squared", f"SELECT cat_col, numeric_col, eta_squared, {_eta_effect('eta_squared')} AS effect_size FROM ({_anova_sql()})")(
    lambda spark, sf: _anova_q(spark, sf).select("cat_col", "numeric_col", "eta_squared", "effect_size"))

register("leakage_audit", f"""SELECT f AS feature, {r6('abs(r)')} AS abs_r,
  CASE WHEN {r6('abs(r)')} >= 0.98 THEN 'leaky' WHEN {r6('abs(r)')} >= 0.95 THEN 'suspect' ELSE 'ok' END AS verdict FROM (
  SELECT 'l_quantity' AS f, corr(l_quantity, l_extendedprice) AS r FROM lineitem UNION ALL
  SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM lineitem UNION ALL
  SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem)""")(
    lambda spark, sf: H.leakage_audit(t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))

register("discretize_quantile", """WITH q AS (SELECT list_distinct(quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0])) AS e FROM events)
SELECT event_id, CASE WHEN value IS NOT NULL THEN greatest(len(list_filter(e, lambda v: v < value)) - 1, 0) END AS value_code FROM events, q""")(
    lambda spark, sf: H.discretize_quantile(t(spark, sf, "events"), "value").select("event_id", "value_code"))

register("mutual_information", f"""WITH j AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL),
 c AS (SELECT j.*, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS nn FROM j)
SELECT 'o_orderstatus' AS col_a, 'o_orderpriority' AS col_b, {r6('sum(n * ln(n)) / any_value(nn) - sum(n * ln(na)) / any_value(nn) - sum(n * ln(nb)) / any_value(nn) + ln(any_value(nn))')} AS mutual_information FROM c""")(
    lambda spark, sf: H.mutual_information(t(spark, sf, "orders"), "o_orderstatus", "o_orderpriority"))

register("bic_local_score", f"""WITH j AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
 w AS (SELECT *, sum(n) OVER (PARTITION BY o_orderstatus) AS np FROM j)
SELECT 'o_orderpriority' AS child, 'o_orderstatus' AS parents,
  {r6('sum(n * ln(n / np)) - 0.5 * count(DISTINCT o_orderstatus) * greatest(0, count(DISTINCT o_orderpriority) - 1) * ln(greatest(sum(n), 1))')} AS bic FROM w""")(
    lambda spark, sf: H.bic_local_score(t(spark, sf, "orders"), "o_orderpriority", ["o_orderstatus"]))

register("dependency_network")(lambda spark, sf: H.dependency_network(
    t(spark, sf, "lineitem").withColumn("l_gross", F.col("l_extendedprice") * (1 - F.col("l_discount"))),
    LI + ["l_gross", "l_partkey"]))

register("correlation_network", f"""WITH p AS ({_pearson_sql('lineitem', LI)}),
 s AS (SELECT * FROM p WHERE abs_r >= 0.6),
 src AS (SELECT * FROM s UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM s))
SELECT col1 AS source, col2 AS target, pearson_r AS weight FROM src""")(
    lambda spark, sf: H.correlation_network(t(spark, sf, "lineitem"), LI)[0])
