"""Registered schema / type / role queries (T1-T13) with DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import schema as S
from ..session import TABLES
from .catalog import register
from .sqlgen import long_sql, r6
from .tables import t

DTYPE_SQL = ("CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
             "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' "
             "ELSE lower(data_type) END")


def _meta_sql(table: str) -> str:
    return (f"(SELECT CAST(ordinal_position - 1 AS INTEGER) AS ordinal, column_name AS \"column\", {DTYPE_SQL} AS dtype "
            f"FROM information_schema.columns WHERE table_name = '{table}')")


def _tags_sql(table: str, texts: list[str]) -> str:
    parts = []
    for c in texts:
        parts.append(f"""SELECT '{c}' AS "column", avg(CAST(TRY_CAST(v AS TIMESTAMP) IS NOT NULL AS DOUBLE)) AS hit,
  count(DISTINCT CASE WHEN TRY_CAST(trim(v) AS DOUBLE) IS NOT NULL AND NOT isinf(TRY_CAST(trim(v) AS DOUBLE))
                      AND NOT isnan(TRY_CAST(trim(v) AS DOUBLE)) THEN 'number'
                      WHEN TRY_CAST(v AS TIMESTAMP) IS NOT NULL THEN 'date' ELSE 'text' END) AS kinds
  FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {table} WHERE {c} IS NOT NULL)""")
    txt = " UNION ALL ".join(parts)
    return f"""SELECT m.ordinal, m."column", m.dtype,
  CASE WHEN m.dtype = 'boolean' THEN 'boolean' WHEN m.dtype LIKE 'timestamp%' OR m.dtype = 'date' THEN 'datetime'
       WHEN m.dtype IN ('bigint', 'int', 'double', 'float', 'smallint', 'tinyint') THEN 'numeric'
       WHEN x.hit >= 0.8 THEN 'datetime_string' WHEN x.kinds > 1 THEN 'mixed' ELSE 'categorical' END AS tag
FROM {_meta_sql(table)} m LEFT JOIN ({txt}) x ON m."column" = x."column\""""


register("column_tags", _tags_sql("events", ["event_type", "props"]))(
    lambda spark, sf: S.column_tags(t(spark, sf, "events")))


def _overview_sql():
    tags = _tags_sql("events", ["event_type", "props"])
    agg = ", ".join(
        f"coalesce(string_agg(CASE WHEN tag = '{k}' THEN \"column\" END, ',' ORDER BY ordinal), '') AS {k}_cols"
        for k in ("numeric", "categorical", "datetime", "datetime_string", "boolean", "mixed"))
    return f"""SELECT (SELECT count(*) FROM events) AS n_rows, CAST(count(*) AS BIGINT) AS n_columns, {agg},
  'props' AS target, 'fallback_last_column' AS target_source FROM ({tags})"""


register("overview", _overview_sql())(lambda spark, sf: S.overview(t(spark, sf, "events")))

register("infer_task_type", """SELECT 'quality' AS target, count(DISTINCT quality) AS n_distinct,
  CASE WHEN count(DISTINCT quality) <= 20 THEN 'classification' ELSE 'regression' END AS task_type FROM labels""")(
    lambda spark, sf: S.infer_task_type(t(spark, sf, "labels"), "quality"))


def _cust_text(spark, sf):
    c = t(spark, sf, "customer")
    return c.select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("acct_text"), "c_mktsegment",
                    "c_nationkey", (F.col("c_custkey") % 2).cast("int").alias("c_parity"))


CUST_TEXT_SQL = """(SELECT c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS acct_text, c_mktsegment, c_nationkey,
  CAST(c_custkey % 2 AS INTEGER) AS c_parity FROM customer)"""


def _dtype_audit_sql():
    src = CUST_TEXT_SQL
    return f"""WITH n AS (SELECT count(*) AS rows_ FROM {src}),
 x AS (
  SELECT 'c_custkey' AS "column", 'bigint' AS current_dtype,
    CASE WHEN (SELECT count(DISTINCT c_custkey) FROM {src}) = (SELECT rows_ FROM n) THEN 'possible_id_column' END AS issue
  UNION ALL SELECT 'c_name', 'string',
    CASE WHEN avg(CASE WHEN c_name IS NOT NULL THEN CAST(TRY_CAST(trim(c_name) AS DOUBLE) IS NOT NULL AS DOUBLE) END) >= 0.95
         THEN 'numeric_as_object' END FROM {src}
  UNION ALL SELECT 'acct_text', 'string',
    CASE WHEN avg(CASE WHEN acct_text IS NOT NULL THEN CAST(TRY_CAST(trim(acct_text) AS DOUBLE) IS NOT NULL AS DOUBLE) END) >= 0.95
         THEN 'numeric_as_object' END FROM {src}
  UNION ALL SELECT 'c_mktsegment', 'string',
    CASE WHEN avg(CASE WHEN c_mktsegment IS NOT NULL THEN CAST(TRY_CAST(trim(c_mktsegment) AS DOUBLE) IS NOT NULL AS DOUBLE) END) >= 0.95
         THEN 'numeric_as_object' END FROM {src}
  UNION ALL SELECT 'c_nationkey', 'int',
    CASE WHEN count(DISTINCT c_nationkey) = count(*) THEN 'possible_id_column'
         WHEN bool_and(coalesce(c_nationkey IN (0, 1), true)) THEN 'possible_boolean_as_int' END FROM {src}
  UNION ALL SELECT 'c_parity', 'int',
    CASE WHEN count(DISTINCT c_parity) = count(*) THEN 'possible_id_column'
         WHEN bool_and(coalesce(c_parity IN (0, 1), true)) THEN 'possible_boolean_as_int' END FROM {src})
SELECT * FROM x WHERE issue IS NOT NULL"""


register("dtype_audit", _dtype_audit_sql())(lambda spark, sf: S.dtype_audit(_cust_text(spark, sf)))

LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
          "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _card_sql(table, cols):
    parts = [f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique, count(*) AS rows_ FROM {table}" for c in cols]
    return f"""SELECT "column", n_unique, round(n_unique / rows_ * 100, 2) AS pct_unique,
  CASE WHEN n_unique <= 1 THEN 'constant' WHEN n_unique = 2 THEN 'binary' WHEN n_unique = rows_ THEN 'id_like'
       WHEN n_unique <= 20 THEN 'low_card' ELSE 'high_card' END AS tag FROM ({" UNION ALL ".join(parts)})"""


register("cardinality_audit", _card_sql("lineitem", LI_ALL))(
    lambda spark, sf: S.cardinality_audit(t(spark, sf, "lineitem")))

register("split_by_cardinality", """SELECT "column", count(DISTINCT value) AS n_unique,
  CASE WHEN count(DISTINCT value) <= 15 THEN 'low' ELSE 'high' END AS "group"
FROM """ + long_sql("part", ["p_name", "p_brand", "p_type"], cast="VARCHAR") + " GROUP BY \"column\"")(
    lambda spark, sf: S.split_by_cardinality(t(spark, sf, "part")))


def _all_meta(spark, sf):
    frames = [S.column_meta(t(spark, sf, n)).select(F.lit(n).alias("table_name"), "column") for n in TABLES]
    return reduce(lambda a, b: a.unionByName(b), frames)


ALL_META_SQL = ("(SELECT table_name, column_name AS \"column\" FROM information_schema.columns WHERE table_name IN ("
                + ", ".join(f"'{n}'" for n in TABLES) + "))")


def _role_case_sql():
    parts = " ".join(f"WHEN regexp_matches(\"column\", '(?i){pat}') THEN '{role}'" for role, pat in S.ROLE_PATTERNS)
    return f"CASE {parts} ELSE 'unknown' END"


def _roles(spark, sf):
    m = _all_meta(spark, sf)
    return m.select("table_name", "column", S.role_of(F.col("column")).alias("role"))


register("column_roles", f"SELECT table_name, \"column\", {_role_case_sql()} AS role FROM {ALL_META_SQL}")(_roles)

register("flag_columns", f"""SELECT table_name, "column" FROM {ALL_META_SQL}
WHERE regexp_matches("column", '(?i){S.FLAG_PATTERN}')""")(
    lambda spark, sf: _all_meta(spark, sf).where(F.col("column").rlike("(?i)" + S.FLAG_PATTERN)))

register("numeric_feature_names", f"""SELECT "column" FROM {_meta_sql('part')}
WHERE "column" <> 'p_retailprice' AND NOT regexp_matches("column", '(?i){S.KNOWN_BINARY_PATTERN}')""")(
    lambda spark, sf: S.numeric_feature_names(t(spark, sf, "part"), "p_retailprice"))

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _select_num_sql():
    return f"""SELECT "column", CAST(count(value) AS BIGINT) AS non_null,
  abs(coalesce({r6('var_samp(value)')}, 0.0)) AS variance
FROM {long_sql('lineitem', LI_NUM)} GROUP BY "column" HAVING count(value) >= 25 AND count(DISTINCT value) >= 3
"""


register("select_numeric_columns", _select_num_sql())(
    lambda spark, sf: S.select_numeric_columns(t(spark, sf, "lineitem"), LI_NUM))


def _feature_schema_sql():
    feats = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    parts = [f"SELECT '{c}' AS \"column\", CAST(arg_min({c}, c_custkey) AS VARCHAR) AS example FROM customer" for c in feats]
    return f"""SELECT m.ordinal, m."column", m.dtype, x.example FROM {_meta_sql('customer')} m
JOIN ({" UNION ALL ".join(parts)}) x ON m."column" = x."column\""""


register("feature_schema", _feature_schema_sql())(
    lambda spark, sf: S.feature_schema(t(spark, sf, "customer"), "c_acctbal", ["c_custkey"]))


def _kpi_names_sql():
    from ..operators.profile import KPI_KEYWORDS
    hit = " OR ".join(f"contains(lower(\"column\"), '{k}')" for k in KPI_KEYWORDS)
    return f"""WITH m AS (SELECT ordinal, "column", {hit} AS hit FROM {_meta_sql('lineitem')}
   WHERE dtype IN ('bigint', 'int', 'double')),
 r AS (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY ordinal) AS rn FROM m)
SELECT ordinal, "column" FROM r WHERE hit = (SELECT bool_or(hit) FROM m)"""


register("kpi_columns", _kpi_names_sql())(lambda spark, sf: S.kpi_column_names(t(spark, sf, "lineitem")))
