"""Registered queries of V2. The oracles state the rules of three frames by hand: what fires on the facts that DuckDB finds
in the rows, and the features of the regression frame from its own statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import safe_round as R
from ..operators import autofeatures as AF
from .catalog import register
from .sqlgen import r6
from .tables import t

KEYS = ["k1", "k2"]

#: Line items under names that have roles, with missing and far values made by rule; both engines.
REGRESSION_SQL = """SELECT l_orderkey AS k1, l_linenumber AS k2, l_partkey AS part_id,
 CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_quantity END AS quantity, CAST(l_linenumber AS DOUBLE) AS num_lines,
 l_extendedprice * CASE WHEN l_orderkey % 29 = 0 THEN 30 ELSE 1 END AS price, l_discount AS rate,
 CAST(l_partkey % 40 AS DOUBLE) AS area, CAST(l_suppkey % 9 AS DOUBLE) AS width, CAST(l_suppkey % 31 AS DOUBLE) AS age,
 sqrt(l_partkey % 50 * 7 + 3) AS distance, concat('p', CAST(l_partkey % 60 AS STRING)) AS maker,
 CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE l_returnflag END AS returned, CASE l_linestatus WHEN 'O' THEN 'yes' ELSE 'no' END AS is_open,
 CAST(l_tax > 0.04 AS INT) AS is_taxed, CAST(l_discount > 0.05 AS INT) AS has_discount, l_shipdate AS shipped,
 l_extendedprice * l_extendedprice * l_extendedprice / 1e9 AS y FROM lineitem"""

#: A text target, flags that only their role names, importance by correlation, a model that fits too little.
CLASSES_SQL = """SELECT l_orderkey AS k1, l_linenumber AS k2, l_quantity AS depth_a, l_extendedprice AS extended, l_discount AS reduced,
 l_linestatus AS smoker, CAST(l_tax > 0.04 AS INT) AS married, CAST(l_discount > 0.05 AS INT) AS graduate, l_returnflag AS y FROM lineitem"""

#: A left-skewed target and nothing but numbers.
LEFT_SQL = """SELECT l_orderkey AS k1, l_linenumber AS k2, l_discount AS discount, l_tax AS levy,
 -l_extendedprice * l_extendedprice * l_extendedprice / 1e9 AS y FROM lineitem"""

# The class frame's importance: |correlation| with the code point of the class, a letter; both engines.
_IMPORTANT = ["depth_a", "extended", "reduced", "married", "graduate"]


def _frame(spark, sf, sql):
    t(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(sql)


def _importance(df):
    y = F.ascii("y").cast("double")
    row = df.agg(*[F.round(F.abs(F.corr(F.col(c).cast("double"), y)), 6).alias(c) for c in _IMPORTANT])
    return row.unpivot([], _IMPORTANT, "feature", "importance").withColumn("importance", F.coalesce("importance", F.lit(0.0)))


def _plans(spark, sf):
    out = None
    for name, sql, more in (("regression", REGRESSION_SQL, {}), ("classes", CLASSES_SQL, {"underfit": True}), ("left", LEFT_SQL, {})):
        df = _frame(spark, sf, sql)
        if name == "classes":
            more["importance"] = _importance(df)
        table = AF.plan_table(spark, AF.plan_features(df, "y", keys=KEYS, **more)).select(F.lit(name).alias("frame"), "*")
        out = table if out is None else out.union(table)
    return out.withColumn("inputs", F.array_join("inputs", ","))


def _plan_sql() -> str:
    """(frame, priority, place of the rule, rule, name, inputs) where the fact beside it holds."""
    nums = "part_id,quantity,num_lines,price,rate,area,width,age,distance,is_taxed,has_discount"
    far = " OR ".join(f"(SELECT count_if({c} < lo OR {c} > hi) > 0 FROM r, (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, "
                      f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM r) WHERE iqr <> 0)"
                      for c in ("quantity", "price"))
    corr = " UNION ALL ".join(f"SELECT {i} AS ord, '{c}' AS feature, coalesce(round(abs(corr({c}::DOUBLE, ascii(y)::DOUBLE)), 6), 0.0) AS w FROM c" for i, c in enumerate(_IMPORTANT))
    rows = [("regression", 1, 1, "A1", "'log_transform_target'", "'y'", "(SELECT skewness(y) > 0.75 FROM r)"),
            ("regression", 1, 2, "A2", "'impute_missing_values'", f"'{nums},maker,returned,is_open'", "(SELECT count(quantity) < count(*) OR count(returned) < count(*) FROM r)"),
            ("regression", 1, 22, "B10", "'drop_id_columns'", "'part_id'", "true"),
            ("regression", 2, 3, "A3", "'winsorize_outliers'", f"'{nums}'", far),
            ("regression", 2, 4, "A4", "'datetime_cyclical_features'", "'shipped'", "true"),
            ("regression", 3, 5, "A5", "'target_encode_high_cardinality'", "'maker'", "(SELECT count(DISTINCT maker) > 20 FROM r)"),
            ("regression", 3, 11, "B1", "'area_per_quantity'", "'area,quantity'", "true"), ("regression", 3, 12, "B1", "'width_per_quantity'", "'width,quantity'", "true"),
            ("regression", 3, 15, "B5", "'price_per_age'", "'price,age'", "true"),
            ("regression", 4, 6, "A6", "'aggregate_flag_score'", "'is_open,is_taxed,has_discount'", "true"),
            ("regression", 4, 13, "B2", "'area_x_quantity'", "'area,quantity'", "true"), ("regression", 4, 14, "B3", "'quantity_to_num_lines_ratio'", "'quantity,num_lines'", "true"),
            ("regression", 4, 18, "B8", "'price_x_rate'", "'price,rate'", "true"), ("regression", 4, 19, "B9", "'price_per_distance'", "'price,distance'", "true"),
            ("regression", 5, 16, "B6", "'age_bin'", "'age'", "true"), ("regression", 5, 17, "B7", "'area_bin'", "'area'", "true"),
            ("classes", 3, 14, "B4", "'binary_flag_aggregate_score'", "'smoker,married,graduate'", "true"),
            ("classes", 3, 23, "B11", "a || '_x_' || b || '_interaction'", "a || ',' || b", "b IS NOT NULL"),
            ("classes", 4, 24, "B11", "a || '_div_' || b || '_ratio'", "a || ',' || b", "b IS NOT NULL"),
            ("classes", 5, 17, "B7", "'depth_a_bin'", "'depth_a'", "true"),
            ("classes", 6, 25, "B12", "'encode_remaining_categoricals'", "'smoker'", "(SELECT count(DISTINCT y) <= 20 FROM c)"),
            ("classes", 6, 26, "C1", "'polynomial_features'", "'depth_a,extended,reduced,married,graduate'", "true"),
            ("classes", 7, 27, "C2", "'drop_low_importance_features'", "low", "low IS NOT NULL"),
            ("left", 1, 1, "A1", "'reflect_log_target'", "'y'", "(SELECT skewness(y) < -0.75 FROM l)"),
            ("left", 6, 26, "C1", "'polynomial_features'", "'discount,levy'", "true")]
    parts = " UNION ALL ".join(f"SELECT '{f}' AS frame, {p} AS priority, {o} AS place, '{rule}' AS rule, {n} AS name, {i} AS inputs FROM ab WHERE {when}"
                               for f, p, o, rule, n, i, when in rows)
    # married is a known yes/no name and enters no interaction
    return f"""WITH r AS ({REGRESSION_SQL}), c AS ({CLASSES_SQL}), l AS ({LEFT_SQL}), w AS ({corr}),
 top AS (SELECT feature, row_number() OVER (ORDER BY w DESC, feature) AS i FROM w WHERE feature <> 'married'),
 ab AS (SELECT (SELECT feature FROM top WHERE i = 1) AS a, (SELECT feature FROM top WHERE i = 2) AS b,
   (SELECT string_agg(feature, ',' ORDER BY w DESC, feature) FROM w WHERE w < 0.005) AS low), x AS ({parts})
SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY priority, place) AS INTEGER) AS step, CAST(priority AS INTEGER) AS priority, rule, name, inputs FROM x"""


register("feature_plan", _plan_sql())(_plans)


def _auto(spark, sf):
    out, _ = AF.auto_features(_frame(spark, sf, REGRESSION_SQL), "y", KEYS)
    return out.select(*[R(c).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


def _auto_sql() -> str:
    nums = ["quantity", "num_lines", "price", "rate", "area", "width", "age", "distance", "is_taxed", "has_discount"]
    texts = ["maker", "returned", "is_open"]
    filled = ", ".join(f"coalesce({c}::DOUBLE, (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM b)) AS {c}" for c in nums)
    ends = ", ".join(f"quantile_cont({c}, 0.01) AS {c}_a, quantile_cont({c}, 0.99) AS {c}_b" for c in nums)
    clipped = ", ".join(f"least(greatest({c}, {c}_a), {c}_b) AS {c}" for c in nums)

    def per(a, b):
        return f"{a} / CASE WHEN {b} = 0 THEN 1 ELSE {b} END"

    def bins(c, labels):
        edges = [f"(SELECT quantile_cont({c}, {i / len(labels)}) FROM e)" for i in range(1, len(labels))]
        return "CASE " + " ".join(f"WHEN {c} <= {q} THEN '{s}'" for q, s in zip(edges, labels)) + f" ELSE '{labels[-1]}' END"

    month, dow = "2 * pi() * month(shipped) / 12", "2 * pi() * (isodow(shipped) - 1) / 7"
    made = {"y": "y", **{c: c for c in nums}, "maker": "coalesce((sum(y) OVER (PARTITION BY maker) - y) / nullif(count(y) OVER (PARTITION BY maker) - 1, 0), avg(y) OVER ())",
            "shipped_month_sin": f"sin({month})", "shipped_month_cos": f"cos({month})", "shipped_dow_sin": f"sin({dow})", "shipped_dow_cos": f"cos({dow})",
            "area_per_quantity": per("area", "quantity"), "width_per_quantity": per("width", "quantity"), "price_per_age": per("price", "age"),
            "flag_score": "(is_open = 'yes')::INT + is_taxed + has_discount", "area_x_quantity": "area * quantity",
            "quantity_to_num_lines_ratio": per("quantity", "num_lines"), "price_x_rate": "price * rate", "price_per_distance": per("price", "distance")}
    return f"""WITH b AS ({REGRESSION_SQL}),
 f AS (SELECT k1, k2, shipped, ln(1 + y) AS y, {filled}, {', '.join(f"coalesce({c}, 'Unknown') AS {c}" for c in texts)} FROM b),
 q AS (SELECT {ends} FROM f), e AS (SELECT k1, k2, shipped, y, {clipped}, {', '.join(texts)} FROM f, q)
SELECT k1, k2, shipped, returned, is_open, year(shipped) AS shipped_year, CAST(isodow(shipped) >= 6 AS INTEGER) AS shipped_is_weekend, CAST(is_open = 'yes' AS INTEGER) AS is_open_bin,
 {', '.join(f'{r6(x)} AS {n}' for n, x in made.items())}, {bins('age', ['low', 'mid', 'high', 'very_high'])} AS age_bin, {bins('area', ['xs', 's', 'm', 'l', 'xl'])} AS area_bin FROM e"""


register("auto_features", _auto_sql())(_auto)
