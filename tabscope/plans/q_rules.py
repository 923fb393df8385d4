"""Registered rule-scan (X1-X5) and rule-driven (V1-V4) queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as X
from .catalog import register
from .tables import t

# Rule table that hits on the pages table (parameters; the stock rules are unit-tested).
PAGE_RULES = [("any", "<script", "HIGH", "Inline script block"), ("any", "license", "LOW", "License text"),
              ("any", "@", "MEDIUM", "Possible e-mail address"), ("any", "eval(", "HIGH", "Code injection — eval()")]
STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _s(x):
    return STRIP.format(x=x)


def _lines_sql(table, id_col, text_col):
    return f"""(SELECT {id_col} AS file_id, unnest(string_split(coalesce({text_col}, ''), chr(10))) AS line,
  generate_subscripts(string_split(coalesce({text_col}, ''), chr(10)), 1) AS line_no FROM {table}
  WHERE NOT contains(coalesce({text_col}, ''), '[file not yet written]'))"""


def _rules_sql(rules):
    return "(VALUES " + ", ".join("('{}', '{}', '{}', '{}')".format(*[str(v).replace("'", "''") for v in r]) for r in rules) + \
        ") rt(rule_group, pattern, severity, issue)"


def _scan_sql(rules, skip_comments=("#", "//"), skip_present=tuple(X.SKIP_IF_PRESENT)):
    conds = [f"NOT starts_with({_s('line')}, '{p}')" for p in skip_comments]
    conds += [f"NOT contains(line, '{w}')" for w in skip_present]
    where = " AND ".join(conds) or "true"
    return f"""SELECT file_id, line_no, severity, issue, pattern, substr({_s('line')}, 1, 80) AS code
FROM {_lines_sql('pages', 'page_id', 'html')} l JOIN {_rules_sql(rules)} ON contains(lower(line), lower(pattern)) WHERE {where}"""


def _pages(spark, sf):
    return t(spark, sf, "pages")


register("scan_lines", _scan_sql(PAGE_RULES))(lambda spark, sf: X.scan_lines(_pages(spark, sf), "page_id", "html", None, PAGE_RULES))

# Pages with a line of code of each exploit rule in turn, a third of them commented out (both engines).
_CODE = " ".join("WHEN {} THEN 'x = {}'".format(i, p.replace("'", "''")) for i, (p, _, _) in enumerate(X.EXPLOIT_RULES))
CODE_PAGES_SQL = f"""(SELECT page_id, coalesce(html, '') || chr(10) || CASE WHEN page_id % 3 = 0 THEN '# ' ELSE '  ' END
  || CASE page_id % {len(X.EXPLOIT_RULES)} {_CODE} END AS html FROM pages)"""


def _code_pages(spark, sf):
    _pages(spark, sf).createOrReplaceTempView("pages")
    return spark.sql(f"SELECT * FROM {CODE_PAGES_SQL}")


register("scan_exploit_patterns", _scan_sql([("any", p, s, d) for p, s, d in X.EXPLOIT_RULES], ("#",), ()).replace(
    "issue, pattern", "issue AS description, pattern").replace("FROM pages", f"FROM {CODE_PAGES_SQL}"))(
    lambda spark, sf: X.scan_exploit_patterns(_code_pages(spark, sf), "page_id", "html"))


def _fix_sql():
    fixes = "(VALUES " + ", ".join(f"({i}, '{k.lower()}', '{v.replace(chr(39), chr(39) * 2)}')" for i, (k, v) in enumerate(X.FIXES)) + ") ft(ord, key, fix)"
    return f"""WITH f AS ({_scan_sql(PAGE_RULES)})
SELECT f.*, coalesce(arg_min(fix, ord), '{X.DEFAULT_FIX}') AS fix FROM f LEFT JOIN {fixes} ON contains(lower(pattern), key)
GROUP BY ALL"""


register("attach_fix", _fix_sql())(
    lambda spark, sf: X.attach_fix(X.scan_lines(_pages(spark, sf), "page_id", "html", None, PAGE_RULES)))

register("severity_rollup", f"""WITH f AS ({_scan_sql(PAGE_RULES)})
SELECT file_id, count_if(severity = 'CRITICAL') AS critical, count_if(severity = 'HIGH') AS high,
  count_if(severity = 'MEDIUM') AS medium, count_if(severity = 'LOW') AS low, count_if(severity = 'HIGH') = 0 AS sast_passed,
  count_if(severity = 'CRITICAL') = 0 AND count_if(severity = 'HIGH') = 0 AS pentest_passed FROM f GROUP BY file_id""")(
    lambda spark, sf: X.severity_rollup(X.scan_lines(_pages(spark, sf), "page_id", "html", None, PAGE_RULES)))
