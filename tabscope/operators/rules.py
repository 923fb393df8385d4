"""X1-X5 rule scans over text tables.

A rule table is small and fixed, so line x rule matching is a broadcast
nested-loop join with ``contains``: the work grows with the lines, not the rules.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_round as R

# Source-scan rules (file group, pattern, severity, issue).
SECURITY_RULES = [
    ("py", "postgresql://", "HIGH", "Hardcoded database connection string"),
    ("py", "mysql://", "HIGH", "Hardcoded database connection string"),
    ("py", "password =", "HIGH", "Hardcoded password literal"),
    ("py", "secret_key =", "HIGH", "Hardcoded secret key"),
    ("py", "api_key =", "HIGH", "Hardcoded API key"),
    ("py", "open(", "MEDIUM", "Unvalidated file open — check for path traversal"),
    ("py", "DB_CONN =", "HIGH", "Hardcoded DB connection (use os.getenv)"),
    ("js", "dangerouslySetInnerHTML", "HIGH", "XSS risk — dangerouslySetInnerHTML without DOMPurify"),
    ("js", "innerHTML =", "MEDIUM", "XSS risk — direct innerHTML assignment"),
    ("js", "eval(", "HIGH", "Code injection — eval() with user input"),
]
FILE_GROUPS = {"py": "py", "python": "py", "jsx": "js", "tsx": "js", "js": "js", "ts": "js"}
SKIP_IF_PRESENT = ["os.getenv", "process.env", "DOMPurify"]
PLACEHOLDER = "[file not yet written]"

# Runtime exploit patterns (pattern, severity, description).
EXPLOIT_RULES = [
    ("pickle", "CRITICAL", "Unsafe deserialization — pickle.loads() with user input"),
    ("os.system(", "CRITICAL", "Command injection — os.system() with unsanitized input"),
    ("subprocess.call(", "HIGH", "Command injection risk — subprocess with shell=True"),
    ("eval(", "CRITICAL", "Code injection — eval() with user input"),
    ("exec(", "CRITICAL", "Code injection — exec() with user input"),
    ("/api/debug", "MEDIUM", "Debug endpoint accessible in production"),
    ("DEBUG = True", "MEDIUM", "Django/Flask debug mode enabled"),
    ("0.0.0.0", "LOW", "Server binding to all interfaces — verify intended"),
]

# Package advisories (package, operator, version, advisory).
ADVISORIES = [
    ("requests", "==", "2.28", "CVE-2023-32681 (SSRF via Proxy-Authorization header leakage)"),
    ("requests", "<", "2.31", "CVE-2023-32681"),
    ("numpy", "<", "1.24", "CVE-2021-34141 (buffer overflow in string operations)"),
    ("pillow", "<", "9.3", "CVE-2022-45199 (denial of service via crafted image)"),
]

# Remediation advice per pattern.
FIXES = [
    ("postgresql://", "Use os.getenv('DB_CONN_STR') instead of hardcoded URL"),
    ("mysql://", "Use os.getenv('DB_CONN_STR') instead of hardcoded URL"),
    ("password =", "Store in environment variable, read with os.getenv()"),
    ("secret_key =", "Store in environment variable, read with os.getenv()"),
    ("api_key =", "Store in environment variable, read with os.getenv()"),
    ("open(", "Sanitize path with os.path.realpath(os.path.abspath(path))"),
    ("dangerouslySetInnerHTML", "Wrap value with DOMPurify.sanitize() before rendering"),
    ("innerHTML =", "Use textContent or DOMPurify.sanitize()"),
    ("eval(", "Never use eval() with user-supplied input"),
    ("DB_CONN =", "Replace with DB_CONN_STR = os.getenv('DB_CONN_STR')"),
]
DEFAULT_FIX = "Review and remediate"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines_of(df: DataFrame, id_col: str, text_col: str, extra: Sequence[str] = ()) -> DataFrame:
    """(id, extra..., line_no 1-based, line) from each text (Python splitlines)."""
    from .retrieval import split_lines
    x = df.where(~F.coalesce(F.col(text_col), F.lit("")).contains(PLACEHOLDER))
    return x.select(F.col(id_col).alias("file_id"), *extra, F.posexplode(split_lines(F.coalesce(F.col(text_col), F.lit(""))))
                    .alias("pos", "line")).withColumn("line_no", (F.col("pos") + 1).cast("long")).drop("pos")


def scan_lines(df: DataFrame, id_col: str, text_col: str, group_col: str | None = None,
               rules: Sequence[tuple] | None = None, skip_comments: Sequence[str] = ("#", "//"),
               skip_if_present: Sequence[str] = SKIP_IF_PRESENT) -> DataFrame:
    """Every line against the rules of its file group; case-insensitive ``contains``.

    ``group_col`` holds a file extension (mapped to a rule group); with None every rule
    applies (group 'any'). Comment lines and lines using an env lookup are skipped.
    """
    spark = df.sparkSession
    rules = list(rules) if rules is not None else SECURITY_RULES
    rt = spark.createDataFrame(rules, "rule_group string, pattern string, severity string, issue string") \
        .withColumn("_p", F.lower("pattern"))
    extra = [F.col(group_col).alias("_ext")] if group_col else []
    ln = lines_of(df, id_col, text_col, extra)
    st = _strip(F.col("line"))
    keep = F.lit(True)
    for pfx in skip_comments:
        keep = keep & ~st.startswith(pfx)
    for s in skip_if_present:
        keep = keep & ~F.col("line").contains(s)
    ln = ln.where(keep).withColumn("_low", F.lower("line"))
    if group_col:
        grp = F.element_at(F.create_map(*[x for k, v in FILE_GROUPS.items() for x in (F.lit(k), F.lit(v))]),
                           F.lower(F.element_at(F.split(F.col("_ext"), r"\."), -1)))
        ln = ln.withColumn("_grp", grp)
        cond = (F.col("_grp") == F.col("rule_group")) & F.col("_low").contains(F.col("_p"))
    else:
        cond = F.col("_low").contains(F.col("_p"))
    m = ln.join(F.broadcast(rt), cond)
    return m.select("file_id", "line_no", "severity", "issue", "pattern",
                    F.substring(_strip(F.col("line")), 1, 80).alias("code"))


def scan_exploit_patterns(df: DataFrame, id_col: str, text_col: str, rules=EXPLOIT_RULES) -> DataFrame:
    """The runtime exploit patterns; only '#' lines skipped, no env filter."""
    rows = [("any", p, s, d) for p, s, d in rules]
    return scan_lines(df, id_col, text_col, None, rows, skip_comments=("#",), skip_if_present=()) \
        .withColumnRenamed("issue", "description")


def _version_array(v: Column) -> Column:
    return F.transform(F.split(v, r"\."), lambda x: x.try_cast("int"))


def scan_requirements(df: DataFrame, id_col: str, text_col: str, advisories=ADVISORIES) -> DataFrame:
    """Requirement lines x advisories: '==' by exact text, '<' by numeric version order."""
    spark = df.sparkSession
    adv = spark.createDataFrame(advisories, "package string, op string, version string, advisory string")
    ln = lines_of(df, id_col, text_col).withColumn("line", _strip(F.col("line")))
    ln = ln.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    low = F.lower(F.col("line"))
    m = ln.join(F.broadcast(adv), low.contains(F.lower(F.col("package"))))
    installed = F.regexp_extract(F.col("line"), r"[=><]+\s*([\d.]+)", 1)
    eq = (F.col("op") == "==") & low.contains(F.lower(F.concat(F.col("package"), F.lit("=="), F.col("version"))))
    lt = (F.col("op") == "<") & (installed != "") & (_version_array(installed) < _version_array(F.col("version")))
    return m.where(eq | lt).select("file_id", "line", "package", F.concat(F.lit("CVE: "), F.col("advisory")).alias("issue"),
                                   F.lit("MEDIUM").alias("severity"))


def attach_fix(findings: DataFrame, fixes=FIXES, default: str = DEFAULT_FIX) -> DataFrame:
    """Rule -> advice (first fix whose key is contained in the pattern)."""
    spark = findings.sparkSession
    ft = spark.createDataFrame([(i, k.lower(), v) for i, (k, v) in enumerate(fixes)], "ord int, key string, fix string")
    j = findings.withColumn("_pl", F.lower("pattern")).join(F.broadcast(ft), F.col("_pl").contains(F.col("key")), "left")
    keys = [c for c in findings.columns]
    g = j.groupBy(*keys).agg(F.min_by("fix", "ord").alias("fix"))
    return g.withColumn("fix", F.coalesce("fix", F.lit(default)))


def severity_rollup(findings: DataFrame, file_col: str = "file_id") -> DataFrame:
    """Counts by severity per file; sast verdict (no HIGH) and pentest verdict (no CRITICAL, no HIGH)."""
    sev = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    g = findings.groupBy(file_col).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in sev])
    return g.withColumn("sast_passed", F.col("high") == 0) \
        .withColumn("pentest_passed", (F.col("critical") == 0) & (F.col("high") == 0))
