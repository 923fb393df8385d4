"""Scalar column functions (P32-P39 and shared expression helpers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rounding used by every reported float.
ROUND_DIGITS = 6


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NULL for NaN and +-Infinity."""
    x = c(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def safe_round(x, digits: int = ROUND_DIGITS) -> Column:
    """Round to 6 places; NaN and Inf become NULL."""
    return F.round(finite(x), digits) + F.lit(0.0)  # + 0.0 folds -0.0 into 0.0


def div(a, b) -> Column:
    """Division that yields NULL on a zero divisor, ANSI mode or not."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def to_number(x) -> Column:
    """Unparsable text and +-Inf become NULL."""
    return finite(F.trim(c(x).cast("string")).try_cast("double"))


def to_date(x, formats: list[str] | None = None) -> Column:
    """Unparsable values become NULL."""
    col = c(x)
    if formats:
        return F.coalesce(*[F.try_to_timestamp(col.cast("string"), F.lit(f)) for f in formats])
    return col.cast("string").try_cast("timestamp")


def strength_label(abs_r) -> Column:
    """Correlation strength bands."""
    a = c(abs_r)
    return (F.when(a.isNull(), "unknown").when(a >= 0.8, "very strong").when(a >= 0.6, "strong")
            .when(a >= 0.4, "moderate").when(a >= 0.2, "weak").otherwise("negligible"))


def skew_label(skew) -> Column:
    """A2: skewness bands."""
    s = c(skew)
    return (F.when(s.isNull(), "unknown").when(s > 1, "heavy right skew")
            .when(s > 0.5, "moderate right skew").when(s < -1, "heavy left skew")
            .when(s < -0.5, "moderate left skew").otherwise("approximately symmetric"))


def clean_name(x, project: bool = False) -> Column:
    """Runs of unsafe characters become '_', trimmed of '_'.

    Model names keep [A-Za-z0-9_.-]; project names keep alphanumerics, '-' and '_'.
    """
    pattern = r"[^A-Za-z0-9_\-]+" if project else r"[^A-Za-z0-9_.\-]+"
    return F.regexp_replace(F.regexp_replace(c(x), pattern, "_"), r"^_+|_+$", "")


# Message tag keyword classes, checked in this order (lower-cased text).
MESSAGE_TAG_WORDS = [
    ("DONE", ["\u2705", "complete", "done", "deployed", "approved", "passed", "ci passed"]),
    ("ALERT", ["\U0001f534", "critical", "exploit", "blocked", "\u274c"]),
    ("REPORT", ["found", "result", "report", "eda", "accuracy", "score", "metric"]),
]


def message_tag(x) -> Column:
    """Ordered keyword classes, else STATUS."""
    low = F.lower(F.coalesce(c(x), F.lit("")))
    expr = None
    for tag, words in MESSAGE_TAG_WORDS:
        cond = None
        for w in words:
            cw = low.contains(w)
            cond = cw if cond is None else (cond | cw)
        expr = F.when(cond, tag) if expr is None else expr.when(cond, tag)
    return expr.otherwise("STATUS")


def token_estimate(x) -> Column:
    """max(1, floor(chars / 4))."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(F.coalesce(c(x), F.lit(""))) / 4).cast("long"))


def preview_text(x, n: int = 200) -> Column:
    """First n characters, NULL as empty."""
    return F.substring(F.coalesce(c(x).cast("string"), F.lit("")), 1, n)


def stable_bucket(key, n: int) -> Column:
    """md5 bucket of a key, identical in DuckDB: ('0x'||substr(md5(k),1,8))::BIGINT % n."""
    h = F.conv(F.substring(F.md5(c(key).cast("string")), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(n)).cast("long")


def stable_unit(key) -> Column:
    """md5 hash of a key mapped to [0, 1)."""
    h = F.conv(F.substring(F.md5(c(key).cast("string")), 1, 8), 16, 10).cast("double")
    return h / F.lit(4294967296.0)


def test_order(p, *ties):
    """K3: sort keys of a table of tests: ascending p with null as 1, then the given columns."""
    return [F.coalesce(c(p), F.lit(1.0)), *[c(x) for x in ties]]
