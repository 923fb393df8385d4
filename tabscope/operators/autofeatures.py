"""V2: plan features from column roles and statistics, fit the plan once, apply it to any rows.

``plan_features`` reads a profile of the table (one row per column) and fires the rules; ``fit_features`` turns the plan
into SQL expressions whose statistics are literals, plus one dictionary table per encoded column; ``apply_features``
runs them over the fitted rows or over others. Only numbers per column come to the driver, so its work is bounded by
the schema; dictionaries of levels stay tables and are joined by hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import date_columns, numeric_columns, text_columns
from .features import LABELS_Q4, LABELS_Q5, YES_VALUES, column_skews, cyclical_date
from .profile import distinct_counts, outliers_by_column
from .quantiles import exact_quantiles
from .schema import FLAG_PATTERN, HIGH_CARD_THR, KNOWN_BINARY_PATTERN, ROLE_PATTERNS, infer_task_type

# Skewness beyond which a target is transformed, and importance below which a feature is dropped.
TARGET_SKEW = 0.75
LOW_IMPORTANCE = 0.005
# Levels up to which a dictionary of target means is broadcast: a row is a level and two numbers.
BROADCAST_LEVELS = 200_000


@dataclass(frozen=True)
class Step:
    """One planned feature: the rule that fired, the name of the feature, the columns it reads."""
    priority: int
    rule: str
    name: str
    inputs: tuple[str, ...]


@dataclass
class FittedFeatures:
    """A fitted plan. ``ops`` in order: ("set", {name: SQL}), ("drop", columns), ("mean", column), ("code", column)."""
    target: str
    target_number: str
    steps: list[Step]
    ops: list[tuple[str, object]] = field(default_factory=list)
    levels: dict[str, DataFrame] = field(default_factory=dict)
    n_levels: dict[str, int] = field(default_factory=dict)
    overall: float | None = None

    @property
    def spec(self) -> list[tuple[str, str]]:
        """The expressions alone, as an ordered P40 specification."""
        return [(n, e) for kind, op in self.ops if kind == "set" for n, e in op.items()]


def role(name: str) -> str:
    """T8 for one name: the first role whose pattern matches."""
    return next((r for r, p in ROLE_PATTERNS if re.search(p, name, re.I)), "unknown")


def _missing(df: DataFrame, cols: Sequence[str]) -> bool:
    """Whether any of the columns holds a null or NaN."""
    if not cols:
        return False
    real = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    gone = [F.col(_q(c)).isNull() | F.isnan(_q(c)) if c in real else F.col(_q(c)).isNull() for c in cols]
    any_gone = gone[0]
    for g in gone[1:]:
        any_gone = any_gone | g
    return not df.where(any_gone).select(F.lit(1)).limit(1).isEmpty()


def plan_features(df: DataFrame, target: str, task: str | None = None, importance: DataFrame | None = None,
                  underfit: bool = False, keys: Iterable[str] = ()) -> list[Step]:
    """The steps whose rules fire, by priority and then in the order of the rules.

    ``task`` is found by T4 if not given. ``importance`` (feature, importance), as M18 returns it, feeds the interaction
    of the two most important numbers and the drop of features below 0.005; without it neither fires. ``keys`` are
    columns that no rule touches. Roles are read from names in schema order; rules that calculate take numeric columns
    only, and text with more than 20 levels is no flag. A column named by an earlier drop is not used again. An empty
    table fires the rules that read names only.
    """
    keys = set(keys)
    names = [c for c in df.columns if c != target and c not in keys]
    nums = numeric_columns(df, keys | {target})
    texts = text_columns(df, keys | {target}, with_bool=False)
    dates = [c for c in date_columns(df) if c in set(names)]
    if task is None:
        found = infer_task_type(df, target).first()
        task = found["task_type"] if found else "regression"
    levels = {r["column"]: r["n_unique"] for r in distinct_counts(df, texts).collect()} if texts else {}
    high = [c for c in texts if levels.get(c, 0) > HIGH_CARD_THR]
    weight = {}
    if importance is not None:
        rows = importance.where(F.col("feature").isNotNull()).orderBy(F.desc_nulls_last("importance"), "feature").collect()
        weight = {r["feature"]: r["importance"] for r in rows}

    steps: list[Step] = []

    def add(priority: int, rule: str, name: str, *inputs: str) -> None:
        steps.append(Step(priority, rule, name, inputs))

    roles: dict[str, list[str]] = {}
    for c in names:
        roles.setdefault(role(c), []).append(c)
    by = {r: [c for c in cols if c in nums] for r, cols in roles.items()}
    size, count, money, duration, rate, distance = (by.get(r, []) for r in ("size", "count", "money", "duration", "rate", "distance"))
    flaggable = set(nums) | (set(text_columns(df)) - set(high))
    flags = [c for c in names if c in flaggable and re.search(FLAG_PATTERN, c, re.I)]
    flags_by_role = [c for c in roles.get("flag", []) if c in flaggable]

    # rules on the data
    if task == "regression" and target in numeric_columns(df):
        skew = column_skews(df, [target]).get(target) or 0.0
        if skew > TARGET_SKEW:
            add(1, "A1", "log_transform_target", target)
        elif skew < -TARGET_SKEW:
            add(1, "A1", "reflect_log_target", target)
    if _missing(df, nums + texts):
        add(1, "A2", "impute_missing_values", *nums, *texts)
    if nums and not outliers_by_column(df, nums).isEmpty():
        add(2, "A3", "winsorize_outliers", *nums)
    if dates:
        add(2, "A4", "datetime_cyclical_features", *dates)
    if high:
        add(3, "A5", "target_encode_high_cardinality", *high)
    if len(flags) >= 3:
        add(4, "A6", "aggregate_flag_score", *flags)

    # rules on the roles of names
    if size and count:
        for s in size[:2]:
            add(3, "B1", f"{s}_per_{count[0]}", s, count[0])
        add(4, "B2", f"{size[0]}_x_{count[0]}", size[0], count[0])
    if len(count) >= 2:
        add(4, "B3", f"{count[0]}_to_{count[1]}_ratio", *count[:2])
    if len(flags_by_role) >= 3 > len(flags):
        add(3, "B4", "binary_flag_aggregate_score", *flags_by_role)
    if duration and money:
        add(3, "B5", f"{money[0]}_per_{duration[0]}", money[0], duration[0])
    if duration:
        add(5, "B6", f"{duration[0]}_bin", duration[0])
    if size:
        add(5, "B7", f"{size[0]}_bin", size[0])
    if rate and money:
        add(4, "B8", f"{money[0]}_x_{rate[0]}", money[0], rate[0])
    if distance and money:
        add(4, "B9", f"{money[0]}_per_{distance[0]}", money[0], distance[0])
    if roles.get("id"):
        add(1, "B10", "drop_id_columns", *roles["id"])
    ids = set(roles.get("id", []))
    top = [c for c in weight if c in nums and c not in ids and not re.search(KNOWN_BINARY_PATTERN, c, re.I)][:2]
    if len(top) == 2 and not any(top[0] in s.name and top[1] in s.name for s in steps):
        add(3, "B11", f"{top[0]}_x_{top[1]}_interaction", *top)
        add(4, "B11", f"{top[0]}_div_{top[1]}_ratio", *top)
    if task == "classification":
        add(6, "B12", "encode_remaining_categoricals", *[c for c in texts if c not in high and c not in ids])

    # rules on results
    if underfit or (not texts and len(nums) >= 2):
        add(6, "C1", "polynomial_features", *nums)
    low = [c for c, w in weight.items() if c in set(names) and w is not None and w < LOW_IMPORTANCE]
    if low:
        add(7, "C2", "drop_low_importance_features", *low)
    return sorted(steps, key=lambda s: s.priority)


def plan_table(spark: SparkSession, steps: Sequence[Step]) -> DataFrame:
    """The plan as rows: step, priority, rule, name, inputs."""
    rows = [(i, s.priority, s.rule, s.name, list(s.inputs)) for i, s in enumerate(steps, 1)]
    return spark.createDataFrame(rows, "step int, priority int, rule string, name string, inputs array<string>")


# ---------------------------------------------------------------- SQL pieces

def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _d(name: str) -> str:
    """The column as a double; NaN is missing."""
    return f"nanvl(CAST({_q(name)} AS DOUBLE), CAST(NULL AS DOUBLE))"


def _number(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _per(a: str, b: str, zero: str = "1.0D") -> str:
    """a / b with a zero divisor replaced."""
    return f"try_divide({_d(a)}, CASE WHEN {_d(b)} = 0 THEN {zero} ELSE {_d(b)} END)"


def _cyclical(c: str) -> dict[str, str]:
    """The names of P25 as SQL text."""
    t, tau = f"CAST({_q(c)} AS TIMESTAMP)", "6.283185307179586D"
    month, dow = f"{tau} * month({t}) / 12", f"{tau} * weekday({t}) / 7"
    sql = [f"CAST(year({t}) AS BIGINT)", f"sin({month})", f"cos({month})", f"sin({dow})", f"cos({dow})", f"CAST(weekday({t}) >= 5 AS INT)"]
    return dict(zip(cyclical_date(c), sql))


def _flag(df: DataFrame, c: str) -> str:
    kind = dict(df.dtypes)[c]
    if kind == "string":
        return f"CAST(coalesce(lower({_q(c)}) IN ({', '.join(map(_text, YES_VALUES))}), false) AS DOUBLE)"
    return f"coalesce(CAST({_q(c)} AS DOUBLE), 0.0D)" if kind == "boolean" else f"coalesce({_d(c)}, 0.0D)"


def _quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Exact quantiles per column; columns without values have none."""
    return exact_quantiles(df.select(*[F.expr(_d(c)).alias(c) for c in cols]), cols, probs) if cols else {}


def _bins(c: str, edges: Sequence[float], labels: Sequence[str]) -> str:
    """P13 with literal edges: right-closed bins of the distinct edges; values beyond them fall in the end bins."""
    inner = sorted(set(edges))[1:-1]
    whens = " ".join(f"WHEN {_d(c)} <= {_number(e)} THEN {_text(s)}" for e, s in zip(inner, labels))
    return f"CASE WHEN {_d(c)} IS NULL THEN NULL {whens} ELSE {_text(labels[len(inner)])} END"


# ---------------------------------------------------------------- fit and apply

def fit_features(df: DataFrame, target: str, steps: Sequence[Step], keys: Iterable[str] = ()) -> FittedFeatures:
    """Statistics of the steps over ``df``, each step on what the steps before it made.

    A text target counts as the place of its class among the sorted classes (T4 allows 20). Encoded columns keep a
    dictionary (level, sum, n) or (level, code), written to the checkpoint folder. Steps that read a dropped column are
    left out. Columns without any value get no statistic and stay as they are.
    """
    number = _d(target)
    if dict(df.dtypes)[target] in ("string", "boolean"):
        classes = [r[0] for r in df.select(F.col(_q(target)).cast("string")).distinct().where(f"{_q(target)} IS NOT NULL").collect()]
        whens = " ".join(f"WHEN {_text(c)} THEN {i}.0D" for i, c in enumerate(sorted(classes)))
        number = f"CASE CAST({_q(target)} AS STRING) {whens} END" if classes else "CAST(NULL AS DOUBLE)"
    fitted = FittedFeatures(target, number, list(steps))
    plain = df  # what the expressions alone have made: the rows that later statistics are taken from
    gone: set[str] = set()
    encoded: set[str] = set()

    def put(exprs: dict[str, str]) -> None:
        nonlocal plain
        if exprs:
            fitted.ops.append(("set", exprs))
            plain = plain.withColumns({n: F.expr(e) for n, e in exprs.items()})

    for s in steps:
        cols = [c for c in s.inputs if c not in gone]
        if s.rule in ("B1", "B2", "B3", "B5", "B8", "B9", "B11") and len(cols) < 2:
            continue
        nums = [c for c in cols if c in numeric_columns(plain)]
        if s.name == "log_transform_target":
            put({target: f"CASE WHEN {_d(target)} > -1 THEN log1p({_d(target)}) END"})
        elif s.name == "reflect_log_target":
            most = plain.agg(F.max(F.expr(_d(target)))).first()[0]
            put({target: f"CASE WHEN {_d(target)} < {_number(most + 2)} THEN log1p({_number(most + 1)} - {_d(target)}) END"})
        elif s.rule == "A2":
            middle = _quantiles(plain, nums, [0.5])
            fill = {c: f"coalesce({_d(c)}, {_number(middle[c][0])})" for c in nums if c in middle}
            put(fill | {c: f"coalesce({_q(c)}, 'Unknown')" for c in cols if c not in nums})
        elif s.rule == "A3":
            put({c: f"CASE WHEN {_d(c)} < {_number(a)} THEN {_number(a)} WHEN {_d(c)} > {_number(b)} THEN {_number(b)} ELSE {_d(c)} END"
                 for c, (a, b) in _quantiles(plain, nums, [0.01, 0.99]).items()})
        elif s.rule == "A4":
            for c in cols:
                put(_cyclical(c))
        elif s.rule == "A5":
            y = F.expr(number)
            fitted.overall = plain.agg(F.avg(y)).first()[0]
            for c in cols:
                table = plain.where(F.col(_q(c)).isNotNull()).groupBy(F.col(_q(c)).alias("_level")).agg(F.sum(y).alias("_sum"), F.count(y).alias("_n"))
                fitted.levels[c] = cut_lineage(table)
                fitted.n_levels[c] = fitted.levels[c].count()
                fitted.ops.append(("mean", c))
                encoded.add(c)
        elif s.rule in ("A6", "B4"):
            made = {f"{c}_bin": f"CAST({_flag(plain, c)} AS INT)" for c in cols if dict(plain.dtypes)[c] == "string"}
            score = "flag_score" if s.rule == "A6" else "feature_score"
            put(made)
            put({score: " + ".join(_flag(plain, c) for c in cols) or "0.0D"})
        elif s.rule in ("B1", "B3", "B5", "B9"):
            put({s.name: _per(*cols)})
        elif s.rule in ("B2", "B8"):
            put({s.name: f"{_d(cols[0])} * {_d(cols[1])}"})
        elif s.rule == "B11" and s.priority == 3:
            put({f"{cols[0]}_x_{cols[1]}": f"{_d(cols[0])} * {_d(cols[1])}"})
        elif s.rule == "B11":
            middle = _quantiles(plain, cols[1:], [0.5]).get(cols[1], [None])[0]
            put({f"{cols[0]}_div_{cols[1]}": _per(*cols, zero="CAST(NULL AS DOUBLE)" if not middle else _number(middle))})
        elif s.rule in ("B6", "B7") and cols:
            labels = LABELS_Q4 if s.rule == "B6" else LABELS_Q5
            edges = _quantiles(plain, cols, [i / len(labels) for i in range(len(labels) + 1)])
            put({s.name: _bins(c, e, labels) for c, e in edges.items()})
        elif s.rule == "B12":
            keep = set(keys) | encoded | {target}
            for c in [c for c in text_columns(plain, keep, with_bool=False)]:
                seen = plain.select(F.col(_q(c)).alias("_level")).where("_level IS NOT NULL").distinct()
                codes = seen.withColumn("_code", (F.row_number().over(Window.orderBy("_level")) - 1).cast("double"))
                fitted.levels[c] = cut_lineage(codes)  # 20 levels at most: A5 took the others
                fitted.ops.append(("code", c))
                encoded.add(c)
        elif s.rule == "C1":
            use = [c for c in plain.columns if c != target and c not in set(keys) and (c in encoded or c in set(numeric_columns(plain)))]
            fitted.ops.append(("set", {f"{a}_x_{b}_poly": f"{_d(a)} * {_d(b)}" for i, a in enumerate(use) for b in use[i + 1:]}))
        elif s.rule in ("B10", "C2") and cols:
            gone |= set(cols)
            fitted.ops.append(("drop", cols))
            plain = plain.drop(*cols)
    return fitted


def _mean_code(fitted: FittedFeatures, has_target: bool, training: bool) -> Column:
    """P24 on the fitted rows (without the row itself), the level's mean elsewhere; the overall mean for new levels."""
    mean = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))
    if training and has_target:
        y = F.expr(fitted.target_number)
        mean = F.when((F.col("_n") > 1) & y.isNotNull(), (F.col("_sum") - y) / (F.col("_n") - 1)).when(y.isNull(), mean)
    return F.coalesce(mean, F.lit(fitted.overall).cast("double"))


def apply_features(df: DataFrame, fitted: FittedFeatures, training: bool = False) -> DataFrame:
    """The fitted steps over ``df``; every row stays.

    ``training`` says that ``df`` are the fitted rows: target means then leave the row out. Rows to be scored may lack
    the target column. Levels that were not fitted get the overall mean or code -1. The dictionaries meet the rows by a
    join on the level: broadcast up to 200,000 levels, so that the rows stay where they are, and beyond them by a
    shuffle, which adaptive execution splits where a level is hot.
    """
    has_target = fitted.target in df.columns
    for kind, op in fitted.ops:
        if kind == "set":
            df = df.withColumns({n: F.expr(e) for n, e in op.items() if has_target or n != fitted.target})
        elif kind == "drop":
            df = df.drop(*op)
        else:
            table = fitted.levels[op]
            table = F.broadcast(table) if kind == "code" or fitted.n_levels[op] <= BROADCAST_LEVELS else table
            order = df.columns
            made = _mean_code(fitted, has_target, training) if kind == "mean" else F.coalesce("_code", F.lit(-1.0))
            joined = df.join(table, df[_q(op)] == table["_level"], "left")
            df = joined.withColumn(op, made).select(*[_q(c) for c in order])
    return df


def auto_features(df: DataFrame, target: str, keys: Iterable[str] = (), **plan) -> tuple[DataFrame, FittedFeatures]:
    """Plan, fit and apply on one table; ``plan`` are the options of ``plan_features``."""
    keys = list(keys)
    fitted = fit_features(df, target, plan_features(df, target, keys=keys, **plan), keys)
    return apply_features(df, fitted, training=True), fitted
