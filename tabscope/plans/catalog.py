"""Query registry: name -> (callable(spark, sf_dir) -> DataFrame, DuckDB oracle SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}

_MODULES = ["q_profile", "q_schema", "q_features", "q_window", "q_assoc", "q_misc", "q_retrieval",
            "q_rules", "q_reports", "q_events", "q_ml", "q_tuning", "q_auto"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load():
    for m in _MODULES:
        try:
            importlib.import_module(f"tabscope.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"tabscope.plans.{m}":
                raise


def queries() -> dict[str, Callable]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def _bigint_count_if(sql: str) -> str:
    """DuckDB's count_if is HUGEINT; Spark's is bigint: cast each call (paren-matched)."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while k < len(sql):
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        inner = _bigint_count_if(sql[j + len(key):k])
        out.append(sql[i:j] + f"CAST(count_if({inner}) AS BIGINT)")
        i = k + 1


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: _bigint_count_if(v[1]) for k, v in REGISTRY.items() if v[1]}
