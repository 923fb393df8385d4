"""Small helpers that write the DuckDB oracle SQL (string building only)."""

from __future__ import annotations


def r6(e: str) -> str:
    """Oracle twin of safe_round: NaN / Inf -> NULL, round to 6."""
    return f"(round(CASE WHEN isnan(({e})::DOUBLE) OR isinf(({e})::DOUBLE) THEN NULL ELSE ({e})::DOUBLE END, 6) + 0.0)"


def long_sql(table: str, cols, cast: str = "DOUBLE", ids=(), keep_null: bool = False) -> str:
    """UNION ALL form of the unpivot: (ids..., "column", value)."""
    idl = "".join(f"{i}, " for i in ids)
    parts = []
    for c in cols:
        where = "" if keep_null else f" WHERE {c} IS NOT NULL"
        parts.append(f"SELECT {idl}'{c}' AS \"column\", CAST({c} AS {cast}) AS value FROM {table}{where}")
    return "(" + " UNION ALL ".join(parts) + ")"


# Events with nulls made by rule (identical on both engines).
EVENTS_NULLS_SQL = """(SELECT event_id, ts,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN NULL ELSE props END AS props
  FROM events)"""
