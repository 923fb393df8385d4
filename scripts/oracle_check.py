"""Run registered queries on Spark and their oracle SQL on DuckDB; report mismatches.

usage: python scripts/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tabscope.plans.catalog import oracle_sql, queries  # noqa: E402
from tabscope.session import TABLES, get_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        v = round(v, 6)
        return 0.0 if v == 0 else v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    spark = get_session()
    con = duckdb.connect()
    for tname in TABLES:
        con.execute(f"CREATE VIEW {tname} AS SELECT * FROM read_parquet('{sf}/{tname}.parquet')")
    qs, sqls = queries(), oracle_sql()
    ok = bad = skipped = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SPARK {name}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS-ONLY  {name}: {len(srows)} rows ({ts:.1f}s)")
            skipped += 1
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL-SQL   {name}: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"MISMATCH-COLS {name}: spark={sorted(scols)} duck={sorted(dcols)}")
            bad += 1
            continue
        smap = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                "timestamp_ntz": "TIMESTAMP", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE"}
        st = {f.name: smap.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
        dt_ = {d[0]: str(d[1]) for d in cur.description}
        tdiff = {c: (st[c], dt_.get(c)) for c in st if st[c] != dt_.get(c)}
        if tdiff:
            print(f"TYPES      {name}: {tdiff}")
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        from collections import Counter
        if Counter(a) == Counter(b):
            print(f"OK         {name}: {len(a)} rows ({ts:.1f}s)")
            ok += 1
        else:
            bad += 1
            print(f"MISMATCH   {name}: spark {len(a)} rows, duck {len(b)} rows; cols={sorted(scols)}")
            sa, sb = set(a), set(b)
            for r in list(sa - sb)[:3]:
                print("   spark-only", r)
            for r in list(sb - sa)[:3]:
                print("   duck-only ", r)
    print(f"== ok {ok}, bad {bad}, rows-only {skipped}")
    spark.stop()


if __name__ == "__main__":
    main()
