"""Bench: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) with local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (no driver collect).
Prints ONE JSON line: {"metric", "value" (sum of per-query seconds), "unit", "queries", "sf", ...}.
BENCH_RUNS timed runs per query after one warm-up run (median reported).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "describe_numeric", "outliers_by_column", "missing_by_column", "category_frequencies", "histogram",
    "segment_profile", "cardinality_audit", "pearson_pairs", "chi_square_pairs", "ttest_pairs", "anova",
    "rolling_by_user", "rolling_global", "prefix_scan", "average_rank", "quantile_bin", "target_encode_loo",
    "ordinal_encode", "dedup_within", "over_quota", "task_state_latest", "keyword_route", "scan_lines",
    "chunk_text", "hybrid_search", "vector_scores", "train_test_split_stratified", "fit_linear", "regression_metrics",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from tabscope.plans.catalog import queries
    from tabscope.session import get_session

    scratch = tempfile.mkdtemp(prefix="tabscope-bench-")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(4, cpus * 2),
                        extra={"spark.checkpoint.dir": f"{scratch}/ckpt",
                               "spark.sql.files.maxPartitionBytes": str(16 * 1024 * 1024)})
    qs = queries()
    names = only or [n for n in HEADLINE if n in qs]
    times, errors = {}, {}
    for name in names:
        try:
            samples = []
            for i in range(runs + 1):
                t0 = time.time()
                qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.time() - t0
                if i > 0 or runs == 0:
                    samples.append(dt)
            times[name] = round(statistics.median(samples), 3)
        except Exception as e:  # noqa: BLE001 - record and continue
            errors[name] = re.sub(r"\s+", " ", str(e))[:200]
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "runs": runs}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
