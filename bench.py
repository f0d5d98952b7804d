"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Each query is executed to completion with the ``noop`` sink (all rows produced, none collected).
Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_MEM
(driver memory, default 16g), BENCH_QUERIES (comma-separated subset), BENCH_REPEAT (default 1; the
best run counts).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
SAME_PLAN = {"radius_pairs_naive"}
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    mem = os.environ.get("BENCH_MEM", "16g")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    subset = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from dictaudit.plans import all_queries
    from dictaudit.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), driver_memory=mem,
                      extra={"spark.sql.files.maxPartitionBytes": str(64 << 20)})
    registry = all_queries()
    # radius_pairs_naive has the plan of radius_pairs_pivots and is not timed again.
    names = subset or [n for n in registry if n not in SAME_PLAN]
    # Start the JVM code paths and a Python worker before timing.
    spark.range(1000).selectExpr("sum(id)").collect()
    registry["radius_pairs"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            try:
                registry[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            except Exception as exc:  # noqa: BLE001 - report, keep going
                errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
                break
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        if best is not None:
            times[name] = round(best, 3)
        print(f"{name}: {times.get(name, errors.get(name))}", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "driver_memory": mem,
           "n_queries": len(times)}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
