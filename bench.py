"""Benchmark of the headline jobs.

Runs each job over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line:

    {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each job is executed completely into the ``noop`` sink (no collect), once to
warm up the JVM and once timed; streaming jobs run once.  ``rows`` is what each
job reads (events; the retry stream reads all of them) and ``rows_per_sec``
follows from it.  ``growth`` compares the time with that of a tenth of the data
(``$BENCH_SMALL_DIR``, default sf0.01): 10 would be in proportion.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["admission_decisions", "dispatch_step", "status_expand", "latest_state", "delivery_history",
            "fan_out", "fan_out_counts", "fan_out_as_of", "admission_counters", "slo_report", "token_audit",
            "route_requests", "retry_chain_step", "consumer_lag", "idempotency_claim", "stream_state_reconcile"]
STREAMING = ["stream_rate_quota", "stream_retry"]


def run(registry, spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    small_dir = os.environ.get("BENCH_SMALL_DIR", "/root/testdata/sf0.01")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from sluice.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    import sluice.queries  # noqa: F401
    import sluice.streaming.registered  # noqa: F401
    from sluice.registry import REGISTRY
    from sluice.sources.tables import table
    counted: dict[str, int] = {}

    def rows_of(name: str) -> int:
        extra = {"route_requests": ["pages"]}.get(name, [])
        return sum(counted.setdefault(t, table(spark, sf_dir, t).count()) for t in ["events", *extra])

    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    timings: dict[str, float] = {}
    growth: dict[str, float] = {}
    for name in only or HEADLINE:
        small = min(run(REGISTRY, spark, name, small_dir) for _ in range(2))  # also the warm-up
        timings[name] = round(run(REGISTRY, spark, name, sf_dir), 3)
        growth[name] = round(timings[name] / small, 2)
    if os.environ.get("BENCH_STREAMING", "1") == "1" and not only:
        for name in STREAMING:
            timings[name] = round(run(REGISTRY, spark, name, sf_dir), 3)
    rows = {name: rows_of(name) for name in timings}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "rows": rows,
        "rows_per_sec": {k: round(rows[k] / v, 1) for k, v in timings.items() if v > 0},
        "growth": growth,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
