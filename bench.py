"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
    BENCH_QUERIES=all python bench.py            # every registered query
    BENCH_RUNS=1 python bench.py                 # runs per query (median reported)

Each query is built (its own internal steps included: worklist and field
checkpoints, id assignment) and then fully materialized with the ``noop``
sink, so no column can be pruned away.  One warm-up query runs first; each
query then runs BENCH_RUNS times (default 3) and its median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "daily_unlocks",          # flagship: J4 -> R3
    "daily_upcoming_ipos",    # J3 -> R1
    "offering_upsert",        # J3 / D6
    "capitalization_upsert",  # J3 / D6
    "lockup_upsert",          # J4 / D7
    "filing_sync",            # J2 / S3 + D5
    "status_transition",      # J2 / D8
    "issuer_upsert",          # J1 / D2-D4
    "candidates_union",       # S1 + S2
    "company_search",         # S4
    "upcoming_ipos",          # R1
    "recent_ipos",            # R2
    "upcoming_unlocks",       # R3
    "html_to_text",           # F7 over pages
    "normalize_whitespace",   # F6 over documents
    "find_section",           # F8 over documents
    "shares_offered_total",   # X3 over all fixture texts
    "lockup_days",            # X10 over all fixture texts
    "bookrunners",            # X6 over all fixture texts
    "constraint_violations",  # D9
    "filing_sync_incremental",  # T1
    "discover_from_calendars",  # J1 from the landed calendars
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    which = os.environ.get("BENCH_QUERIES", "headline")
    runs = max(1, int(os.environ.get("BENCH_RUNS", "3")))

    from floatline.plans.catalog import QUERIES
    from floatline.session import get_spark

    spark = get_spark(f"local[{cpus}]", app="floatline-bench", shuffle_partitions=2 * cpus,
                      extra={"spark.driver.memory": "16g"})
    names = list(QUERIES) if which == "all" else [n for n in HEADLINE if n in QUERIES]

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("best_filing")  # warm-up: JVM, codegen caches
    timings, errors = {}, {}
    for name in names:
        try:
            timings[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
        except Exception as e:  # noqa: BLE001 - report the query, keep benching
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_queries_total" if which != "all" else "all_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
        "spark": spark.version,
        **({"errors": errors} if errors else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
