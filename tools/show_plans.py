"""Write PLANS.md: the physical plan shape of the headline queries.

    python tools/show_plans.py [sf_dir]

For each query: the operator tree (formatted explain, first part) and the
scan details (pushed filters, read schema).  Parts already checkpointed by
the query (worklist, parsed fields, numbered rows) appear as scans of the
checkpoint.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

QUERIES = ["best_filing", "upcoming_ipos", "recent_ipos", "upcoming_unlocks", "daily_unlocks",
           "offering_upsert", "filing_sync", "status_transition", "issuer_upsert",
           "candidate_dedup", "company_search", "lockup_days", "constraint_violations"]


def plan_string(spark, df) -> str:
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from floatline.plans.catalog import QUERIES as Q
    from floatline.session import get_spark
    spark = get_spark("local[8]", shuffle_partitions=16)
    out = ["# PLANS", "",
           f"Physical plans of headline queries (`tools/show_plans.py`, {sf_dir}, local[8],",
           "AQE on, so joins may still be re-planned at run time).", ""]
    for name in QUERIES:
        df = Q[name](spark, sf_dir)
        text = plan_string(spark, df)
        tree = text.split("\n\n\n")[0]
        scans = [line for line in text.splitlines()
                 if line.startswith(("PushedFilters", "ReadSchema", "Location"))]
        ops = sorted(set(re.findall(r"(WindowGroupLimit|BroadcastHashJoin \w+|SortMergeJoin \w+|"
                                    r"HashAggregate|ObjectHashAggregate|BroadcastNestedLoopJoin \w+|"
                                    r"Exchange|Window|Expand|Generate)", tree)))
        out += [f"## {name}", "", "Operators: " + ", ".join(ops), "", "```", tree.strip(), "```", ""]
        if scans:
            out += ["```", *sorted(set(scans)), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
