"""Summarise each registered query's physical plan: shuffles, join strategies,
single-partition exchanges, and what every scan reads (columns, pushed filters).

Usage: python tools/plan_report.py [sf_dir] > PLANS.md

Queries that store an intermediate table (in the shared checkpoint folder) write it while
their plan is built, as they do when run.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

def summarise(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan)),
        "single": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcast_joins": len(re.findall(r"BroadcastHashJoin|BroadcastNestedLoopJoin", plan)),
        "sort_merge_joins": len(re.findall(r"SortMergeJoin", plan)),
        "nested_loop": len(re.findall(r"BroadcastNestedLoopJoin|CartesianProduct", plan)),
        "python": len(re.findall(r"MapInPandas|ArrowEvalPython|BatchEvalPython", plan)),
        "scans": sorted({(m.group(1), r.group(1))
                         for line in plan.split("\n") if "FileScan parquet" in line
                         for m in [re.search(r"spark_catalog\.default\.(\w+)", line)
                                   or re.search(r"/(\w+?)(?:\.parquet)?(?:-[0-9a-f]{12})?\]", line)]
                         for r in [re.search(r"ReadSchema: (struct<.*?>)(?:, SelectedBucketsCount.*)?\s*$", line)]
                         if m and r}),
    }


def main() -> None:
    from quire import get_spark
    from quire.plans import QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 16, extra={"spark.sql.maxMetadataStringLength": "2000"})
    print("# Physical plans\n")
    print(f"Generated by `tools/plan_report.py` at `{sf_dir}` (static plans, before adaptive re-planning;")
    print("adaptive execution may still turn a sort-merge join into a broadcast after measuring a side).\n")
    print("| query | shuffles | single-partition | broadcast joins | sort-merge joins | nested loop | python | scans (table: columns read) |")
    print("|---|---|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        scans = "; ".join(f"{t}: {re.sub(r'struct<|>$', '', rs).replace(':', ' ')[:200]}" for t, rs in s["scans"])
        print(f"| `{name}` | {s['shuffles']} | {s['single']} | {s['broadcast_joins']} | {s['sort_merge_joins']} | "
              f"{s['nested_loop']} | {s['python']} | {scans} |")


if __name__ == "__main__":
    main()
