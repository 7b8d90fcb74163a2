"""Summarise the executed physical plans of the headline queries.

usage: python scripts/plan_summary.py [sf_dir]
Prints, per query: scans (ReadSchema, PushedFilters), exchanges by kind, join
strategies, aggregate phases, window group limits and broadcast exchanges.
Leaves of checkpointed intermediates appear as scans of existing RDDs.
"""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillwise.plans import registry as REG  # noqa: E402
from tillwise.session import get_spark  # noqa: E402

HEADLINE = ["r11_segment_counts", "c12_clean_dedupe_first", "pr8_dual_top_summary",
            "sg5_segment_top_products", "sg3_segment_profile", "ch3_churn_flag"]


def summarise(plan: str) -> dict:
    c = collections.Counter()
    for pat, key in [(r"Exchange hashpartitioning", "hash exchange"),
                     (r"Exchange rangepartitioning", "range exchange"),
                     (r"Exchange SinglePartition", "single-partition exchange"),
                     (r"BroadcastExchange", "broadcast exchange"),
                     (r"BroadcastHashJoin", "broadcast hash join"),
                     (r"SortMergeJoin", "sort-merge join"),
                     (r"BroadcastNestedLoopJoin", "broadcast nested loop join (1-row scalars)"),
                     (r"partial_", "partial aggregate fns"),
                     (r"WindowGroupLimit", "window group limit"),
                     (r"ReusedExchange", "reused exchange"),
                     (r"Scan ExistingRDD|LogicalRDD|Scan parquet .*clean-pre|ExistingRDD", "checkpoint leaf"),
                     (r"FileScan parquet", "parquet scan")]:
        c[key] = len(re.findall(pat, plan))
    scans = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)))
    pushed = sorted(set(p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if p))
    return {"counts": {k: v for k, v in c.items() if v}, "read_schemas": scans, "pushed": pushed}


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark()
    qs = REG.queries()
    for name in HEADLINE:
        df = qs[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        print(f"## {name}")
        print("counts:", s["counts"])
        for r in s["read_schemas"]:
            print("  ReadSchema:", r)
        for p in s["pushed"]:
            print("  PushedFilters:", p[:200])
        print()


if __name__ == "__main__":
    main()
