"""Bench: headline analyses on $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]; prints ONE JSON line with per-query seconds.

Each query runs to completion: small results are collected, line-level results
are written to the no-op sink (full execution, nothing kept).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillwise.plans import registry as REG  # noqa: E402
from tillwise.session import get_spark  # noqa: E402

# (bench name, registered query, how to run it)
BENCH = [
    ("clean_dedupe_first", "c12_clean_dedupe_first", "noop"),
    ("rfm_segment_counts", "r11_segment_counts", "collect"),
    ("cleaned_segment_counts", "r11_segment_counts_cleaned", "collect"),
    ("product_dual_top", "pr8_dual_top_summary", "collect"),
    ("product_top_quantity", "pr4_top_quantity", "collect"),
    ("segment_top_products", "sg5_segment_top_products", "collect"),
    ("segment_profile", "sg3_segment_profile", "collect"),
    ("churn_flags", "ch4_churn_count", "collect"),
    ("run_analysis", "a1_run_analysis", "collect"),
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=cpus, driver_memory="16g")
    qs = REG.queries()
    # warm the JVM and code paths on the smallest tables (not timed)
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        qs["r11_segment_counts"](spark, warm).collect()
    times = {}
    for name, key, how in BENCH:
        t0 = time.perf_counter()
        df = qs[key](spark, sf_dir)
        if how == "noop":
            df.write.format("noop").mode("overwrite").save()
        else:
            df.collect()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else None}))
    spark.stop()


if __name__ == "__main__":
    main()
