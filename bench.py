"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "A8_repeat_metrics", "A8_repeat_metrics_fixed_length", "A5_run_table", "A10_ratio_metrics", "W2_neighbours",
    "A11_strata_counts", "J1_gate_join", "L6_all_rules_in_one_pass", "L8_closed_loop", "L10_candidate_position",
    "J2_expand_grid", "W1_top_candidates", "A14_precision_individual", "A15_precision_paired", "A20_draws",
    "A21_bootstrap", "A24_percentile_ci", "A26_individual_summary", "X2_paired_master", "U2_precision_audit",
    "Q5_conservation_law_counts", "J11_diff_tables", "A22_fingerprint", "K2_chunk_sink", "T1_stream_repeat_metrics",
)


def main() -> None:
    from trialloom.plans.catalog import QUERIES
    from trialloom.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    QUERIES["A1_state_counts"](spark, sf).write.format("noop").mode("overwrite").save()  # start the workers
    only, times = sys.argv[1:], {}
    for name in only or HEADLINE:
        spark.catalog.clearCache()
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
