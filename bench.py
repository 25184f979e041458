"""Headline queries; prints one JSON line.

BENCH_SF_DIR: table folder (default /root/testdata/sf0.1). BENCH_CPUS: local cores.
BENCH_ONLY: comma-separated query prefixes, for local work.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "A3_read_quotes", "A4_paired_quotes_from_json", "B7_norm_name", "B21_hash_ids", "D5_nearest_date",
    "D8_entry_and_close", "D10_overlay_history", "D11_identity_resolution", "E3_book_consensus", "E4_live_consensus",
    "E14_threshold_segment_grid", "E15_edge_buckets", "E17_cluster_bootstrap_ratio", "E25_policy_comparison",
    "F2_point_in_time_history", "F7_career_stats", "F8_opponent_adjusted", "F11_capped_allocation",
    "F12_equity_curve", "I5_walk_forward", "I9_past_only_blend", "J1_bout_audit", "K3_settle_trades",
    "L1_live_consensus_stream",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from duelmark.catalog import REGISTRY
    from duelmark.session import configure

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = tuple(p for p in os.environ.get("BENCH_ONLY", "").split(",") if p)
    spark = configure(SparkSession.builder.master(f"local[{cpus}]").appName("duelmark-bench")
                      .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
                      .config("spark.ui.enabled", "false").config("spark.log.level", "ERROR").getOrCreate())
    spark.range(10_000).selectExpr("sum(id)").collect()      # start the executors
    took: dict[str, float] = {}
    for name in HEADLINE:
        if only and not name.startswith(only):
            continue
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
