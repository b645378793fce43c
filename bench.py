"""Time the headline queries and print one JSON line.

Every query starts without stage tables of an earlier one, so its time covers its whole plan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q_a05_ledger_7d", "q_a06_ledger_scale", "q_a01_business_stats", "q_a09_family_merge", "q_w05_temporal_split",
    "q_w02_true_best", "q_w06_trailing_streak", "q_w07_current_business", "q_w08_current_seven_days",
    "q_m18_popularity_baseline", "q_m20_segment_baseline", "q_m21_knn_baseline", "q_j09_cosine_top_k",
    "q_m06_nearest_training_nodes", "q_m07_candidates", "q_j16_same_business_neighbours", "q_m16_aux_score",
    "q_a27_hit_rates", "q_a19_unit_strata", "q_a32_business_capacity", "q_m10_amount_models",
]


def main() -> None:
    from settlerank.plans.catalog import CATALOG
    from settlerank.plans.catalog.recommend import forget_plans
    from settlerank.plans.flow import forget_flows
    from settlerank.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds = {}
    for name in names:
        forget_flows()
        forget_plans()
        started = time.time()
        CATALOG[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(f"{seconds[name]:8.2f} {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
