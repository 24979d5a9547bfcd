"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerscope.plans.catalog import load  # noqa: E402
from ledgerscope.session import local_session  # noqa: E402

HEADLINE = [
    "p5_p6_tier1",
    "p11_context_adjustment",
    "p19_scored_payments",
    "j3_known_contact",
    "j9_sanctions",
    "w1_sliding_velocity",
    "w6_fingerprint_runs",
    "a1_velocity",
    "a4_window_flows",
    "a6_degrees",
    "a10_account_profile",
    "a14_set_features",
    "a15_benford_receipts",
    "a16_fan_in_zscore",
    "r3_bipartite_core",
    "r5_merchant_terminal",
    "g3_pagerank",
    "g5_clustering",
    "g12_strong_components",
    "g10_trails_backward",
    "r9_score_graphs",
    "m10_committee",
    "m14_pr_curve",
    "j11_nearest_prototypes",
    "p22_card_risk",
    "n6_route_discovery",
    "n8_psi_baseline",
    "e1_route_feedback",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session()
    catalog = load()
    # One untimed query starts the JVM's code paths.
    catalog["a2_account_means"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        catalog[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
