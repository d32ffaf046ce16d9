"""Times headline queries at $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pattern_counts_events",
    "pattern_counts_lineitem",
    "pattern_zigzag_rank",
    "pattern_diffs",
    "tour_order",
    "site_loglik_pruning",
    "site_loglik_balanced",
    "site_loglik_hky_balanced",
    "loglik_total",
    "loglik_fk_star",
    "batch_scores_grid",
    "branch_update_loglik",
    "tree_metrics_forest",
    "decomp_heights_forest",
    "name_match_suppliers",
    "simulate_states_fk",
    "mcmc_trace_balanced",
]


def main() -> None:
    from cladeloom.queries import registry
    from cladeloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    found = registry()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        found[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cpus,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
