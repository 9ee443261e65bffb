"""Wall seconds of the headline queries; prints one JSON line.

Reads $BENCH_SF_DIR on local[$BENCH_CPUS]. Every query writes all its rows to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from risklane.plans import catalog  # noqa: E402
from risklane.session import build_session  # noqa: E402

HEADLINE = [
    "velocity_exact", "velocity_bands", "velocity_bucketed", "velocity_ties_split", "dataset_summary", "null_rates",
    "amount_describe", "rate_by_dims", "chrono_split_summary", "feature_matrix", "serving_transform", "roc_auc",
    "cost_curve", "f1_sweep", "reliability", "psi_matrix", "concept_drift", "retrain_rule", "decision_record",
    "explanations", "posterior_state", "cumulative_regret", "rolling_success", "linucb_stats", "linucb_route",
    "thompson_route", "intent", "claim_check", "stream_velocity", "gbt_score", "iso_scores", "smote_rows",
    "tree_attrib_topn", "score_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session("risklane-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    known = catalog.queries()
    known["class_counts"](spark, sf_dir).collect()      # the session is warm before the clock starts
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
