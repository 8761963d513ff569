"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR picks the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8).
After a short warm-up every query is run once; results go to a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardlight.plans.catalog import QUERIES  # noqa: E402
from wardlight.session import local_session  # noqa: E402

HEADLINE = [
    "A2_scan_events", "B13_remove_set", "C7_theta_anti_join", "C8_theta_semi_join_label", "C10_lookback_join", "C12_nearest_asof_join",
    "C13_interval_overlap_join", "D1_series_stats", "D6_window_counts", "D15_population_median_fill", "D17_iqr_bounds", "E2_prior_admissions",
    "E6_concat_with_budget", "E9_locf", "F2_bin_stats", "F3_to_tensor", "F5_vital_lab_features", "F6_pf_ratio", "H4_charlson", "H5_elixhauser",
    "H11_abnormality", "H12_acuity_scores", "H17_expert_interactions", "I1_clean_text", "I8_concept_flags", "I12_concept_groups_negated",
    "I21_chi2_scores", "I24_tfidf", "J4_stratified_split", "J13_quantile_bin", "J16_rank_interactions", "J19_score_ensemble",
    "J25_local_explanation", "K3_pr_curve", "K4_auroc", "K8_threshold_grid", "L2_class_overlap",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for warm_up in ("D7_urine_stats", "I9_risk_keyword_flags"):
        QUERIES[warm_up].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
