"""Runs the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from featherloom.plans import catalogue
from featherloom.session import local_session

HEADLINES = (
    "p01_profile p02_infer_groups i01_impute_median_mode e01_one_hot e05_target_mean e08_woe c01_standard c03_robust k02_pearson l01_anova_f "
    "n01_token_counts n03_tf_idf y01_stratified_folds b01_random_over v01_metrics_regression v06_metrics_binary v15_roc_auc v11_averaged_scores "
    "w01_running_best w03_incumbent_trajectory a21_concurrency a23_budget_correlation"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINES:
        began = time.time()
        catalogue.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
