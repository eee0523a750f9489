"""Wall time of the headline queries at one scale. Prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores, BENCH_QUERIES (comma
separated) a choice of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scorewell.catalog import all_queries  # noqa: E402
from scorewell.session import build_session  # noqa: E402

HEADLINE = """
cheapest_threshold_report cost_threshold best_threshold roc_auc roc_auc_ties pr_auc cost_curve classification_summary
classification_report score_histogram clean_smart clean_basic drop_duplicates duplicates_removed missing_counts
coerce_numeric_string cap_outliers_iqr count_outliers_iqr impute_mean_mode quality_report column_roles_lineitem
numeric_profile categorical_profile correlation_matrix histogram dataset_profile stratified_sample stratified_split
stratified_folds engineer_features standard_scale one_hot impute_median smote class_weights batch_summary top_risky
drift_fit psi ks_2samp drift_report rolling_summary alert_rules alert_cooldown windowed_fraud_rate append_log
explain_linear explain_rows_topk global_importance explain_tree_boosted score_batch windowed_fraud_rate_stream
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "scorewell-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # Start the JVM's own machinery on something else first.
    spark.range(1_000_000).selectExpr("id % 7 AS k", "id AS v").groupBy("k").sum("v").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
