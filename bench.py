"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pulsegrid.plans import QUERIES
from pulsegrid.session import build_session

HEADLINE = [
    "gap_sessions", "rle_runs", "minute_resample_centered", "multi_stat_resample", "full_grid_counts", "locate_strongest", "hrv_metrics",
    "interval_point_join", "before_after_12h", "tolerance_match_300s", "self_pair_lags", "segment_gaussian", "daily_usage_summary",
    "tod_histogram_pdf", "location_quantiles", "sleep_summary", "rolling_mean_fill", "savgol_5_3", "zscore", "percentile_in_reference",
    "awake_periods", "knn_impute", "ks_two_sample", "spearman", "pearson_matrix", "ols_grouped", "granger_f", "permutation_change",
    "split_scan_best", "switching_path", "ngram_motifs", "bigram_logprob", "words_top10", "kmeans_segments",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    QUERIES["clock_hours"](spark, folder).collect()  # start the workers
    took = {}
    for name in wanted:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline query time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
