"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from alertloom.plans.catalog import QUERIES

HEADLINE = (
    "c1_correlate", "c1_correlate_temporal", "w10_max_score", "a1_cluster_scores", "t3_topk_importance", "a2_cluster_summary", "a8_cluster_report", "j13_intel_match", "a7_cluster_enrichment",
    "w3_gap_segments", "w1_chains", "w6_anchored_windows", "m10_apt_campaigns", "j8_temporal_near_edges", "e2_ari_fmi", "e3_information", "g3_pagerank", "g9_hetero_edges", "u3_hybrid", "b1_time_anomaly", "a18_fp_patterns", "m4_adaptive_threshold",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["a3_global_stats"](spark, sf_dir).count()  # starts workers and compiles
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
