"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores. Each query runs
once, whole, into a no-op sink; one small query first pays for starting the session.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "src_hourly_rollup", "aqi_hourly_index", "aqi_station_index", "src_hourly_window", "src_latest_city",
    "prj_sub_index", "agg_latest_per_key", "agg_exact_quantiles", "agg_winsorize", "agg_city_medians",
    "agg_hourly_median_grid", "win_interpolate_gap6", "win_lag_features", "win_rolling_mean_std", "feature_frame",
    "piv_long_to_wide", "join_asof_regime", "agg_persistence_metrics", "fc_series_forecast", "fc_index_forecast",
    "ins_trend_alerts", "ins_hourly_topk", "viz_station_heatmap", "viz_daily_trend", "txt_topic_argmax",
    "txt_token_counts", "txt_intent_classify", "chk_chunks", "agg_term_stats", "topk_bm25", "topk_knn_l2",
    "topk_tfidf", "fus_weighted_rrf", "rer_reliability_floor", "scr_faithfulness", "scr_confidence_composite",
    "scr_risk_rules", "mem_compact_history", "inc_ingest_chunks", "ml_regimes", "str_hourly_rollup",
]


def main() -> None:
    from airloom.plans import load_catalog
    from airloom.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=8 if cpus == "*" else max(int(cpus), 1), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_catalog()
    queries["agg_distinct_stations"](spark, folder).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
