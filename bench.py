"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# One query per stage of a monitoring run, then single operators on the widest inputs.
HEADLINE = [
    "clean_table", "feature_table", "tracking_table", "narrative_table", "i18_score", "alert_table", "k1_incremental_ingest",
    "k2_stateful_velocity", "c2_attach_comment_text", "c8_nearest_neighbour_score", "d12_last_non_null", "d17_roc_auc",
    "d20_metrics_row", "e5_dedup_keep_best", "h1_normalise_text", "h5_risk_phrase_score", "h18_trend_score",
    "h23_emerging_flag", "h25_ravs_score", "i1_sentiment_scoring", "i4_column_translation", "i6_narrative_clustering",
    "i7_term_counts", "i12_cluster_naming_by_lexicon", "j1_overview_kpis", "j5_top_clusters", "j9_scenario_pick",
    "j11_top_narratives",
]


def main() -> None:
    from tidewatch.catalog import REGISTRY
    from tidewatch.catalog.models_ import trained
    from tidewatch.catalog.registry import Tables
    from tidewatch.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        if name == "i18_score":  # scoring is timed with a stored model; the 200 trees are trained before
            trained(Tables(spark, sf_dir))
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
