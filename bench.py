"""Time the headline queries; prints one JSON line."""

import json
import os
import time

from roadloom.plans.queries import QUERIES
from roadloom.session import build_session

HEADLINE = [
    "release_stats", "segment_states", "headline", "compare_state", "churn", "kept_features", "weekly_series",
    "wow_drops", "headline_delta", "within_radius", "distance_join", "places_near_sites", "breakdown_roads",
    "column_profile", "numeric_summary", "path_length", "geojson_features", "number_readings", "score_answers",
    "eval_summary", "sql_audit", "estimate_bytes", "admission_window", "spheroid_length",
    "slim_features", "verified_rewrite", "admission_stream", "admission_single", "simplify", "simplify_paths", "wkb_roundtrip", "extract_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = build_session("roadloom-bench", master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()       # start the engine
    seconds = {}
    for name in HEADLINE:
        spark.catalog.clearCache()                               # no query profits from another one
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
