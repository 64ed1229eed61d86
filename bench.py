"""Headline queries on one machine; prints one JSON line: the best of two warm runs of each query, and its first.

Every run binds the network anew, so the jobs that measure sizes are part of all of them.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "telemetry_clean",
    "sessions_clean",
    "congestion_events",
    "hotspot_summary",
    "peak_hour_patterns",
    "network_health_snapshot",
    "province_summary",
    "subscriber_impact",
    "neighbour_pairs",
    "neighbour_impact",
    "tower_map_7d",
    "province_map_7d",
    "hotspot_leaderboard_7d",
    "province_leaderboard_30d",
    "prb_series",
    "weekday_hour_grid",
    "alert_cycle",
    "province_tags",
    "cell_sample",
    "quality_missing_hours",
]


def session(cpus: str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cellgauge")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from cellgauge.catalog.queries import REGISTRY

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        cold[name], seconds[name] = round(runs[0], 3), round(min(runs[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "cold": cold,
                "cold_total": round(sum(cold.values()), 3),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
