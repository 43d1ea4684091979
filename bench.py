"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the tables and the cores.  Each query runs once to warm up, then BENCH_RUNS times (3);
the median is reported.  Results are drained with the no-op sink, so the time
covers the whole result and no collect.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "scan_stream": "events",
    "envelope": "events",
    "entity_observations": "embeddings",
    "locomotor_summary": "events",
    "rolling_peak": "events",
    "effort_segments": "events",
    "jump_metrics": "events",
    "imu_summary": "events",
    "sensor_association": "events",
    "rep_segments": "events",
    "pose_metrics": "embeddings",
    "team_geometry": "events",
    "attacker_defender": "events",
    "delaunay": "events",
    "territory_team": "events",
    "influence_team": "events",
    "event_snapshot": "events",
    "nearest_event_join": "events",
    "current_revision": "orders",
    "mart_provenance": "lineitem",
    "rank_within": "customer",
    "score_summary": "conversations",
    "validate_tracking": "events",
    "exact_quantile": "lineitem",
}


def main() -> None:
    from pacelane import plans
    from pacelane.session import build_session, drop_work

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = sys.argv[1:] or list(HEADLINE)
    spark = build_session("pacelane-bench", master=f"local[{cpus}]", partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    rows = {name: spark.read.parquet(f"{folder}/{name}.parquet").count() for name in set(HEADLINE.values())}
    seconds: dict[str, float] = {}
    for name in wanted:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    drop_work(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "source_rows_per_sec": {n: round(rows[HEADLINE[n]] / s) for n, s in seconds.items() if n in HEADLINE},
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "spark": spark.version,
                "cores": cpus,
                "shuffle_partitions": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
