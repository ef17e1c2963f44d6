"""Time every registered query and print one JSON line.

Data comes from $BENCH_SF_DIR, the session is local[$BENCH_CPUS]. Each query runs once to
warm up and then up to three times, fewer where it is slow; the median counts. Results
go to Spark's ``noop`` sink, so the whole plan runs and nothing is collected.

    python bench.py [query name ...]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from riskloom.plans import catalog
from riskloom.session import build_session

BUDGET = 4.0  # seconds of timed runs per query


def run(spark, name: str, data: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or catalog.QUERIES:
        run(spark, name, data)
        times = []
        while len(times) < 3 and sum(times) < BUDGET:
            times.append(run(spark, name, data))
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of median query times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(data.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
