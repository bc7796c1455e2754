"""Times the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from fairlead.plans import QUERIES
from fairlead.session import get_session

HEADLINE = (
    "A-2", "A-5-peak", "A-13", "A-15", "A-17", "A-37", "J-1", "A-21", "A-23", "T-1", "A-31", "X-1", "X-3",
    "W-2", "J-6", "J-13", "G-5", "G-11", "G-8", "G-9", "M-2", "M-4", "M-5", "S-14", "W-8",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    only = os.environ.get("BENCH_ONLY")
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's code paths and the Python workers outside the timings.
    for key in ("A-6", "M-3"):
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for key in only.split(",") if only else HEADLINE:
        start = time.perf_counter()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        took[key] = round(time.perf_counter() - start, 3)
        print(key, took[key], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
