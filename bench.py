"""Bench: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with seconds per query.

Each query is executed in full with the ``noop`` sink (every row produced,
nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tesserae.plans.queries import QUERIES  # noqa: E402
from tesserae.session import build_session  # noqa: E402


def run_one(spark, fn, sf_dir: str) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or list(QUERIES)
    spark = build_session(f"local[{cpus}]", app="tesserae-bench", shuffle_partitions=max(cpus, 8),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    # warm-up: JVM, parquet footers, Python workers
    run_one(spark, QUERIES["doc_pipeline"], sf_dir)
    run_one(spark, QUERIES["gen_people_vec"], sf_dir)
    times, errors = {}, {}
    for n in names:
        try:
            times[n] = round(run_one(spark, QUERIES[n], sf_dir), 3)
        except Exception as e:  # noqa: BLE001  (report, keep benchmarking the rest)
            errors[n] = f"{type(e).__name__}: {e}"[:300]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": cpus}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
