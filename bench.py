"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else None


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tessera.session import local_session
    from tessera.plans.catalog import CATALOG, HEADLINE as DEFAULT_HEADLINE
    spark = local_session(cores=cpus, app="tessera-bench", shuffle_partitions=int(cpus) * 2)
    names = HEADLINE or DEFAULT_HEADLINE
    times = {}
    # a query that never changes, as a measure of the machine
    t = time.time()
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for _ in range(5):
        lines.groupBy("l_returnflag", "l_linestatus").agg({"l_quantity": "sum", "l_extendedprice": "avg"}) \
            .write.format("noop").mode("overwrite").save()
    control = round(time.time() - t, 3)
    for n in names:
        fn = CATALOG[n][0]
        t = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "control": control}))


if __name__ == "__main__":
    main()
