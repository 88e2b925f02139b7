"""Times the headline queries: one JSON line; BENCH_SF_DIR and BENCH_CPUS set data and cores."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from quillspan.plans import registry
from quillspan.session import local_session

HEADLINE = (
    "pricing_summary", "inner_join", "left_join", "semi_anti", "set_operations", "rollup", "basic_aggregates", "ordered_aggregates", "top_sum", "qualify", "ranking", "frames",
    "merge", "text_regexp", "text_codes", "date_arithmetic", "timestamps", "json_fields", "digests", "event_sessions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus=cpus, shuffle_partitions=cpus)
    queries, took = registry.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(median(runs[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
