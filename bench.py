"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the number of local cores. The tables are first
written again as several files, as large tables are, since a table of one row group is read
by one task; that is not timed. Each query runs once to warm up and then BENCH_RUNS times;
the median is reported. Results are computed in full and discarded.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from patchlens.plans.queries import QUERIES  # noqa: E402
from patchlens.session import local_session  # noqa: E402

HEADLINE = [
    "inverted_index",
    "keyword_search",
    "decl_blocks",
    "extract_elements",
    "parse_responses",
    "review_stats",
    "aggregate_results",
    "mr_summary_note",
    "line_comments",
    "webhook_route",
    "framework_catalog",
    "synthetic_diff",
]


def spread_tables(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables in several files each."""
    folder = tempfile.mkdtemp(prefix="bench-")
    for name in sorted(os.listdir(sf_dir)):
        spark.read.parquet(f"{sf_dir}/{name}").repartition(files).write.parquet(f"{folder}/{name}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    files = 2 * spark.sparkContext.defaultParallelism
    tables = spread_tables(spark, sf_dir, files)
    seconds: dict[str, float] = {}
    for name in wanted:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    found = re.search(r"sf([0-9.]+)/?$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "files_per_table": files,
                "sf": float(found.group(1)) if found else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
