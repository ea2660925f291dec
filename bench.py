"""Benchmark of headline queries. Prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is forced end to end with the ``noop`` sink; one warm-up run of a small query
first so JVM start-up is not charged to a query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textloom.registry import QUERIES, load_all  # noqa: E402
from textloom.session import local_session  # noqa: E402

HEADLINE = [
    "scrape_segments",
    "html_text",
    "page_links",
    "count_tokens",
    "budget_cutoff",
    "pack_segments",
    "tree_map",
    "resolve_py",
    "import_closure",
    "line_diff",
    "assemble_chunks",
    "mine_classes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="textloom-bench")
    load_all()
    QUERIES["normalize_url"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for key in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec_headline_queries", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
