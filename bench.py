"""Time the headline queries: one warm-up on the small tables, then one timed run each.

Every query is run to its last row through the ``noop`` sink, so that no column is pruned.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tomeline.queries import all_queries
from tomeline.session import local_session

HEADLINE = [
    "search_documents",
    "search_hits",
    "search_docs",
    "catalogue_query",
    "updates_feed",
    "dedup_updates",
    "mention_join",
    "related_content_index",
    "structure_rulebook",
    "promote_headings",
    "fuzzy_name_match",
    "locate_passage",
    "html_to_markdown",
    "md_plain_client",
    "dq_unique_ids",
]


def run(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    queries = all_queries()
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    times = {}
    for name in wanted:
        run(spark, queries[name], small if os.path.isdir(small) else sf_dir)
        times[name] = round(run(spark, queries[name], sf_dir), 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
