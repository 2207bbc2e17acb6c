"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. The offense table the exploration queries read is
derived once and timed as ``offense_table``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "summary_by_database",
    "facets_all_dimensions",
    "facets_self_excluded",
    "offense_page_newest",
    "documents_rollup",
    "chart_day_of_year_by_year",
    "map_tiles_res4",
    "plate_facts",
    "enrich_location",
    "classify_multipart",
    "location_queue",
    "geocoding_progress",
    "match_radars",
    "cosine_texts",
    "extract_records",
    "replace_documents",
    "location_cluster_report",
)


def main() -> None:
    from noticelake.session import local_session
    from workload import QUERIES
    from workload import tables as t

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "noticelake-bench")
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}

    def timed(name, action) -> None:
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    timed("offense_table", lambda: t.offenses(spark, sf_dir))
    for name in names:
        timed(name, lambda n=name: QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
