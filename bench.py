"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is run to completion with a no-op sink, cached data dropped in between, after one
warm-up query; the time is the median of BENCH_RUNS runs (default 1).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from foliary.plans import all_queries  # noqa: E402
from foliary.session import local_session  # noqa: E402

HEADLINE = [
    "t7_same_entity",
    "t9_furniture_tokens",
    "t14_describe_difference",
    "s5_lines_from_blocks",
    "s10_type_cells",
    "j1_extract_json",
    "g3_group_words_into_lines",
    "g5_boxes_for_ranges",
    "g8_resolve_answers",
    "q1_page_geometry",
    "q2_page_completeness",
    "h2_span_issues",
    "p2_ranked_pool",
    "source_furniture_report",
    "v1_citation_outcome",
    "v6_locate_outcomes",
    "v9_refuse_overlaps",
    "v13_check_for_continuation",
    "v19_verify_cited_values",
    "a1_reconcile",
    "a8_plan_export",
    "l4_ledger_rows",
    "d3_apply_decisions",
    "d16_remove_sources",
    "u1_screen_digested",
    "u5_compare_runs",
    "u6_cached_requests",
    "r2_pool_listing",
    "r9_sheet_rows",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(f"local[{cpus}]", cpus)
    queries, _ = all_queries()

    def once(name: str) -> float:
        spark.catalog.clearCache()
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once("l4_ledger_rows")
    times = {name: round(statistics.median(once(name) for _ in range(runs)), 3) for name in HEADLINE}
    sf = Path(folder).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
