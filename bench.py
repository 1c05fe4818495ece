"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from facetledger.plans import QUERIES
from facetledger.runtime import build_session

HEADLINE = (
    "primary_lens_project", "any_lens_tags", "csv_pivot_all", "kpi_summary", "matrix_cube", "session_rollup", "daily_totals",
    "keyword_tagger", "resolve_array", "classify_coverage", "topk_cosine", "beam_walk", "threshold_sweep",
    "scalar_facet_metrics", "arcs", "nearest_anchor", "session_boundaries", "back_propagation", "tag_decay", "api_log_calls",
)


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()  # start the workers
    times = {}
    for name in HEADLINE:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm: compiled plans, cached files
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
