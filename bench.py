"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["h1_field_metrics", "h3_review_badges", "g8_best_value", "g12_report_values", "f9_field_validation", "g1_classify",
            "f1_derived_flags", "b2_line_explode", "c6_tables", "c4_key_value_same_line", "e4_same_line_rule", "d12_label_search_any_case",
            "candidates_by_strategy"]


def main() -> None:
    from fieldloom.plans import registry
    from fieldloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # start the engine on a tiny aggregate, so that the first query does not pay for it
    spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count().write.format("noop").mode("overwrite").save()
    queries = registry.queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
