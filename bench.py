"""Wall time of the headline queries; prints one JSON line.

Each query is built, planned and run to the end into a sink that drops the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time
import warnings
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallymark import build_session  # noqa: E402
from workload import book  # noqa: E402

HEADLINE = (
    "revenue_by_segment_and_month", "j1_path_to_region", "j4_drill_across", "a4_count_distinct", "a10_at_grain",
    "a15_derived_across_entities", "a16_semi_additive", "a17_many_measures", "a19_profile", "a20_pre_aggregate_then_join",
    "w1_previous_period", "w2_last_value_so_far", "w3_latest_per_key", "w5_rolling_7d", "j5_mart", "s2_keep_last", "q1_unique", "q3_all_links",
    "q6_join_fanout", "q9_metric_safety", "q14_rule_scan", "q18_diff_snapshots", "q22_reconcile_views", "x6_mask_literals_in_documents",
    "l1_fingerprints", "l4_usage_daily", "l10_usage_stream", "g2_neighbors_2", "g3_reachable_from_every_order", "g6_cycles",
    "c3_align_names", "c5_detect_drift",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(book.queries)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.log.level": "ERROR"},
    )
    warnings.simplefilter("ignore")
    # One small query first, so that starting the engine is not billed to the first name.
    book.queries["a1_sum"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        book.queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
