"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the seconds of each.

Every query runs once to warm up and then three times; its median counts. Results go to
Spark's noop sink, so all rows are computed and none are kept.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fathomic import queries as core  # noqa: E402
from fathomic.session import spark_session  # noqa: E402

HEADLINE = [
    "pricing_summary", "shape_01_count", "shape_03_sum_count_avg", "shape_05_count_distinct_int", "shape_09_group_distinct_top", "shape_17_key_text_top",
    "shape_21_like_count", "shape_23_like_not_like", "shape_29_regex_domain", "shape_30_many_sums", "shape_32_wide_keys_filtered", "shape_33_wide_keys",
    "shape_36_dependent_keys", "shape_40_case_key", "shape_43_date_trunc", "join_inner_two_keys", "join_aggregate_top", "sub_correlated_in", "sub_all", "sub_not_in",
    "window_ranks", "top_per_group", "rolling_by_key", "rolling_centered", "drop_duplicates_first", "pivot_table_margins", "melt", "fused_sums", "change_state", "change_hybrid",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = spark_session(f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false", spark_driver_memory="8g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    known = core.queries()
    seconds = {}
    for name in HEADLINE:
        times = []
        for k in range(4):
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k:
                times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name, "cpus": int(cpus)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
