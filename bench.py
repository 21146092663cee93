"""Time the headline queries: prints one JSON line. BENCH_SF_DIR picks the tables, BENCH_CPUS the cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.queries import QUERIES  # noqa: E402
from tablewright.session import build_session  # noqa: E402

HEADLINE = [
    "b3_token_to_null", "b4_dirty_cells", "e1_parse_numbers", "e2_standardize_dates", "c1_column_profile", "c4_describe_numbers", "c9_correlation_matrix", "c12_quality_score",
    "d1_drop_duplicates", "f1_typo_merge", "g1_null_outliers", "h1_median_mode_fill", "h3_group_fill", "h9_interpolate", "i1_changed_cells", "i4_column_audit",
    "j1_rule_sequence", "j20_column_fidelity", "k2_stratified_split", "k10_curve_points", "l1_kpis", "l5_daily_timeline", "n1_header_chunks", "n2_tfidf_search", "flagship_before_and_after",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{folder}/orders.parquet").count()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")), "order_rows": rows}))
    spark.stop()


if __name__ == "__main__":
    main()
