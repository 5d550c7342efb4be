"""Headline queries on the bench tables: one JSON line with seconds per query.

BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_ONLY    comma-separated query names instead of the headline list
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barlake import session  # noqa: E402
from barlake.workloads import QUERIES  # noqa: E402
from barlake.workloads import inputs  # noqa: E402

HEADLINE = [
    "a1_ticker_ranges", "w1_fold_duplicates", "w1_fold_typed_feed", "w2_keep_last_by_source", "j4_upsert_window",
    "j4_upsert_small_side", "w5_repeated_keys", "w7_global_position", "a3_rows_per_year", "a11_duplicate_rows",
    "a12_distinct_tickers_years", "o1_canonical_sort", "u4_key_difference", "p1_normalize_ticker", "p3_depositary_reason",
    "p4_non_common_reason", "p7_extract_market_cap", "p11_exclusion_cascade", "p15_numeric_coerce", "p16_valid_bar",
    "p20_universe_fingerprint", "p22_distinct_records", "w3_best_candidate", "o4_top_k", "s5_screener_pages", "s7_wide_to_long",
    "s9_pruned_years", "j5_build_coverage", "j7_incremental_coverage", "j8_expected_active", "a7_target_coverage", "a15_resolve_status",
    "j13_copy_reconciliation", "j15_latest_settled_session", "v1_normalised_rows_gate", "k1_year_partitions", "w6_stored_order",
    "q1_clean_bars",
]
JOBS = ["q3_build_universe", "q5_backfill", "q6_refresh", "t1_refresh_stream"]


def timed(spark, name: str, sf: str) -> float:
    if name in JOBS:
        inputs.forget()
    began = time.perf_counter()
    QUERIES[name].run(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY")
    names = only.split(",") if only else HEADLINE + JOBS
    spark = (
        session.builder("bench")
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        if name not in JOBS:
            timed(spark, name, sf)
        runs = [timed(spark, name, sf) for _ in range(1 if name in JOBS else 2)]
        seconds[name] = round(statistics.median(runs), 3)
    total = round(sum(seconds.values()), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
