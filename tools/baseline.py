"""DuckDB seconds of the headline queries' SQL twins: median of 3 after one warm-up."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import bench  # noqa: E402
from barlake.workloads import QUERIES  # noqa: E402
from tools.check_oracle import TABLES  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    con = duckdb.connect()
    con.execute(f"SET threads = {os.environ.get('BENCH_CPUS', '8')}")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    seconds = {}
    for name in bench.HEADLINE + bench.JOBS:
        text = QUERIES[name].sql
        if text is None:
            continue
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            con.execute(text).to_arrow_table()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"queries": seconds, "total": round(sum(seconds.values()), 3)}))


if __name__ == "__main__":
    main()
