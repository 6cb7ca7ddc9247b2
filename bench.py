"""Headline queries on one machine: prints one JSON line with the median seconds of each."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tablewright import catalogue  # noqa: E402
from tablewright.session import local_session  # noqa: E402

HEADLINE = ["grp_whole", "grp_sorted", "grp_multi_key", "grp_adjacent", "grp_high_cardinality", "agg_collapse", "agg_trimmean", "agg_antimode", "agg_dpo", "agg_ppearson", "row_strbin", "row_sha256", "tbl_rmdup", "ct_count", "top_n", "top_n_grouped", "cmp_ranked_abs", "health_counts", "health_report"]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    found = catalogue.queries()
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:]), 4)
    sf = float(Path(sf_dir).name.removeprefix("sf") or 0) if Path(sf_dir).name.startswith("sf") else Path(sf_dir).name
    print(json.dumps({"metric": "sum of median seconds over headline queries", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
