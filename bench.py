"""Times the headline queries, warm, at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["hobs_windows", "hobs_windows_fine", "hobs_groupwise", "interval_merge", "candidate_promoter", "interval_overlaps", "nearest_site", "window_diversity", "window_divergence", "pair_correlations", "kinship", "contingency_cells", "set_identity", "inventory", "reference_check", "module_lineage", "prerequisites", "latest_entries", "regime_segments", "evidence_completion"]
RUNS = 3


def main() -> None:
    from gridtally.queries import QUERIES
    from gridtally.session import session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS + 1):  # the first is the warm-up
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(median(took[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "sum of warm medians of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
