"""Time the headline queries and print one JSON line.

BENCH_SF_DIR    tables to read      (default /root/testdata/sf0.1)
BENCH_CPUS      local cores         (default 8)
BENCH_REPEAT    timed runs per query after one warm-up; the median counts (default 3)
BENCH_QUERIES   comma-separated names instead of the headline list
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

from permscan.queries import QUERIES
from permscan.session import local_session
from permscan.staging import release

HEADLINE = [
    "pooled_null",
    "per_run_summary",
    "minp_threshold",
    "results_view",
    "top_hits",
    "effect_z_rank",
    "h2_rank",
    "qc_rows",
    "qc_flag_counts",
    "empirical_p_variant",
    "empirical_p_pooled",
    "bh_qvalues",
    "trait_extract",
    "trait_valid_counts",
    "keyed_permutation",
    "numpy_permutation",
    "assoc_scan",
    "assoc_observed",
    "redundancy_verdict",
    "set_normalize",
    "convert_normalized",
    "convert_inline",
    "job_matrix",
    "job_status",
    "rolling_eta",
]


def timed(spark, sf_dir, name):
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        timed(spark, sf_dir, name)
        seconds[name] = round(statistics.median(timed(spark, sf_dir, name) for _ in range(repeat)), 4)
        print(f"{name:24s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    release(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
