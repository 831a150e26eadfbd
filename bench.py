"""Times the headline queries on local Spark and prints one JSON line.

Each query is run once to warm up and then three times; the median counts. Results go to
a sink that keeps nothing, so every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.queries import QUERIES  # noqa: E402
from tests.session import local_session  # noqa: E402

HEADLINE = (
    "profile_columns_lineitem", "corr_matrix", "outlier_rows", "dqs_audit", "clean_full",
    "dqs_audit_lineitem", "numeric_summary", "box_stats", "duplicate_rows_lineitem", "classify_lineitem",
    "missing_by_column_documents_audit", "value_counts_top20",
)
RUNS = 3


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    seconds = {}
    for name in names or HEADLINE:
        times = []
        for run in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
