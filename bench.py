"""Time the headline queries and print one JSON line.

BENCH_SF_DIR is the data folder and BENCH_CPUS the number of local threads;
BENCH_QUERIES, a comma-separated list, picks other queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowspark import catalog  # noqa: E402
from flowspark.session import get_spark  # noqa: E402

HEADLINE = (
    "flow_features_by_class flow_validation preprocess_flows raw_adapter fix_data_issues describe_numeric "
    "categorical_summary label_encode undersample balance_to_target split_80_20 split_70_15_15 "
    "two_stage_detect detection_summary accuracy_metrics classification_report confusion_matrix smote "
    "stream_preprocess train_two_stage class_neighbours tomek_links"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": str(2 * int(cpus)),
    }
    spark = get_spark("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    for table in ("orders", "lineitem"):
        spark.read.parquet(f"{folder}/{table}.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
