"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from custodia.queries import QUERIES
from custodia.session import build_session

HEADLINE = (
    "m01_mart_deposits",
    "m02_mart_customer_360",
    "s01_read_csv",
    "k08_upsert",
    "q03_validity",
    "q06_accuracy_drift",
    "q12_outcomes",
    "q15_dq_summary",
    "q18_population",
    "c03_classify_schema",
    "c03_scan_text_documents",
    "c05_luhn",
    "c07_evaluate",
    "c11_refresh_queue",
    "r05_masked_table",
    "r06_propagate_tags",
    "r08_row_filter",
    "r10_policy_gaps",
    "d12_catalog_master",
    "n01_refresh_lineage",
    "n02_downstream",
    "n05_impact_fallback",
    "e01_adoption_of_all",
    "e11_certify_runs",
    "x01_search",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "custodia-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["m01_mart_deposits"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("/", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
