"""Times the headline queries and prints one JSON line.

Each query runs once to warm up, then three times into the noop sink; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from checks.queries import all_queries
from scriptloom.session import build_session

HEADLINE = [
    "scan_scripts",
    "classify_scripts_annotated",
    "parse_classification",
    "new_scripts",
    "new_scripts_documents",
    "registry_insert",
    "object_type_stats",
    "stmt_type_stats",
    "worklist_table",
    "translate_table_annotated",
    "translate_function_annotated",
    "translate_view_annotated",
    "translate_trigger_annotated",
    "translate_constraint_annotated",
    "translate_registry",
    "apply_translation",
    "view_dependencies_annotated",
    "view_dependency_counts",
    "script_complexity_annotated",
    "parse_summary_reply",
    "build_prompt",
    "complete_documents",
    "chat_prompt",
    "chat_budget",
    "chat_pending",
    "chat_append",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = all_queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
