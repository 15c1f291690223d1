"""Time the headline queries: one JSON line with seconds per query.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "c4_all_chat_messages", "c5_search_messages", "d1_text_key", "d7_distinct_texts", "t10_money", "t16_project_titles",
    "t22_extract_listings", "d2_keep_earliest", "d7_extract_once", "a2_project_summaries", "i12_batch_inventory",
    "i13_build_inventory", "k1_csv_file", "w2_stream_inventory",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one small run, so that no query is charged for starting the JVM and the Python workers
    QUERIES["i13_build_inventory"](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        started = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 2)
    total = round(sum(seconds.values()), 2)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": total, "unit": "sec", "queries": seconds,
        "sf": Path(SF_DIR).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
