"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from strandset.plans.catalogue import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = [
    "count_distinct_kmers", "count_canonical", "count_repeated", "sketch_minimizer", "sketch_syncmer", "hash_kmers",
    "inter_sets", "union_sets", "common_n", "diff_sets", "concat_sets", "inter_lca", "union_lca", "sort_plain", "sort_repeated",
    "grep_invert", "filter_low_complexity", "locate_bed6", "map_bed3",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.driver.memory", "12g")
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp())
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["count_canonical"](spark, SF_DIR.replace("sf0.1", "sf0.001")).count()  # a warm session
    times = {}
    for name in NAMES:
        began = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
