"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Every query runs once to warm up, then $BENCH_RUNS times (1); its time is the median. Results are
written to Spark's noop sink, so that every row and column is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from weftline.plans.catalog import QUERIES

HEADLINE = (
    "surface_form_dictionary", "sense_inventory_all", "sense_inventory_min10pct", "lemma_counts_sorted", "anchor_extract", "anchor_inlinks",
    "redirect_resolve_keep", "inlink_histogram_zero", "link_text_counts", "global_link_counters", "whitelist_links", "mid_frequency_samples",
    "word_list_offset_limit", "first_100_per_lemma", "sample_per_sense", "sample_per_word", "clean_markup", "sentence_split", "implicit_links",
    "collapse_prepositions", "cluster_eval_metrics", "leave_one_out", "wsd_choose_cluster",
)


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "sum of median query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
