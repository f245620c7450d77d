"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with seconds per query and their sum."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "flagship_words_in_lines",
    "scan_words",
    "scan_known_selections",
    "join_data_annotations",
    "join_resource_annotations",
    "data_op_after_datetime",
    "filter_annotations_text",
    "filter_annotations_regex",
    "rel_overlaps",
    "rel_embeds",
    "rel_embedded",
    "rel_precedes",
    "rel_succeeds_exact",
    "rel_before_near",
    "text_find",
    "text_find_nocase",
    "text_split",
    "text_regex",
    "text_segmentation",
    "lang_data",
    "lang_nested_relation",
    "count_annotations_per_key",
    "ext_checksum",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from spanloom.plans import catalogue, derive

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, seconds = catalogue.queries(), {}
    known["data_op_any"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the session's own start
    began = time.time()
    derive.corpus(spark, sf_dir)  # the store that several queries read, written once a session
    seconds["store_build"] = round(time.time() - began, 3)
    for name in HEADLINE:
        began = time.time()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
