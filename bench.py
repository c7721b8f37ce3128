"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from pyspark.sql import SparkSession

from midden import registry

HEADLINE = ["set_quality", "bin_quality_flat", "n50_per_bin", "cobin_affinity", "knn_topk", "knn_kernel_edges", "label_modularity", "shared_marker_penalty", "idf_connectivity", "kish_neff", "decay_fit", "gtest_score", "depth_segments", "coverage_jump", "breakpoint_votes", "merged_intervals", "covered_positions", "gc_fraction", "tetranucleotides", "kmer_entropy"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES[HEADLINE[0]](spark, sf_dir).count()  # start the engine
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
