"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from pixelweave.plans import queries as plans

HEADLINE = ["subtract", "seed_candidates", "near_pairs", "blob_stats", "feature_shape", "surface_ratio", "direct_overlap", "bbox_overlap_score", "alpha_plane", "blend", "class_stats", "split_scores", "grow_blobs", "decision_counts", "best_line", "connect_lines", "filter_pipeline"]


def main() -> None:
    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    work = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", work).config("spark.sql.warehouse.dir", f"{work}/warehouse").config("spark.checkpoint.dir", f"file://{work}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):  # the first compiles
            began = time.time()
            plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    px = {name: plans.QUERIES[name](spark, sf_dir).count() for name in ("px_sparse", "px_dense")}
    speed = {n: round(px["px_sparse"] / took[n]) for n in ("subtract", "seed_candidates", "near_pairs")} | {"grow_blobs": round(px["px_dense"] / took["grow_blobs"])}
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "pixels_per_second": speed}))
    spark.stop()


if __name__ == "__main__":
    main()
