"""Times the headline queries and prints one line of JSON. The tables are files of one row group, so rows are dealt over the
cores first (textquarry.spread)."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINES = ["master_features", "master_surface", "readability", "lexical_richness", "discourse", "sentiment", "perplexity", "token_ranks", "consistency", "entity_grid", "pos", "dependency", "curvature", "per_user", "semantic"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("textquarry.spread", cpus).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from textquarry.plans import registry

    took = {}
    for name in HEADLINES:
        began = time.time()
        registry.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
