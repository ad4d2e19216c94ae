"""Times the headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from plumbline.plans import registry

HEADLINE = ("station_scores", "fix_rate_drop", "mass_disconnect", "region_integrity_scores", "cusum_ewma_v2", "interference_clusters", "classify_interference", "trust_scores", "distance_join",
            "nearest_join", "coverage_cells", "zone_integrity", "protection_levels", "morans_i", "cycle_slips", "multipath", "features_18", "usage_by_region", "sla_report", "window_stats")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    run = dict(registry.QUERIES)
    try:
        from plumbline.llm import entry

        run |= entry.QUERIES
    except ModuleNotFoundError:
        pass
    names = [n for n in (*HEADLINE, *sorted(n for n in run if n.startswith("op"))) if n in run]
    run[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    seconds = {}
    for name in names:
        begun = time.time()
        run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begun, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
