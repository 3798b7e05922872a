"""Time headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "nearest_asset_assignment", "area_fanout", "close_pairs", "nearby_places", "country_scores", "quotas", "top_per_country",
    "coverage_by_user_country", "filter_places", "distributed_take", "zoom_clusters", "search_hits", "lww_visits", "trip_order",
    "passport_summary", "point_in_region", "nearest_region", "border_lengths", "transliteration_merge", "agglomerate",
    "absorb_near_duplicates", "density_cap", "coverage_selection", "build_number", "full_build",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from placekit.plans.queries import QUERIES
    from placekit.plans.session import release

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-bench-")).config("spark.driver.memory", "16g")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["country_index"](spark, sf_dir).collect()  # start-up is not a query

    def timed(folder: str) -> dict[str, float]:
        times = {}
        for name in only or HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            print(f"{name} {times[name]}", file=sys.stderr, flush=True)
            release(spark)
        return times

    times = timed(sf_dir)
    out = {"metric": "placekit_headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}
    tenth = Path(sf_dir.rstrip("/")).parent / "sf0.01"
    if out["sf"] == "0.1" and tenth.is_dir():  # the same at a tenth of the data, so growth can be judged
        out["queries_sf0.01"] = timed(str(tenth))
    print(json.dumps(out))


if __name__ == "__main__":
    main()
