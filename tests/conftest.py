import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from placekit.plans.session import tune

    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.driver.memory", "6g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return tune(s)


@pytest.fixture(scope="session")
def cands(spark):
    """Build candidate rows from dicts, with defaults."""
    from pyspark.sql import functions as F

    from placekit.functions import kinds
    from placekit.functions.vocab import KIND_CODES, TIER_NAMES
    from placekit.operators.resolve import complete

    def make(*rows):
        out = []
        for r in rows:
            vec = [float(r.get("kinds", {}).get(c, 0.0)) for c in KIND_CODES]
            tiers = [int(r.get("tiers", {}).get(t, 0)) for t in TIER_NAMES]
            out.append((r["id"], r.get("name", r["id"]), r.get("country", "X"), float(r.get("lat", 0.0)), float(r.get("lon", 0.0)),
                        bool(r.get("is_site", False)), float(r.get("population", 0.0)), tiers, list(r.get("landforms", [])),
                        float(r.get("relief_m", 0.0)), float(r.get("coherence", 0.0)), r.get("reach", "near"), r.get("has_lodging", True),
                        r.get("access", "open"), vec, sorted(r.get("sources", [])), r.get("profile", {})))
        df = spark.createDataFrame(out, "candidate_id string, name string, country string, lat double, lon double, is_site boolean, population double, "
                                        "tiers array<bigint>, landforms array<string>, relief_m double, coherence double, reach string, has_lodging boolean, "
                                        "access string, kinds array<double>, sources array<string>, profile map<string,string>")
        return complete(df)

    return make
