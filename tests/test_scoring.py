import random

import pytest
from pyspark.sql import functions as F

from placekit.functions import geo, kinds
from placekit.functions.vocab import PARAMS
from placekit.operators import classify, scoring, selection


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_tiers_saturate_but_depth_stays_visible(cands):
    rows = {r.candidate_id: r.s for r in cands(
        dict(id="a", tiers={"whs_cultural": 1, "national_top": 40, "national_other": 400}),
        dict(id="b", tiers={"whs_cultural": 1, "national_top": 8, "national_other": 60}), dict(id="c", tiers={"whs_cultural": 1}),
        dict(id="d", tiers={"national_other": 10_000})).select("candidate_id", scoring.tiered_sum("tiers", "H").alias("s")).collect()}
    assert (round(rows["a"], 1), round(rows["b"], 1), rows["c"]) == (82.3, 49.3, pytest.approx(10.0))
    assert rows["d"] == pytest.approx(20.0)


def test_rarity_is_capped_for_a_lone_landform(spark):
    w = lambda f, lone: scoring.landform_weight(F.lit(f), F.lit(lone))
    r = one(spark, w("volcano", False).alias("v"), w("volcano", True).alias("lone"), w("coast", False).alias("c"), w("marsh", False).alias("u"))
    assert r.v > 5 and (r.lone, r.c, r.u) == (3.0, 1.0, 1.0)


def test_linear_norm_keeps_magnitude(spark):
    df = spark.createDataFrame([("g", 100.0), ("g", 58.0), ("g", 10.0), ("z", 0.0)], "g string, v double")
    got = sorted(r.n for r in scoring.against_top(df, "g", {"n": "v"}).collect())
    assert got == [0.0, 0.1, 0.58, 1.0]


def test_power_mean_lifts_a_specialist(cands):
    df = cands(dict(id="park", tiers={"whs_natural": 1, "wdpa_iucn_i_ii": 1}, landforms=["mountain", "glacier"], relief_m=2500),
               dict(id="town", tiers={"national_top": 4, "institution": 4, "market": 3, "national_other": 20}, landforms=["river"]))
    s = {p: {r.candidate_id: r.score for r in scoring.score(df, PARAMS.with_(power=p)).collect()} for p in (1.0, 2.0)}
    assert s[2.0]["park"] / s[2.0]["town"] > s[1.0]["park"] / s[1.0]["town"]


def test_feasibility_only_penalises_and_distinctiveness_is_off(cands):
    df = cands(dict(id="easy"), dict(id="hard", reach="remote", has_lodging=False), dict(id="shut", access="closed"))
    got = {r.candidate_id: r.f for r in df.select("candidate_id", scoring.feasibility().alias("f")).collect()}
    assert got == {"easy": 1.0, "hard": pytest.approx(0.3), "shut": 0.0}
    odd = cands(dict(id="odd", population=1e5, profile={"language": "a:b"}), dict(id="norm", population=9e6, profile={"language": "x:y"}))
    assert {r.distinctiveness for r in scoring.distinctiveness(odd).collect()} == {1.0}
    assert {r.candidate_id: r.distinctiveness > 1 for r in scoring.distinctiveness(odd, PARAMS.with_(beta=.6)).collect()} == {"odd": True, "norm": False}


def test_kinds_come_from_evidence_with_a_fallback(cands):
    got = {r.candidate_id: r.k for r in classify.derive(cands(
        dict(id="sea", landforms=["coast", "river"]), dict(id="none"), dict(id="site", is_site=True),
        dict(id="old", tiers={"whs_cultural": 1}, coherence=.7))).select("candidate_id", kinds.names(F.col("kinds")).alias("k")).collect()}
    assert got == {"sea": ["A3"], "none": ["A12"], "site": ["A11"], "old": ["A2"]}


def test_printed_map_arithmetic(spark):
    s = geo.map_scale(F.lit(3.0))
    r = one(spark, s["km_per_mm"].alias("a"), s["min_place_separation_km"].alias("b"), geo.width_for_separation(F.lit(15.0)).alias("c"),
            geo.min_spacing(F.lit(446_550.0), F.lit(8)).alias("d"), geo.min_spacing(F.lit(9_834_000.0), F.lit(12)).alias("e"),
            geo.haversine(F.lit(48.8566), F.lit(2.3522), F.lit(48.8049), F.lit(2.1204)).alias("f"))
    assert (round(r.a, 1), round(r.b), round(r.c, 1), round(r.d), round(r.e), round(r.f)) == (13.4, 60, 12.0, 83, 317, 18)


def pool(spark, n=120):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        vec = [0.0] * 12
        for _ in range(2):
            vec[rnd.randrange(12)] = rnd.choice([.4, .6, .9])
        rows.append(("X" if i % 3 else "Y", f"c{i:03d}", f"n{i}", rnd.uniform(0, 9), rnd.uniform(0, 9), rnd.random(), 1.0, vec))
    scored = spark.createDataFrame(rows, "country string, candidate_id string, name string, lat double, lon double, score double, feasibility double, kinds array<double>")
    quotas = spark.createDataFrame([("X", 12, 400_000.0), ("Y", 7, 90_000.0)], "country string, quota int, area_km2 double")
    return scored, quotas


def test_selection_is_the_same_when_most_rows_are_left_to_rounds(spark):
    scored, quotas = pool(spark)
    for pick in (selection.select_coverage, selection.select_by_rank):
        whole = {(r.country, r.candidate_id, r.pick) for r in pick(scored, quotas).collect()}
        part = {(r.country, r.candidate_id, r.pick) for r in pick(scored, quotas, head_rows=6).collect()}
        assert whole == part and len(whole) > 10


def test_selection_keeps_its_spacing_and_is_more_varied_than_ranking(spark):
    scored, quotas = pool(spark)
    stats = {}
    for name, pick in (("cover", selection.select_coverage), ("rank", selection.select_by_rank)):
        chosen = scored.join(pick(scored, quotas).select("candidate_id"), "candidate_id", "left_semi")
        stats[name] = {r.country: r for r in selection.pair_stats(chosen).collect()}
    assert min(r.closest_km for r in stats["cover"].values()) >= 60
    assert stats["cover"]["X"].redundancy < stats["rank"]["X"].redundancy


def test_vector_parts_are_worked_out_once(spark):
    # a lambda that names a whole ranking ranks again for each of the twelve elements
    df = spark.createDataFrame([([0.9, 0.0, 0.5, 0.5, 0.0, 0.61, 0.0, 0.0, 0.7, 0.0, 0.0, 0.0],)], "v array<double>")
    plan = df.select(kinds.keep_top(F.col("v")).alias("top"))._jdf.queryExecution().analyzed().toString()
    assert "array_contains(lambda" in plan and plan.count("zip_with") == 1
    assert "/ sqrt" not in df.select(kinds.unit(F.col("v")).alias("unit"))._jdf.queryExecution().analyzed().toString().lower()
    row = df.select(kinds.keep_top(F.col("v"), 3, 0.3).alias("top"), kinds.unit(F.col("v")).alias("unit")).first()
    assert row["top"] == [0.9, 0.0, 0.0, 0.0, 0.0, 0.61, 0.0, 0.0, 0.7, 0.0, 0.0, 0.0]
    assert abs(sum(w * w for w in row["unit"]) - 1.0) < 1e-12
