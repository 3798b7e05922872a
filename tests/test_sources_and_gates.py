import json

import pytest
from pyspark.sql import functions as F

from placekit.functions import kinds, text
from placekit.operators import gates, identity, signals
from placekit.plans import build as jobs
from placekit.sources import readers


def put(tmp_path, name, body):
    path = tmp_path / name
    path.write_text(body if isinstance(body, str) else json.dumps(body), encoding="utf-8")
    return str(path)


def test_settlements_pick_any_layout_and_fail_loudly(spark, tmp_path):
    df = readers.settlements(spark, put(tmp_path, "a.csv", "ID_UC_G0,UC_NM_MN,CTR_MN_NM,P15,GCPNT_LAT,GCPNT_LON\n7,Fes, Morocco ,1200000,34.0,-5.0\n8,,Chile,9000,x,1\n9,Tiny,Chile,10,1,1\n10,,Chile,6000,1,2\n"))
    assert {(r.candidate_id, r.name, r.country, r.population) for r in df.collect()} == {("uc-7", "Fes", "Morocco", 1.2e6), ("uc-10", "Urban centre 10", "Chile", 6000.0)}
    with pytest.raises(readers.SourceError):
        readers.settlements(spark, put(tmp_path, "b.csv", "id,name\n1,x\n"))


def test_inscriptions_split_mixed_and_expand_per_party(spark, tmp_path):
    xml = """<query><row><id_number>1</id_number><site>Both</site><category>Mixed</category><states>A, B</states>
      <geolocations><poi><iso2>aa</iso2><latitude>1</latitude><longitude>2</longitude></poi><poi><iso2>bb</iso2><latitude>3</latitude><longitude>4</longitude></poi></geolocations></row>
      <row><id_number>2</id_number><site>Old</site><category>Cultural</category><states>A</states><iso_code>aa</iso_code><latitude>5</latitude><longitude>6</longitude></row></query>"""
    iso = spark.createDataFrame([("AA", "Aland"), ("BB", "Bland")], "iso2 string, country string")
    got = {(r.asset_id, r.country, r.lat) for r in readers.world_heritage(spark, put(tmp_path, "w.xml", xml), iso).collect()}
    assert got == {("whs-c-1", "Aland", 1.0), ("whs-n-1", "Aland", 1.0), ("whs-c-1", "Bland", 3.0), ("whs-n-1", "Bland", 3.0), ("whs-c-2", "Aland", 5.0)}
    raw = spark.createDataFrame([("F&eacute;s &amp; M&x; <short_description><b></short_description>",)], "t string")
    assert raw.select(readers.repair_xml(F.col("t"))).first()[0] == "Fés &amp; M&x; <short_description/>"


def test_cuisine_records_meet_the_standard_or_say_why(spark, tmp_path):
    path = put(tmp_path, "c.csv", "id,name_en,name_local,country,lat,lon,radius_km,dishes,sources,is_modal,retrieved\n1,A,Aa,X,1,1,80,a|b|c,s|t,yes,2024-01-01\n2,B,,X,1,1,900,a,s,no,\n")
    assert [r.asset_id for r in readers.cuisine(spark, path, strict=False).collect()] == ["cuisine-1"]
    assert len(readers.cuisine_rejects(readers.cuisine_records(spark, path)).first().problems) == 5
    with pytest.raises(readers.SourceError):
        readers.cuisine(spark, path)


def test_saved_results_become_assets(spark, tmp_path):
    b = lambda q, p, n: {"item": {"value": f"http://w/{q}"}, "coord": {"value": p}, "sitelinks": {"value": n}}
    path = put(tmp_path, "h.json", {"results": {"bindings": [b("Q1", "Point(-7.5 33.5)", "9"), b("Q2", "nowhere", "9"), b("Q3", "Point(1 1)", "2")]}})
    assert [(r.asset_id, r.lat, r.lon) for r in readers.wikidata(spark, {"heritage": path}).collect()] == [("wd-h-Q1", 33.5, -7.5)]
    osm = put(tmp_path, "o.json", {"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"historic": "castle", "craft": "pottery"}},
                                                {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"natural": "peak"}}]})
    assert {(r.asset_id, r.tier) for r in readers.openstreetmap(spark, osm).collect()} == {("osm-node-1", "osm_heritage"), ("osm-node-1", "craft_cluster")}
    assert {(r.point_id, r.kind) for r in readers.osm_kind_points(readers.osm_elements(spark, osm)).collect()} == {("osm-node-1", "A11"), ("osm-way-2", "A4")}


def test_config_needs_known_sources_and_candidates(spark, tmp_path):
    towns = put(tmp_path, "t.csv", "name,country,population,lat,lon\nA,X,9000,1,1\n")
    got = readers.load(spark, {"countries": {"X": {"area_km2": 5}}, "sources": {"ghsl-ucdb": {"path": towns}}})
    assert got[0].count() == 1 and got[1].count() == 0 and got[3].first().source == "ghsl-ucdb"
    for bad in ({"nope": {}}, {}):
        with pytest.raises(readers.SourceError):
            readers.load(spark, {"countries": {"X": {"area_km2": 5}}, "sources": bad})


def test_unknown_visa_wording_is_an_error(spark):
    df = spark.createDataFrame([("90",), (" Visa Free",), ("eta",), ("-1",)], "q string")
    assert [tuple(r.e) for r in df.select(text.entry_state(F.col("q")).alias("e")).collect()] == [("vf", 90, None), ("vf", None, None), ("ev", None, "eta"), ("home", None, None)]
    with pytest.raises(Exception, match="unhandled requirement"):
        spark.createDataFrame([("maybe",)], "q string").select(text.entry_state(F.col("q")).alias("e")).collect()


def test_signals_fill_only_what_they_may(spark, cands):
    rows = cands(dict(id="MAR-1", lat=34.0331, lon=-5.0003, kinds={"A11": .6, "A12": .54, "A2": .5, "A3": .4}), dict(id="E-2", lat=10.0, lon=10.0),
                 dict(id="E-3", lat=10.4, lon=10.0), dict(id="E-4", lat=-40.0, lon=1.0)).withColumnRenamed("candidate_id", "place_id")
    pt = "point_id string, lat double, lon double"
    harvest = spark.createDataFrame([("k1", 10.0, 10.0, "A2", .5), ("k2", 34.04, -5.0, "A4", .9)], pt + ", kind string, weight double")
    out = signals.apply_signals(rows, signals.Layers(capitals=spark.createDataFrame([("q", 34.0331, -5.0003)], pt), harvest=harvest,
                                                     manual=spark.createDataFrame([("E-4", "A12", .6), ("MAR-1", "A5", .9)], "place_id string, kind string, weight double")))
    got = {r.place_id: r.k for r in out.select("place_id", kinds.names(F.col("kinds")).alias("k")).collect()}
    assert got == {"MAR-1": ["A1", "A11", "A12", "A2"], "E-2": ["A2"], "E-3": [], "E-4": ["A12"]}
    stats = signals.signal_stats(out).first()
    assert (stats.capital, stats.harvest, stats.manual, stats.still_empty) == (1, 1, 1, 1)


def bundle(spark, **change):
    """Two places with every kind, one region and tile each; ``change`` edits one table."""
    t = {
        "places": spark.createDataFrame([("AAA-1", "Alpha", "Aland", "AAA", 1.0, 1.0, 4095, True, "AAA-R01", 90, 1, None), ("BBB-1", "Beta", "Bland", "BBB", 5.0, 5.0, 1, False, "BBB-R01", 80, 0, None)],
                                        "place_id string, name string, country string, iso3 string, lat double, lon double, kmask int, printed boolean, region_id string, score int, whs int, disputed string"),
        "tiles": spark.createDataFrame([("AAA-T01", "AAA", "Aland")], "territory_id string, iso3 string, country string"),
        "gaps": spark.createDataFrame([("Aland", 0.01, True)], "grp string, gap double, ok boolean"),
        "regions": spark.createDataFrame([("AAA-R01", "AAA", "Alpha-North"), ("BBB-R01", "BBB", "Beta")], "region_id string, iso3 string, name string"),
    }
    t["previous"] = identity.snapshot(t["places"])
    t["mapping"] = spark.createDataFrame([], "old_id string, new_id string")
    t["manifest"] = identity.bundle_counts(t["places"], t["tiles"]).join(identity.build_number(t["places"]))
    t.update({k: f(t) for k, f in change.items()})
    g = gates.kind_audit(t["places"]).unionByName(gates.region_coverage(t["places"], t["gaps"])).unionByName(gates.dissolve_resolution(t["places"], t["tiles"]))
    return (g.unionByName(gates.polygon_naming(t["places"].select("name", "region_id", "iso3"), t["regions"]))
            .unionByName(gates.id_stability(t["places"], t["previous"], t["mapping"])).unionByName(gates.manifest_agreement(t["places"], t["tiles"], t["manifest"])))


BROKEN = {
    "kind_audit": dict(places=lambda t: t["places"].withColumn("kmask", F.when(F.col("iso3") == "BBB", 0).otherwise(F.col("kmask")))),
    "region_coverage": dict(gaps=lambda t: t["gaps"].withColumn("ok", F.lit(False))),
    "dissolve_resolution": dict(tiles=lambda t: t["tiles"].withColumn("iso3", F.lit("ESH"))),
    "polygon_naming": dict(regions=lambda t: t["regions"].withColumn("region_id", F.when(F.col("iso3") == "AAA", "AAA-R02").otherwise(F.col("region_id")))),
    "place_id_stability": dict(previous=lambda t: t["previous"].withColumn("name", F.lit("Other"))),
    "manifest_agreement": dict(manifest=lambda t: t["manifest"].withColumn("places", F.lit(3))),
}


def test_a_valid_bundle_clears_every_gate(spark):
    assert gates.failed(bundle(spark)) == []


@pytest.mark.parametrize("gate", gates.GATES)
def test_a_broken_bundle_trips_its_own_gate(spark, gate):
    assert gates.failed(bundle(spark, **BROKEN[gate])) == [gate]


def test_renames_need_a_mapping_and_a_relabelled_country_is_the_same_place(spark):
    old = spark.createDataFrame([("A-1", "Dakhla", "W. Sahara", 23.7, -15.9), ("B-1", "Beta", "B", 1.0, 1.0)], "place_id string, name string, country string, lat double, lon double")
    new = spark.createDataFrame([("A-1", "Dakhla", "Morocco", 23.7, -15.9), ("B-9", "Beta", "B", 1.0, 1.0)], old.schema)
    none = spark.createDataFrame([], "old_id string, new_id string")
    assert [(r.problem, r.place_id) for r in identity.stability(old, new, none).collect()] == [("vanished", "B-1")]
    assert identity.stability(old, new, spark.createDataFrame([("B-1", "B-9")], none.schema)).count() == 0


def test_a_failed_publish_leaves_the_live_version(spark, tmp_path):
    live = str(tmp_path / "live")
    places = spark.createDataFrame([("A-1", "Alpha", "A", "AAA", 1.0, 1.0, 3, True)], "place_id string, name string, country string, iso3 string, lat double, lon double, kmask int, printed boolean")
    one = {n: places.select("place_id", F.lit(1).alias("x")) for n in ("pins", "index", "kinds", "territories", "manifest")} | {"places": places}
    verdict = lambda ok: (lambda b: b["places"].select(F.lit("kind_audit").alias("gate"), F.lit("r").alias("rule"), F.lit(ok).alias("ok")))
    assert jobs.live_version(spark, live) is None
    jobs.publish(spark, one, live, verdict(True))
    first = jobs.live_version(spark, live)
    assert gates.failed(jobs.publish(spark, one, live, verdict(False))) == ["kind_audit"]
    assert jobs.live_version(spark, live) == first and first
    jobs.publish(spark, one, live, verdict(True))
    second = jobs.live_version(spark, live)
    assert second not in (None, first)
    # every version keeps its report, also the one that failed
    assert sorted(r.ok for r in spark.read.parquet(f"{live}/versions/*/gates").collect()) == [False, True, True]


def test_of_two_publishers_at_once_one_is_refused(spark, tmp_path):
    live = str(tmp_path / "live")
    places = spark.createDataFrame([("A-1", "Alpha", "A", "AAA", 1.0, 1.0, 3, True)], "place_id string, name string, country string, iso3 string, lat double, lon double, kmask int, printed boolean")
    bundle = {n: places.select("place_id", F.lit(1).alias("x")) for n in ("pins", "index", "kinds", "territories", "manifest")} | {"places": places}
    fine = lambda b: b["places"].select(F.lit("kind_audit").alias("gate"), F.lit("r").alias("rule"), F.lit(True).alias("ok"))
    inner = []

    def gate_while_another_publishes(b):
        inner.append(jobs.publish(spark, bundle, live, fine))
        return fine(b)

    with pytest.raises(jobs.Overtaken):
        jobs.publish(spark, bundle, live, gate_while_another_publishes)
    first = jobs.live_version(spark, live)
    assert first and len(inner) == 1
    # a pointer that a crash left empty is nobody's, and its number is not given again
    (tmp_path / "live" / "current" / "000000002.json").write_text("")
    assert jobs.live_version(spark, live) == first
    jobs.publish(spark, bundle, live, fine)
    assert jobs.live_version(spark, live) not in (None, first)


def test_a_town_needs_its_own_region_to_bear_its_name(spark):
    regions = spark.createDataFrame([("R1", "M", "Tanger-Tetouan"), ("R2", "M", "Souss"), ("R3", "M", "Greater Tangier")], "region_id string, iso3 string, name string")
    towns = lambda r: spark.createDataFrame([("Tangier", r, "M")], "name string, region_id string, iso3 string")
    assert {r: gates.polygon_naming(towns(r), regions).first().ok for r in ("R1", "R2", "R3", "R4")} == {"R1": True, "R2": False, "R3": True, "R4": False}
