"""Resolution rules on small cases, and distributed rounds against the plain ordered walk."""

import random

import numpy as np
import ordered_walks
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placekit.functions.vocab import PARAMS
from placekit.operators import folding, resolve


def ids(df):
    return {r.candidate_id for r in df.select("candidate_id").collect()}


AGADIR = dict(id="agadir", name="Agadir", country="Morocco", lat=30.4202, lon=-9.5982)
MELLOUL = dict(id="melloul", name="Aït Melloul", country="Morocco", lat=30.3416, lon=-9.5036, population=187_652)


def test_two_spellings_at_one_point_are_one_place(cands):
    at = dict(country="Mongolia", lat=47.7069, lon=106.9528)
    got = resolve.merge_transliterations(cands(dict(id="d", name="Dzuunmod", sources=["ghsl-ucdb"], **at),
                                               dict(id="z", name="Zuunmod", sources=["ghsl-ucdb", "osm"], **at), dict(id="f", name="Fes", **at)))
    assert ids(got.kept) == {"z", "f"}
    row = got.log.first()
    assert (row.country, row.guest_id, row.host_id, row.decision) == ("Mongolia", "d", "z", "transliteration")
    assert [r.n for r in resolve.absorption_counts(got.log).collect()] == [1]


def test_names_fold_alike_with_and_without_marks(spark):
    from placekit.functions import text

    rows = ["Aït Melloul", "AIT-Melloul 2", "Straße", "Fès", "", None, "Ｗide", "İzmir", "Łódź", "a\nb"]
    got = spark.createDataFrame([(r,) for r in rows], "n string").select(text.fold_key("n"), text.fold_words("n")).collect()
    assert [r[0] for r in got] == ["aitmelloul", "aitmelloul2", "strasse", "fes", "", "", "wide", "izmir", "łodz", "ab"]
    assert [r[1] for r in got] == ["ait melloul", "ait-melloul 2", "strasse", "fes", "", "", "ｗide", "izmir", "łodz", "a\nb"]


def test_crowded_buckets_find_the_same_spellings(spark, cands):
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        base = rnd.choice(["Zuunmod", "Marrakesh", "Fes", "Reykjavik", "Aix"])
        name = list(base)
        for _ in range(rnd.randrange(3)):
            name[rnd.randrange(len(name))] = rnd.choice("abeköu")
        rows.append(dict(id=f"c{i:02d}", name="".join(name), lat=1.0, lon=1.0, population=rnd.randrange(5)))
    df = cands(*rows)
    few, many = resolve.merge_transliterations(df), resolve.merge_transliterations(df, bucket_pairs=3)
    key = lambda r: {(x.guest_id, x.host_id) for x in r.log.collect()}
    assert key(few) == key(many) and key(few)


def test_a_point_of_a_hundred_records_compares_pairs_and_opens_no_spellings(spark, cands, monkeypatch):
    rows = [dict(id=f"c{i:03d}", name=f"Plaza{i:07d}", lat=1.0, lon=1.0, population=i) for i in range(100)]
    want = {(r.strong_id, r.weak_id) for r in resolve.transliteration_pairs(cands(*rows), bucket_pairs=3).collect()}
    monkeypatch.setattr(resolve, "_spellings", None)  # up to 79 forms of each of these names
    assert {(r.strong_id, r.weak_id) for r in resolve.transliteration_pairs(cands(*rows)).collect()} == want and len(want) > 1000


@pytest.mark.parametrize("heads", [1_044_429, 698_310])
def test_a_suburb_folds_into_its_city(cands, heads):
    got = resolve.agglomerate(cands(dict(population=heads, **AGADIR), MELLOUL))
    assert ids(got.kept) == {"agadir"}
    assert got.kept.first().population == pytest.approx(heads + 187_652)


def test_comparable_cities_stay_apart(cands):
    got = resolve.agglomerate(cands(dict(id="rabat", country="Morocco", lat=34.0132, lon=-6.8326, population=500_000),
                                    dict(id="sale", country="Morocco", lat=34.0531, lon=-6.7985, population=400_000)))
    assert ids(got.kept) == {"rabat", "sale"}


def test_near_duplicates_need_a_kind_in_common(cands):
    same = resolve.absorb_near_duplicates(cands(dict(id="a", lat=10.0, lon=10.0, kinds={"A5": .9}), dict(id="b", lat=10.001, lon=10.001, kinds={"A5": .9})))
    assert len(ids(same.kept)) == 1 and same.log.first().decision == "absorbed"
    apart = cands(dict(id="town", lat=10.0, lon=10.0, kinds={"A12": .9}), dict(id="peak", lat=10.005, lon=10.0, kinds={"A4": .9}, is_site=True))
    kept = resolve.absorb_near_duplicates(apart).kept
    assert ids(kept) == {"town", "peak"}
    pairs = resolve.close_pairs(kept).collect()
    assert len(pairs) == 1 and not pairs[0].same_kind


def test_density_is_not_a_top_n(spark, cands):
    land = spark.createDataFrame([("G", 357_000.0)], "country string, area_km2 double")
    got = resolve.cap_density(cands(
        dict(id="h1", country="G", lat=50.0, lon=10.0, kinds={"A11": .9}, sources=["osm"], tiers={"osm_heritage": 20}),
        dict(id="h2", country="G", lat=50.08, lon=10.0, kinds={"A11": .9}, sources=["osm"], tiers={"osm_heritage": 18}),
        dict(id="pk", country="G", lat=51.5, lon=11.0, kinds={"A4": .9}, sources=["osm"], tiers={"osm_heritage": 1})), land)
    assert ids(got.kept) == {"h1", "pk"} and got.log.first().decision == "density"
    city = resolve.cap_density(cands(dict(population=698_310, kinds={"A3": .9, "A5": .6}, sources=["osm"], **AGADIR),
                                     dict(id="jerrar", country="Morocco", lat=30.2622, lon=-9.5038, population=12_000, kinds={"A3": .9, "A9": .68}, sources=["osm", "wdpa"])), land)
    assert ids(city.kept) == {"agadir", "jerrar"}


def test_a_divergent_site_is_retained_and_a_like_one_absorbed(cands):
    got = resolve.absorb_sites(cands(
        dict(id="t", name="Town", lat=1.0, lon=1.0, kinds={"A2": .9}, tiers={"market": 1}),
        dict(id="s1", name="Kasbah", lat=1.1, lon=1.0, is_site=True, kinds={"A2": .8}, tiers={"whs_cultural": 1}, population=5e6),
        dict(id="s2", name="Peak", lat=1.2, lon=1.0, is_site=True, kinds={"A4": .9}, landforms=["mountain"])))
    said = {r.guest_id: r.decision for r in got.log.collect()}
    assert said == {"s1": "absorbed", "s2": "retained"}
    host = got.kept.where(F.col("candidate_id") == "t").first()
    assert host.name == "Kasbah / Town" and host.lat == 1.1 and host.population == 0.0 and sum(host.tiers) == 2


def cloud(n, seed, spread=0.3):
    rnd = random.Random(seed)
    return [(f"n{i:03d}", i + 1, 10 + rnd.uniform(0, spread), 20 + rnd.uniform(0, spread), rnd.choice([0, 1, 2, 4, 3, 6])) for i in range(n)]


@pytest.mark.parametrize("rule,radius", [(folding.NEAREST, 8.0), (folding.FIRST, 10.0), (folding.KINDS, 4.0), (folding.KINDS, 1.5)])
def test_rounds_equal_the_ordered_walk(spark, rule, radius):
    rows = cloud(60, 11)
    lat, lon, mask = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
    free = np.array([rule == folding.KINDS or rule == folding.FIRST or i >= 6 for i in range(len(rows))])
    host, dist = ordered_walks.walk(lat, lon, np.full(len(rows), radius), free, mask, rule)
    want = {(rows[i][0], rows[host[i]][0], round(float(dist[i]), 6)) for i in range(len(rows)) if host[i] >= 0}
    df = spark.createDataFrame([(*r[:4], radius, bool(f), r[4], "g") for r, f in zip(rows, free)],
                               "id string, rank bigint, lat double, lon double, radius double, foldable boolean, mask int, grp string")
    for got in (folding.fold(df, ["grp"], rule), folding.fold(df, ["grp"], rule, crowd=5)):
        assert {(r.guest_id, r.host_id, round(r.km, 6)) for r in got.collect()} == want


@pytest.mark.parametrize("block", [2, 8])
def test_small_blocks_equal_the_ordered_walk(spark, monkeypatch, block):
    monkeypatch.setattr(folding, "BLOCK_RADII", block)
    rows = cloud(150, 12, 0.4)
    lat, lon, mask = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
    host, dist = ordered_walks.walk(lat, lon, np.full(len(rows), 2.0), np.full(len(rows), True), mask, folding.KINDS)
    want = {(rows[i][0], rows[host[i]][0], round(float(dist[i]), 6)) for i in range(len(rows)) if host[i] >= 0}
    df = spark.createDataFrame([(*r[:4], 2.0, True, r[4], "g") for r in rows],
                               "id string, rank bigint, lat double, lon double, radius double, foldable boolean, mask int, grp string")
    for crowd in (folding.CROWD, 5):
        got = folding.fold(df, ["grp"], folding.KINDS, crowd=crowd)
        assert {(r.guest_id, r.host_id, round(r.km, 6)) for r in got.collect()} == want and len(want) > 30


def test_a_long_chain_of_waits_takes_few_rounds(spark, monkeypatch):
    """Each row waits for the one before it along 270 km; of three in reach the middle one may lose its host to kinds."""
    rows = [(f"n{i:03d}", i + 1, 10 + i * 0.0135, 20.0, (1, 3, 2, 4)[i % 4]) for i in range(180)]
    lat, lon, mask = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
    host, _ = ordered_walks.walk(lat, lon, np.full(180, 2.0), np.full(180, True), mask, folding.KINDS)
    df = spark.createDataFrame([(*r[:4], 2.0, True, r[4], "g") for r in rows],
                               "id string, rank bigint, lat double, lon double, radius double, foldable boolean, mask int, grp string")
    cuts, plain = [], folding.cut
    monkeypatch.setattr(folding, "cut", lambda d: cuts.append(1) or plain(d))
    got = {(r.guest_id, r.host_id) for r in folding.fold(df, ["grp"], folding.KINDS).collect()}
    assert got == {(rows[i][0], rows[host[i]][0]) for i in range(180) if host[i] >= 0} and got
    assert len(cuts) < 20


def test_rows_that_teach_their_host_nothing_wait_for_nobody_farther(spark, monkeypatch):
    """Crowded points in small blocks: the walk needs few rounds, for most rows know their host before their neighbours have decided."""
    monkeypatch.setattr(folding, "BLOCK_RADII", 4)
    rnd, rows = random.Random(7), []
    for i in range(400):
        at = (10 + rnd.uniform(0, 0.25), 20 + rnd.uniform(0, 0.25))
        if rows and rnd.random() < 0.6:
            at = rnd.choice(rows)[2:4]
        rows.append((f"n{i:03d}", i + 1, *at, rnd.choice([1, 1, 1, 2, 3])))
    lat, lon, mask = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
    host, _ = ordered_walks.walk(lat, lon, np.full(400, 2.0), np.full(400, True), mask, folding.KINDS)
    df = spark.createDataFrame([(*r[:4], 2.0, True, r[4], "g") for r in rows],
                               "id string, rank bigint, lat double, lon double, radius double, foldable boolean, mask int, grp string")
    cuts, plain = [], folding.cut
    monkeypatch.setattr(folding, "cut", lambda d: cuts.append(1) or plain(d))
    got = {(r.guest_id, r.host_id) for r in folding.fold(df, ["grp"], folding.KINDS).collect()}
    assert got == {(rows[i][0], rows[host[i]][0]) for i in range(400) if host[i] >= 0} and len(got) > 300
    assert len(cuts) < 22


def test_city_growth_rounds_equal_the_ordered_walk(cands):
    rnd = random.Random(21)
    df = cands(*[dict(id=f"c{i:02d}", lat=10 + rnd.uniform(0, .6), lon=20 + rnd.uniform(0, .6), population=float(rnd.choice([0, 2e3, 4e4, 2e5, 7e5, 1.2e6])) * rnd.uniform(.5, 1),
                          sources=["wdpa"] if i % 9 == 0 else ["osm"]) for i in range(50)])
    rows = df.select("candidate_id", "lat", "lon", "population", resolve.harvest_only().alias("harvest")).toPandas()
    want = {(r.guest_id, r.host_id) for r in ordered_walks.grow_cities(rows, PARAMS.suburb_share).itertuples()}
    assert {(x.guest_id, x.host_id) for x in resolve.agglomerate(df).log.collect()} == want and len(want) > 5


def test_cities_that_cannot_grow_take_no_round(cands, monkeypatch):
    df = cands(*[dict(id=f"c{i:02d}", lat=10 + i * 0.02, lon=20.0, population=5e5 + i) for i in range(20)])
    joins = []
    plain = resolve.spatial.radius_join
    monkeypatch.setattr(resolve.spatial, "radius_join", lambda *a, **k: joins.append(1) or plain(*a, **k))
    assert resolve.agglomerate(df).log.count() == 0
    assert len(joins) == 3


def test_density_and_site_folds_equal_the_ordered_walk(spark, cands):
    rnd = random.Random(8)
    kinds = ["A3", "A4", "A11"]
    df = cands(*[dict(id=f"c{i:02d}", lat=10 + rnd.uniform(0, .5), lon=20 + rnd.uniform(0, .5), kinds={rnd.choice(kinds): .9, rnd.choice(kinds): .5},
                          is_site=i % 2 == 0, sources=["osm"], population=float(rnd.choice([0, 9e4]))) for i in range(40)])
    land = spark.createDataFrame([("X", 20_000.0)], "country string, area_km2 double")
    rows = resolve.density_rows(df, land).toPandas()
    want = {(r.guest_id, r.host_id) for _, part in rows.groupby("country") for r in ordered_walks.thin_country(part, PARAMS).itertuples()}
    assert {(x.guest_id, x.host_id) for x in resolve.cap_density(df, land).log.collect()} == want and want
    sites = {r.site_id: (r.host_id, r.absorbed) for r in resolve.site_decisions(df).collect()}
    vec = {r.candidate_id: list(r.kinds) for r in df.collect()}
    near = pd.DataFrame([(s, h, 0.0, vec[s], vec[h]) for s, (h, _) in sites.items()], columns=["site_id", "host_id", "km", "site_kinds", "host_kinds"])
    hand = pd.concat([ordered_walks.absorb_host(part, PARAMS.absorb_similarity, 0.8) for _, part in near.groupby("host_id")])
    assert {r.site_id: (r.host_id, r.absorbed) for r in hand.itertuples()} == sites and len(set(x for _, x in sites.values())) == 2


@pytest.mark.parametrize("rule", [folding.NEAREST, folding.KINDS])
def test_a_country_of_many_rows(spark, rule):
    """Thousands of rows in one group, a third of them crowded at one place."""
    rnd = random.Random(5)
    rows = [(f"n{i:05d}", i + 1, 10 + rnd.uniform(0, 3), 20 + rnd.uniform(0, 3), rnd.choice([1, 2, 4, 3, 6])) for i in range(4000)]
    rows += [(f"m{i:05d}", 4001 + i, 11 + rnd.uniform(0, .03), 21 + rnd.uniform(0, .03), rnd.choice([0, 1, 2, 4, 3, 6])) for i in range(2000)]
    lat, lon, mask = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
    free = np.array([rule == folding.KINDS or i >= 500 for i in range(len(rows))])
    host, _ = ordered_walks.walk(lat, lon, np.full(len(rows), 3.0), free, mask, rule)
    df = spark.createDataFrame([(*r[:4], 3.0, bool(f), r[4], "g") for r, f in zip(rows, free)],
                               "id string, rank bigint, lat double, lon double, radius double, foldable boolean, mask int, grp string")
    want = {(rows[i][0], rows[host[i]][0]) for i in range(len(rows)) if host[i] >= 0}
    assert {(r.guest_id, r.host_id) for r in folding.fold(df, ["grp"], rule).collect()} == want


@pytest.mark.parametrize("first_heads", [3, 4096])
def test_city_growth_by_slices_equals_the_ordered_walk_in_few_rounds(spark, monkeypatch, first_heads):
    """A row of towns, each larger than the next and in its widest circle: only those that could share guests wait for each other."""
    rnd = random.Random(5)
    towns = [(f"t{i:02d}", "g", 10 + i * 0.2, 20.0, 9e5 - i * 1e3, False) for i in range(10)]
    towns += [(f"v{i:03d}", "g", 10 + i % 10 * 0.2 + rnd.uniform(-.04, .04), 20 + rnd.uniform(-.02, .02), rnd.choice([0.0, 5e2, 3e3]), True) for i in range(50)]
    df = spark.createDataFrame(towns, "candidate_id string, country string, lat double, lon double, population double, harvest boolean")
    rounds, plain = [], resolve._rising
    monkeypatch.setattr(resolve, "_rising", lambda p, s, most: (rounds.append(1) if not most else None) or plain(p, s, most))
    want = {(r.guest_id, r.host_id) for r in ordered_walks.grow_cities(df.toPandas().drop(columns="country"), PARAMS.suburb_share).itertuples()}
    got = resolve._grow_cities(df, PARAMS.suburb_share, first_heads)
    assert {(x.guest_id, x.host_id) for x in got.collect()} == want and len(want) > 40
    assert first_heads < 4096 or len(rounds) < 4


@pytest.mark.parametrize("block", [8.0, 30.0])
def test_city_growth_by_small_blocks_equals_the_ordered_walk(spark, monkeypatch, block):
    monkeypatch.setattr(resolve, "GROWTH_BLOCK_KM", block)
    rnd = random.Random(17)
    towns = [(f"t{i:03d}", "g", 10 + rnd.uniform(0, 1.2), 20 + rnd.uniform(0, 1.2), round(rnd.choice([0, 2e3, 4e4, 2e5, 7e5, 1.2e6]) * rnd.uniform(.5, 1)), i % 9 != 0) for i in range(160)]
    df = spark.createDataFrame([(*t[:4], float(t[4]), t[5]) for t in towns], "candidate_id string, country string, lat double, lon double, population double, harvest boolean")
    want = {(r.guest_id, r.host_id) for r in ordered_walks.grow_cities(df.toPandas().drop(columns="country"), PARAMS.suburb_share).itertuples()}
    for first_heads in (20, 4096):
        got = resolve._grow_cities(df, PARAMS.suburb_share, first_heads)
        assert {(x.guest_id, x.host_id) for x in got.collect()} == want and len(want) > 40


def test_heads_in_a_long_row_take_few_rounds(spark, monkeypatch):
    """Each head shares a guest with the next along 400 km: a chain of waits that blocks walk in order."""
    towns = [(f"t{i:02d}", "g", 10 + i * 0.09, 20.0, 3e5 - i, False) for i in range(40)]
    towns += [(f"v{i:02d}", "g", 10.045 + i * 0.09, 20.0, 1e3 + i, True) for i in range(40)]
    df = spark.createDataFrame(towns, "candidate_id string, country string, lat double, lon double, population double, harvest boolean")
    want = {(r.guest_id, r.host_id) for r in ordered_walks.grow_cities(df.toPandas().drop(columns="country"), PARAMS.suburb_share).itertuples()}
    cuts, plain = [], resolve.cut
    monkeypatch.setattr(resolve, "cut", lambda d: cuts.append(1) or plain(d))
    assert {(x.guest_id, x.host_id) for x in resolve._grow_cities(df, PARAMS.suburb_share).collect()} == want and len(want) == 40
    assert len(cuts) < 50
