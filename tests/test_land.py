import hashlib
import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from placekit.operators import land

SQUARE = "poly_id string, grp string, rings array<array<struct<x:double,y:double>>>"


def ring(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def edges(spark, *polys):
    return land.edges(spark.createDataFrame([(p, g, list(r)) for p, g, *r in polys], SQUARE))


def points(spark, *rows):
    return spark.createDataFrame([(i, "X", float(lat), float(lon)) for i, lat, lon in rows], "point_id string, grp string, lat double, lon double")


def test_points_in_polygons_respect_holes_borders_and_country(spark):
    e = edges(spark, ("a", "X", ring(0, 0, 4, 4), ring(1, 1, 2, 2)), ("b", "X", ring(4, 0, 8, 4)), ("c", "Y", ring(0, 0, 9, 9)))
    got = {r.point_id: r.poly_id for r in land.locate(points(spark, ("in", .5, .5), ("hole", 1.5, 1.5), ("edge", 2, 4), ("out", 9, 9)), e).collect()}
    assert got == {"in": "a", "edge": "b"}
    near = {r.point_id: (r.poly_id, r.how) for r in land.assign_to_polygons(points(spark, ("in", .5, .5), ("far", 2, 11), ("close", 4.2, 1)), e, 50.0).collect()}
    assert near == {"in": ("a", "inside"), "close": ("a", "nearest")}
    assert land.nearest_polygon(points(spark, ("far", 2, 11)), e).first().poly_id == "b"


def test_cells_give_area_border_and_perimeter(spark):
    e = edges(spark, ("a", "X", ring(0, 0, 2, 1)), ("b", "X", ring(2, 0, 3, 1)))
    cells = land.rasterise(e, 0.25)
    m = {r.owner: (r.deg2, r.perimeter) for r in land.measures(cells, 0.25).collect()}
    assert m == {"a": (2.0, 6.0), "b": (1.0, 4.0)}
    assert [(r.a, r.b, r.shared) for r in land.borders(cells, 0.25).collect()] == [("a", "b", 1.0)]
    poly = {r.poly_id: r.km2 for r in land.km2(e).collect()}
    assert abs(poly["a"] / poly["b"] - 2) < 1e-9


def test_undersized_units_merge_and_never_cross_a_border(spark):
    units = spark.createDataFrame([("X", "a", 1, 4.0, 1), ("X", "b", 5, 4.0, 1), ("X", "c", 4, 4.0, 2), ("Y", "d", 1, 4.0, 1), ("X", "e", 0, 4.0, 0)],
                                  "grp string, unit string, n_places int, perimeter double, kmask int")
    border = spark.createDataFrame([("X", "a", "b", 1.0), ("X", "a", "c", 1.0)], "grp string, a string, b string, shared double")
    got = {r.unit: r.tile for r in land.merge_undersized(units, border).collect()}
    assert got["a"] == got["b"] and len({got[u] for u in "bcde"}) == 4


def test_small_tiles_merge_along_the_longest_border_and_islands_stay(spark):
    units = spark.createDataFrame([("X", "a", 0.5), ("X", "b", 5.0), ("X", "c", 5.0), ("X", "i", 0.1)], "grp string, unit string, deg2 double")
    border = spark.createDataFrame([("X", "a", "b", 1.0), ("X", "a", "c", 2.0)], "grp string, a string, b string, shared double")
    got = {r.unit: r.tile for r in land.merge_to_size(units, border, 2000.0).collect()}
    assert got["a"] == got["c"] and got["i"] == "i" and got["b"] == "b"


def test_regions_keep_empty_units_and_left_over_land(spark):
    cells = land.rasterise(edges(spark, ("u1", "X", ring(0, 0, 1, 1)), ("u2", "X", ring(1, 0, 2, 1)), ("w", "X", ring(2, 0, 3, 1))), 0.25)
    iso = spark.createDataFrame([("X", "XXX")], "grp string, iso3 string")
    out = land.regions(cells.where(F.col("owner") != "w"), cells, iso)
    assert {(r.region_id, r.unit): r["count"] for r in out.groupBy("region_id", "unit").count().collect()} == {
        ("XXX-R01", "u1"): 16, ("XXX-R02", "u2"): 16, ("XXX-R03", None): 16}
    gap = land.coverage_gap(cells, cells.where(F.col("owner") != "w"), 0.25, rings=0).first()
    assert abs(gap.gap - 1 / 3) < 1e-9 and not gap.ok


def test_disputed_labels_dissolve_and_places_keep_their_point(spark):
    p = spark.createDataFrame([("1", "Western Sahara", "ESH", 24.0), ("2", "Chile", "CHL", -30.0)], "place_id string, country string, iso3 string, lat double")
    got = {r.place_id: (r.country, r.iso3, r.disputed, r.lat) for r in land.flag_disputed(p).collect()}
    assert got == {"1": ("Morocco", "MAR", "ESH", 24.0), "2": ("Chile", "CHL", None, -30.0)}


CELLS = "owner string, grp string, gy long, gx long"


def test_parts_of_overlapping_owners_stay_apart(spark):
    rows = [("A", "X", 0, 0), ("A", "X", 0, 2), *[("B", "X", 0, x) for x in range(3)], ("A", "Y", 0, 1)]
    got = {}
    for r in land.parts(spark.createDataFrame(rows, CELLS)).collect():
        got.setdefault((r.owner, r.grp, r.part), set()).add(r.gx)
    assert sorted((o, g, sorted(x)) for (o, g, _), x in got.items()) == [("A", "X", [0]), ("A", "X", [2]), ("A", "Y", [1]), ("B", "X", [0, 1, 2])]


def test_nearest_cell_is_of_the_own_country(spark):
    cells = spark.createDataFrame([("g1", "G", 0, 5), ("h1", "H", 0, 5), ("h0", "H", 0, 90)], CELLS)
    places = spark.createDataFrame([("p", "H", 0.1, 0.1), ("q", "G", 0.1, 0.1), ("in", "H", 0.1, 1.3), ("none", "Z", 0.0, 0.0), ("far", "G", -60.0, 170.0)], "place_id string, grp string, lat double, lon double")
    got = {r.place_id: r.owner for r in land.place_in_cells(places, cells, 0.25, "owner").collect()}
    assert got == {"p": "h1", "q": "g1", "in": "h1", "far": "g1"}


def test_grown_land_goes_to_the_nearest_tile_of_its_country(spark):
    tiles = spark.createDataFrame([("g", "G", 0, 0), ("h", "H", 0, 9)], CELLS)
    pieces = spark.createDataFrame([("x", "G", 0, 8, "pg"), ("x", "H", 0, 2, "ph"), ("x", "G", 0, 1, "touch")], CELLS + ", piece string")
    assert {r.piece: r.owner for r in land._nearest_owner(pieces, tiles, 0.25).collect()} == {"pg": "g", "ph": "h", "touch": "g"}


def _merge_by_hand(units, border, weight, small, pick, join):
    """One merge at a time over the whole country: always the lightest small tile that touches another, of equal ones the first in the list."""
    tile = {u: dict(r) for u, r in units.items()}
    order = sorted(units, key=lambda u: hashlib.md5(u.encode()).hexdigest())
    beside = {u: {} for u in units}
    for (a, b), shared in border.items():
        beside[a][b] = beside[b][a] = shared
    heap = [(tile[u][weight], i, u) for i, u in enumerate(order) if small(tile[u][weight]) and beside[u]]
    heapq.heapify(heap)
    at, made = {u: i for i, u in enumerate(order)}, {u: [u] for u in units}
    while heap:
        w, i, u = heapq.heappop(heap)
        if u not in tile or tile[u][weight] != w or at[u] != i or not beside[u]:
            continue
        v = pick(tile, u, beside[u], at)
        keep, gone, new, last = join(tile, u, v, beside[u][v])
        tile[keep] |= new
        del tile[gone]
        made[keep] += made.pop(gone)
        at[keep] = next(_later) if last else at[v]
        for other, shared in beside.pop(gone).items():
            del beside[other][gone]
            if other != keep:
                beside[keep][other] = beside[other][keep] = beside[keep].get(other, 0.0) + shared
        if small(tile[keep][weight]):
            heapq.heappush(heap, (tile[keep][weight], at[keep], keep))
    return {u: t for t, us in made.items() for u in us}


_later = itertools.count(10**9)


def _longest(least):
    def pick(tile, u, beside, at):
        fit = [(s, at[v], v) for v, s in beside.items() if tile[v]["deg2"] + tile[u]["deg2"] <= 3 * least]
        return max(fit)[2] if fit else min((tile[v]["deg2"], at[v], v) for v in beside)[2]
    return pick


def _cheapest(tile, u, beside, at):
    def cost(v):
        a, b = tile[u], tile[v]
        x, y = a["kmask"], b["kmask"]
        alike = bin(x & y).count("1") / bin(x | y).count("1") if x and y else 0.0
        return max(0.0, a["perimeter"] + b["perimeter"] - 2 * beside[v] - max(a["perimeter"], b["perimeter"])) + 4.0 * (1.0 - alike)
    return min((cost(v), at[v], v) for v in beside)[2]


def _smaller_name(t, u, v, s):
    return min(u, v), max(u, v), {"n_places": t[u]["n_places"] + t[v]["n_places"], "perimeter": t[u]["perimeter"] + t[v]["perimeter"] - 2 * s, "kmask": t[u]["kmask"] | t[v]["kmask"]}, True


def _into_neighbour(t, u, v, s):
    return v, u, {"deg2": t[v]["deg2"] + t[u]["deg2"]}, False


UNITS = "grp string, unit string, n_places int, perimeter double, kmask int, deg2 double"


def _frames(spark, units, border):
    rows = spark.createDataFrame([("X", u, r["n_places"], r["perimeter"], r["kmask"], r["deg2"]) for u, r in units.items()], UNITS)
    return rows, spark.createDataFrame([("X", a, b, s) for (a, b), s in border.items()], "grp string, a string, b string, shared double")


@pytest.mark.parametrize("seed", [4, 5])
def test_merges_equal_one_merge_at_a_time(spark, seed):
    rng = random.Random(seed)
    n = 70
    units = {f"u{i:02d}": {"n_places": rng.choice([0, 0, 1, 1, 2, 4, 7]), "perimeter": rng.randrange(4, 40) / 4, "kmask": rng.randrange(0, 8), "deg2": rng.randrange(1, 32) / 16} for i in range(n)}
    names = sorted(units)
    border = {(names[i], names[j]): rng.randrange(1, 9) / 4 for i in range(n) for j in range(i + 1, n) if rng.random() < 0.04}
    rows, edge = _frames(spark, units, border)
    least = land.side_deg(1400.0) ** 2
    want = _merge_by_hand(units, border, "deg2", lambda a: a < least, _longest(least), _into_neighbour)
    assert {r.unit: r.tile for r in land.merge_to_size(rows, edge, 1400.0).collect()} == want
    want = _merge_by_hand(units, border, "n_places", lambda n: 0 < n < 3, _cheapest, _smaller_name)
    assert {r.unit: r.tile for r in land.merge_undersized(rows, edge).collect()} == want


def test_a_country_of_fifty_thousand_units(spark):
    """A grid of 250 by 200 units, most of them under size."""
    rng = random.Random(6)
    units = {f"{y:03d}-{x:03d}": {"n_places": 0, "perimeter": 1.0, "kmask": 0, "deg2": rng.randrange(1, 5000) / 1024} for y in range(250) for x in range(200)}
    border = {}
    for y in range(250):
        for x in range(200):
            for dy, dx in ((0, 1), (1, 0)):
                if y + dy < 250 and x + dx < 200:
                    border[f"{y:03d}-{x:03d}", f"{y + dy:03d}-{x + dx:03d}"] = rng.randrange(1, 64) / 64
    rows, edge = _frames(spark, units, border)
    least = land.side_deg(1400.0) ** 2
    got = {r.unit: r.tile for r in land.merge_to_size(rows, edge, 1400.0).collect()}
    assert got == _merge_by_hand(units, border, "deg2", lambda a: a < least, _longest(least), _into_neighbour)
    assert len(set(got.values())) < 40_000
