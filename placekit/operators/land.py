"""Land: polygons as edge rows, and set algebra on grid cells.

``polygon edges``: poly_id, grp, ring, seq, x0, y0, x1, y1 (degrees; grp is usually the country).
``cells``: owner, grp, gy, gx on a grid of ``q`` degrees; a cell belongs to a polygon when its
centre does. Areas, borders, unions and gaps of cells are joins and sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placekit.functions import geo, kinds, text
from placekit.functions.vocab import (
    ABSORB_KM2, CUT_MM, EARTH_KM, LEVEL_WIDTHS, MAX_GREY_KM2, MIN_GREY_KM2, REGION_TOLERANCE,
    SMALL_LAND_DEG2, SMALL_LAND_TOLERANCE, TILE_MAX_PLACES, TILE_MIN_PLACES,
)
from placekit.operators import graph, spatial
from placekit.operators.folding import roots
from placekit.operators.serve import cuttable
from placekit.plans.session import cut, is_empty

WORLD_KM = 20_040.0


# ------------------------------------------------------------------ polygons and edges
def edges(polys: DataFrame, rings: str = "rings") -> DataFrame:
    """Rows of (poly_id, grp, rings: array<array<struct<x,y>>>) to edges; open rings are closed."""
    ring = polys.select("poly_id", "grp", F.posexplode(rings).alias("ring", "_pts"))
    pts = F.when(F.get("_pts", F.lit(0)) == F.element_at("_pts", -1), F.col("_pts")).otherwise(
        F.concat(F.col("_pts"), F.slice("_pts", 1, 1)))
    ring = ring.withColumn("_pts", pts)
    seg = F.zip_with(F.slice("_pts", F.lit(1), F.size("_pts") - 1), F.slice("_pts", F.lit(2), F.size("_pts") - 1),
                     lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
    return ring.select("poly_id", "grp", "ring", F.posexplode(seg).alias("seq", "_s")).select("poly_id", "grp", "ring", "seq", "_s.*")


def rect_edges(rects: DataFrame, poly: str, grp: str) -> DataFrame:
    """Axis-parallel rectangles (x0, y0, x1, y1) as edges."""
    d = {c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")}

    def p(x, y):
        return F.struct(d[x].alias("x"), d[y].alias("y"))

    ring = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0"))
    return edges(rects.select(F.col(poly).alias("poly_id"), F.col(grp).alias("grp"), F.array(ring).alias("rings")))


def boxes(edge_rows: DataFrame) -> DataFrame:
    """Bounding box per polygon."""
    return edge_rows.groupBy("poly_id", "grp").agg(
        F.min(F.least("x0", "x1")).alias("bx0"), F.min(F.least("y0", "y1")).alias("by0"),
        F.max(F.greatest("x0", "x1")).alias("bx1"), F.max(F.greatest("y0", "y1")).alias("by1"))


def km2(edge_rows: DataFrame) -> DataFrame:
    """Spherical area per polygon (G16): rings after the first are holes."""
    lat0, lat1 = F.radians("y0"), F.radians("y1")
    part = F.radians(F.col("x1") - F.col("x0")) * (2 + F.sin(lat0) + F.sin(lat1)) * EARTH_KM * EARTH_KM / 2
    ring = edge_rows.groupBy("poly_id", "grp", "ring").agg(F.abs(F.sum(part)).alias("a"))
    signed = F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))
    return ring.groupBy("poly_id", "grp").agg(F.abs(F.sum(signed)).alias("km2"))


def quantise(edge_rows: DataFrame, q: float = 0.005, digits: int = 3) -> DataFrame:
    """Snap vertices to a grid and drop edges that collapse."""
    def snap(c: str) -> Column:
        return F.bround(F.rint(F.col(c) / q) * q, digits).alias(c)

    out = edge_rows.select("poly_id", "grp", "ring", "seq", *[snap(c) for c in ("x0", "y0", "x1", "y1")])
    return out.where((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))


def contains(points: DataFrame, edge_rows: DataFrame, band: float = 1.0) -> DataFrame:
    """All (point_id, poly_id) with the point inside the polygon, same grp.

    Boxes propose on grid cells; the crossing count over the edges of one latitude band
    decides. Holes count as edges; left and lower borders are inside, right and upper are not.
    """
    box = boxes(edge_rows)
    cell = (box.withColumn("cy", F.explode(F.sequence(F.floor(F.col("by0") / band), F.floor(F.col("by1") / band))))
            .withColumn("cx", F.explode(F.sequence(F.floor(F.col("bx0") / band), F.floor(F.col("bx1") / band)))))
    pts = points.select("point_id", "grp", "lat", "lon", F.floor(F.col("lat") / band).alias("cy"), F.floor(F.col("lon") / band).alias("cx"))
    maybe = pts.join(cell, ["grp", "cy", "cx"]).where(
        F.col("lon").between(F.col("bx0"), F.col("bx1")) & F.col("lat").between(F.col("by0"), F.col("by1")))
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    banded = edge_rows.where(F.col("y0") != F.col("y1")).withColumn("cy", F.explode(F.sequence(F.floor(low / band), F.floor(high / band))))
    crossing = maybe.select("point_id", "poly_id", "grp", "lat", "lon", "cy").join(
        banded.select("poly_id", "grp", "cy", "x0", "y0", "x1", "y1"), ["poly_id", "grp", "cy"])
    x_at = F.col("x0") + (F.col("lat") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    hit = (F.col("lat") >= F.least("y0", "y1")) & (F.col("lat") < F.greatest("y0", "y1")) & (F.col("lon") < x_at)
    return (crossing.where(hit).groupBy("point_id", "poly_id").agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") % 2 == 1).select("point_id", "poly_id"))


def locate(points: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """First polygon (by id) containing each point (J11): point_id, poly_id."""
    return contains(points, edge_rows).groupBy("point_id").agg(F.min("poly_id").alias("poly_id"))


def _segment_degrees() -> Column:
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (
        (F.col("lon") - F.col("x0")) * dx + (F.col("lat") - F.col("y0")) * dy) / len2))).otherwise(0.0)
    ex, ey = F.col("lon") - (F.col("x0") + t * dx), F.col("lat") - (F.col("y0") + t * dy)
    return geo.tick(F.sqrt(ex * ex + ey * ey)), F.col("x0") + t * dx, F.col("y0") + t * dy


def nearest_polygon(points: DataFrame, edge_rows: DataFrame, cap_km: float | None = None) -> DataFrame:
    """Nearest polygon outline in the same grp for points inside none (J12): point_id, poly_id, deg, km.

    The search square doubles until a hit inside it is certain, so only edges near a point are
    looked at. ``cap_km`` drops answers farther than that.
    """
    todo, out = cut(points.select("point_id", "grp", "lat", "lon")), None
    todo = cut(todo.join(edge_rows.select("grp").distinct(), "grp", "left_semi"))
    reach = 0.25
    while not is_empty(todo):
        lo_x, hi_x = F.least("x0", "x1"), F.greatest("x0", "x1")
        lo_y, hi_y = F.least("y0", "y1"), F.greatest("y0", "y1")
        near = (edge_rows.withColumn("cy", F.explode(F.sequence(F.floor(lo_y / reach), F.floor(hi_y / reach))))
                .withColumn("cx", F.explode(F.sequence(F.floor(lo_x / reach), F.floor(hi_x / reach)))))
        probe = (todo.withColumn("cy", F.explode(F.sequence(F.floor(F.col("lat") / reach) - 1, F.floor(F.col("lat") / reach) + 1)))
                 .withColumn("cx", F.explode(F.sequence(F.floor(F.col("lon") / reach) - 1, F.floor(F.col("lon") / reach) + 1))))
        deg, px, py = _segment_degrees()
        pairs = probe.join(near, ["grp", "cy", "cx"]).select(
            "point_id", "poly_id", deg.alias("deg"), geo.haversine(F.col("lat"), F.col("lon"), py, px).alias("km"))
        best = pairs.where(F.col("deg") <= reach).groupBy("point_id").agg(F.min(F.struct("deg", "poly_id", "km")).alias("_b"))
        got = cut(best.select("point_id", "_b.poly_id", "_b.deg", "_b.km"))
        out = got if out is None else out.unionByName(got)
        todo = cut(todo.join(got.select("point_id"), "point_id", "left_anti"))
        reach *= 2
        if reach > 1024:
            break
    if out is None:
        return points.select("point_id", F.lit(None).cast("string").alias("poly_id"), F.lit(0.0).alias("deg"), F.lit(0.0).alias("km")).limit(0)
    return out if cap_km is None else out.where(F.col("km") <= cap_km)


def assign_to_polygons(points: DataFrame, edge_rows: DataFrame, cap_km: float | None = None) -> DataFrame:
    """Containing polygon, else the nearest in the same grp (J11 then J12): point_id, poly_id, how."""
    points = cut(points.select("point_id", "grp", "lat", "lon"))
    inside = cut(locate(points, edge_rows))
    left = points.join(inside, "point_id", "left_anti")
    near = nearest_polygon(left, edge_rows, cap_km)
    return inside.withColumn("how", F.lit("inside")).unionByName(near.select("point_id", "poly_id", F.lit("nearest").alias("how")))


# ------------------------------------------------------------------ cells
def rasterise(edge_rows: DataFrame, q: float) -> DataFrame:
    """Cells whose centre lies in each polygon, by scanline: owner, grp, gy, gx."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.ceil(low / q - 0.5), F.ceil(high / q - 0.5) - 1
    rows = edge_rows.where(first <= last).withColumn("gy", F.explode(F.sequence(first, last)))
    yc = (F.col("gy") + 0.5) * q
    x = F.col("x0") + (yc - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    # the crossings of one polygon on one row of cells
    row = rows.withColumn("_x", x).groupBy("poly_id", "grp", "gy").agg(F.array_sort(F.collect_list("_x")).alias("_xs"))
    spans = F.transform(F.expr("sequence(0, cast(size(_xs) div 2 as int) - 1)"), lambda i: F.struct(
        F.ceil(F.get("_xs", 2 * i) / q - 0.5).alias("a"),
        (F.ceil(F.get("_xs", 2 * i + 1) / q - 0.5) - 1).alias("b")))
    spans = F.filter(spans, lambda s: s["a"] <= s["b"])
    return (row.where(F.size("_xs") >= 2).withColumn("_s", F.explode(spans))
            .select(F.col("poly_id").alias("owner"), "grp", "gy", F.explode(F.sequence(F.col("_s.a"), F.col("_s.b"))).alias("gx")))


def cell_km2(q: float) -> Column:
    """Spherical area of a cell."""
    y0, y1 = F.radians(F.col("gy") * q), F.radians((F.col("gy") + 1) * q)
    return EARTH_KM * EARTH_KM * math.radians(q) * (F.sin(y1) - F.sin(y0))


def cell_id() -> Column:
    return (F.col("gy") + (1 << 20)) * (1 << 22) + F.col("gx") + (1 << 21)


def cell_of_point(q: float) -> tuple[Column, Column]:
    return F.floor(F.col("lat") / q).alias("gy"), F.floor(F.col("lon") / q).alias("gx")


def _neighbours(cells: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Each cell with its right and upper neighbour of ``other``: columns of both, other's as n_*."""
    n = other.select(F.col("gy").alias("_ny"), F.col("gx").alias("_nx"), F.col("grp"), F.col(key).alias(f"n_{key}"))
    step = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0))])
    probe = cells.withColumn("_d", F.explode(step)).withColumn("_ny", F.col("gy") + F.col("_d.dy")).withColumn("_nx", F.col("gx") + F.col("_d.dx"))
    return probe.drop("_d").join(n, ["grp", "_ny", "_nx"]).drop("_ny", "_nx")


def borders(cells: DataFrame, q: float) -> DataFrame:
    """Shared border length in degrees of each pair of owners of one grp (J20): grp, a, b, shared."""
    pairs = _neighbours(cells, cells, "owner").where(F.col("owner") != F.col("n_owner"))
    return (pairs.groupBy("grp", F.least("owner", "n_owner").alias("a"), F.greatest("owner", "n_owner").alias("b"))
            .agg((F.count(F.lit(1)) * q).alias("shared")))


def measures(cells: DataFrame, q: float) -> DataFrame:
    """Per owner: cells, square degrees, square km, perimeter in degrees, box."""
    inner = (_neighbours(cells, cells, "owner").where(F.col("owner") == F.col("n_owner"))
             .groupBy("owner", "grp").agg(F.count(F.lit(1)).alias("_in")))
    size = cells.groupBy("owner", "grp").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum(cell_km2(q)).alias("km2"),
        F.min("gx").alias("_x0"), F.min("gy").alias("_y0"), F.max("gx").alias("_x1"), F.max("gy").alias("_y1"),
        F.avg("gx").alias("_cx"), F.avg("gy").alias("_cy"))
    out = size.join(inner, ["owner", "grp"], "left")
    return out.select("owner", "grp", "n_cells", "km2", (F.col("n_cells") * q * q).alias("deg2"),
                      ((4 * F.col("n_cells") - 2 * F.coalesce("_in", F.lit(0))) * q).alias("perimeter"),
                      (F.col("_x0") * q).alias("x0"), (F.col("_y0") * q).alias("y0"),
                      ((F.col("_x1") + 1) * q).alias("x1"), ((F.col("_y1") + 1) * q).alias("y1"),
                      ((F.col("_cx") + 0.5) * q).alias("cx"), ((F.col("_cy") + 0.5) * q).alias("cy"))


def parts(cells: DataFrame) -> DataFrame:
    """Connected parts of each (owner, grp): cells with ``part`` (smallest cell id of the part).

    A cell may have several owners, in several groups: each is a node of its own.
    """
    rows = cut(cells.withColumn("cid", cell_id()))
    node = F.struct("grp", "owner", "cid")
    links = _neighbours(rows.withColumn("_a", node), rows.withColumn("_b", node), "_b")
    links = links.where(F.col("owner") == F.col("n__b.owner")).select(F.col("_a").alias("a"), F.col("n__b").alias("b"))
    alone = rows.select(node.alias("a"), node.alias("b"))
    label = graph.components(links.unionByName(alone)).select("node.*", F.col("label.cid").alias("part"))
    return rows.join(label, ["grp", "owner", "cid"]).drop("cid")


def disjoint(cells: DataFrame, priority: list) -> DataFrame:
    """One owner per cell where tiles overlap (W09, G13): the first by ``priority``, then owner."""
    rest = [c for c in cells.columns if c not in ("gy", "gx")]
    order = W.partitionBy("gy", "gx").orderBy(*priority, "owner")
    return cells.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).select("gy", "gx", *rest)


def dilate(cells: DataFrame, rings: int) -> DataFrame:
    """Cells grown by ``rings`` cells in every direction."""
    if rings <= 0:
        return cells.select("grp", "gy", "gx").distinct()
    grown = cells.select("grp", F.explode(F.sequence(F.col("gy") - rings, F.col("gy") + rings)).alias("gy"), "gx")
    return grown.select("grp", "gy", F.explode(F.sequence(F.col("gx") - rings, F.col("gx") + rings)).alias("gx")).distinct()


def coverage_gap(land: DataFrame, regions: DataFrame, q: float, rings: int = 1) -> DataFrame:
    """Share of each country's land outside the widened union of its regions (G15): grp, gap, ok.

    Small countries get the wider tolerance because their outline is coarser.
    """
    bare = land.select("grp", "gy", "gx").join(dilate(regions, rings), ["grp", "gy", "gx"], "left_anti")
    miss = bare.groupBy("grp").agg(F.count(F.lit(1)).alias("_bare"))
    out = land.groupBy("grp").agg(F.count(F.lit(1)).alias("cells")).join(miss, "grp", "left")
    gap = F.coalesce("_bare", F.lit(0)) / F.col("cells")
    tol = F.when(F.col("cells") * q * q < SMALL_LAND_DEG2, SMALL_LAND_TOLERANCE).otherwise(REGION_TOLERANCE)
    return out.select("grp", "cells", gap.alias("gap"), (gap <= tol).alias("ok"))


def padded_boxes(places: DataFrame, key: str, pad: float = 0.15, lone_pad: float = 0.3) -> DataFrame:
    """A padded box around the places of a group with no outline of its own."""
    box = places.groupBy(key).agg(F.min("lon").alias("x0"), F.min("lat").alias("y0"), F.max("lon").alias("x1"), F.max("lat").alias("y1"))
    flat = (F.col("x0") == F.col("x1")) | (F.col("y0") == F.col("y1"))
    p = F.when(flat, lone_pad).otherwise(pad)
    return box.select(key, (F.col("x0") - p).alias("x0"), (F.col("y0") - p).alias("y0"), (F.col("x1") + p).alias("x1"), (F.col("y1") + p).alias("y1"))


# ------------------------------------------------------------------ naming
def name_pieces(cells: DataFrame, admin: DataFrame, names: DataFrame, towns: DataFrame, countries: DataFrame, q: float) -> DataFrame:
    """Name each owner from where it lies (J21): owner, name.

    The admin unit under its centre, else its largest settlement, else a compass word.
    ``names``: owner (admin unit), name. ``towns``: name, lat, lon, population.
    ``countries``: grp, country. ``admin``: cells of admin units.
    """
    m = measures(cells, q)
    at = m.select("owner", "grp", F.floor(F.col("cy") / q).alias("gy"), F.floor(F.col("cx") / q).alias("gx"), "cx", "cy")
    unit = at.join(admin.select("grp", "gy", "gx", F.col("owner").alias("unit")), ["grp", "gy", "gx"]).join(
        names.select(F.col("owner").alias("unit"), F.col("name").alias("unit_name")), "unit")
    unit = unit.groupBy("owner").agg(F.min("unit_name").alias("unit_name"))
    ty, tx = cell_of_point(q)
    inside = towns.select("name", "population", ty, tx).join(cells.select("owner", "gy", "gx"), ["gy", "gx"])
    town = inside.groupBy("owner").agg(F.min(F.struct((-F.col("population")).alias("neg"), "name")).alias("_t")).select(
        "owner", F.col("_t.name").alias("town"))
    centre = cells.groupBy("grp").agg(((F.avg("gx") + 0.5) * q).alias("ccx"), ((F.avg("gy") + 0.5) * q).alias("ccy"))
    out = at.join(unit, "owner", "left").join(town, "owner", "left").join(centre, "grp").join(countries.select("grp", "country"), "grp", "left")
    wind = geo.compass(F.col("cx") - F.col("ccx"), F.col("cy") - F.col("ccy"), F.coalesce("country", "grp"))
    return out.select("owner", F.coalesce("unit_name", "town", wind).alias("name"))


# ------------------------------------------------------------------ regions
def regions(admin: DataFrame, land: DataFrame, iso3: DataFrame) -> DataFrame:
    """Tessellate each country's land (G11): cells with region_id, unit (null for left-over land).

    Admin units are clipped to land; left-over parts of at least the tolerance become regions
    of their own; empty regions stay. Countries without a land outline keep their units; land
    without units is one region. ``iso3``: grp, iso3.
    """
    has_land = land.select("grp").distinct()
    clipped = admin.join(land.select("grp", "gy", "gx"), ["grp", "gy", "gx"], "left_semi")
    clipped = clipped.unionByName(admin.join(has_land, "grp", "left_anti"))
    clipped = cut(clipped.select("grp", "gy", "gx", F.col("owner").alias("unit")))
    rest = land.join(clipped.select("grp", "gy", "gx"), ["grp", "gy", "gx"], "left_anti").select(
        "grp", "gy", "gx", F.lit("rest").alias("owner"))
    whole = land.groupBy("grp").agg(F.count(F.lit(1)).alias("_land"))
    bare = rest.groupBy("grp").agg(F.count(F.lit(1)).alias("_bare")).join(whole, "grp")
    worth = bare.where(F.col("_bare") >= REGION_TOLERANCE * F.col("_land"))
    loose = cut(parts(rest.join(worth.select("grp", "_land"), "grp")))
    sized = loose.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("_n"), F.first("_land").alias("_land"))
    keep = sized.where(F.col("_n") >= REGION_TOLERANCE * F.col("_land")).select("grp", "part")
    pieces = clipped.withColumn("part", F.lit(None).cast("bigint")).unionByName(
        loose.join(keep, ["grp", "part"], "left_semi").select("grp", "gy", "gx", F.lit(None).cast("string").alias("unit"), "part"))
    pieces = cut(pieces)
    heads = pieces.select("grp", "unit", "part").distinct()
    order = W.partitionBy("grp").orderBy(F.col("unit").asc_nulls_last(), "part")  # pieces of land, not data rows
    ids = heads.join(iso3, "grp").withColumn("region_id", geo.iso3_id(F.col("iso3"), "R", F.row_number().over(order)))
    return (pieces.withColumn("_k", F.coalesce("unit", F.col("part").cast("string")))
            .join(ids.select("grp", F.coalesce("unit", F.col("part").cast("string")).alias("_k"), "region_id"), ["grp", "_k"]).drop("_k"))


def _nearest_cells(points: DataFrame, cells: DataFrame, q: float, key: str, own: str) -> DataFrame:
    """For each point the ``own`` of the nearest cell of its grp: key, own, km.

    The radius starts at a few cells and grows for the points that have found none, so a point meets few cells.
    """
    centre = cells.select("grp", F.struct(cell_id().alias("cid"), own).alias("cell"), ((F.col("gy") + 0.5) * q).alias("r_lat"), ((F.col("gx") + 0.5) * q).alias("r_lon"))
    todo = cut(points.join(cells.select("grp").distinct(), "grp", "left_semi"))
    out, km = None, 111.32 * q * 4
    while not is_empty(todo):
        near = cut(spatial.nearest(todo, centre, km, key, "cell", ["grp"]).select(key, F.col(f"cell.{own}").alias(own), "km"))
        out = near if out is None else out.unionByName(near)
        if km >= WORLD_KM:
            break
        todo, km = cut(todo.join(near.select(key), key, "left_anti")), min(km * 4, WORLD_KM)
    return out if out is not None else points.select(key, F.lit(None).cast("string").alias(own), F.lit(0.0).alias("km")).limit(0)


def place_in_cells(places: DataFrame, cells: DataFrame, q: float, id_col: str) -> DataFrame:
    """Owner cell of each place, else the nearest cell of its country: place_id, <id_col>."""
    y, x = cell_of_point(q)
    at = places.select("place_id", "grp", "lat", "lon", y, x)
    own = cut(at.join(cells.select("grp", "gy", "gx", id_col), ["grp", "gy", "gx"], "left"))
    found = own.where(F.col(id_col).isNotNull()).groupBy("place_id").agg(F.min(id_col).alias(id_col))
    lost = own.where(F.col(id_col).isNull()).select("place_id", "grp", "lat", "lon")
    return found.unionByName(_nearest_cells(lost, cells, q, "place_id", id_col).select("place_id", id_col))


# ------------------------------------------------------------------ merging tiles
def split_oversized(units: DataFrame, children: DataFrame) -> DataFrame:
    """Units holding more than six places give way to their children.

    ``units`` and ``children``: unit, grp, n_places, ...; ``children`` also names its parent.
    """
    big = units.where(F.col("n_places") > TILE_MAX_PLACES).select("unit").join(
        children.select(F.col("parent").alias("unit")).distinct(), "unit", "left_semi")
    kids = children.join(big.withColumnRenamed("unit", "parent"), "parent", "left_semi").drop("parent")
    return units.join(big, "unit", "left_anti").unionByName(kids, allowMissingColumns=True)


def _contract(tiles: DataFrame, border: DataFrame, small, best, become, in_turn: bool = False) -> DataFrame:
    """Merge every small tile that touches another, lightest first, until none is left: grp, unit, tile.

    ``tiles``: grp, unit, weight, pos and what ``best`` and ``become`` read; equal weights go by ``pos``. ``small`` tells a weight
    that must merge, ``best`` orders the neighbours of a tile (its columns in u, theirs in v), ``become`` makes the
    columns of the merged tile. A tile alone is set aside.

    The outcome is that of one merge at a time, found in rounds over all countries: a merge reads its neighbours and
    changes them and what touches them, so a tile that is the lightest of all small ones within two borders can go at
    once. What others become meanwhile is heavier than a tile within two borders and so no lighter than this one. Where
    neighbours may weigh nothing that doesn't hold; then (``in_turn``) only tiles of the lightest weight of a country go that
    were merged least often.
    """
    extra = [c for c in tiles.columns if c not in ("grp", "unit")]
    state = F.struct(*extra)
    key = lambda t: F.when(small(t["weight"]), F.struct(t["weight"].alias("weight"), t["pos"].alias("pos")))
    sides = border.select("grp", "a", "b", "shared").unionByName(border.select("grp", F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    one, two = tiles.select("grp", F.col("unit").alias("a"), state.alias("u")), tiles.select("grp", F.col("unit").alias("b"), state.alias("v"))
    # a border matters while one of its sides must merge, or weighs nothing and so may become part of one that must
    matters = lambda t: small(t["weight"]) | (t["weight"] <= 0)
    edges = cut(sides.join(one, ["grp", "a"]).join(two, ["grp", "b"]).where(matters(F.col("u")) | matters(F.col("v"))))
    gone = None
    while True:
        open_ = edges.where(small(F.col("u.weight")))
        if is_empty(open_):
            break
        near = edges.groupBy("grp", "a").agg(F.least(F.first(key(F.col("u"))), F.min(key(F.col("v")))).alias("near"))
        around = open_.join(near.withColumnRenamed("a", "b"), ["grp", "b"]).groupBy("grp", "a").agg(
            F.first(key(F.col("u"))).alias("own"), F.min("near").alias("least"))
        ready = around.where(F.col("own") == F.col("least"))
        if in_turn:
            # a position ends in a digest; what is before it tells how often, and at what weights, the tile was merged
            batch = lambda t: F.struct(t["weight"], F.substring(t["pos"], F.lit(1), F.length(t["pos"]) - 32))
            turn = open_.groupBy("grp").agg(F.min(batch(F.col("u"))).alias("_turn"))
            ready = ready.join(turn, "grp").where(batch(F.col("own")) == F.col("_turn"))
        ready = ready.select("grp", "a")
        pick = open_.join(ready, ["grp", "a"]).groupBy("grp", "a").agg(F.min_by(F.struct("b", "shared", "u", "v"), best).alias("p"))
        pairs = pick.select("grp", F.col("a").alias("u_id"), F.col("p.b").alias("v_id"), F.col("p.shared").alias("shared"), F.col("p.u").alias("u"), F.col("p.v").alias("v"))
        merged = become()
        pairs = cut(pairs.select("grp", "u_id", "v_id", merged["unit"].alias("keep"), F.struct(*[merged[c].cast(tiles.schema[c].dataType).alias(c) for c in extra]).alias("now")))
        lost = pairs.select("grp", F.when(F.col("keep") == F.col("u_id"), F.col("v_id")).otherwise(F.col("u_id")).alias("unit"), F.col("keep").alias("tile"))
        gone = lost if gone is None else gone.unionByName(lost)
        new = pairs.select("grp", F.explode(F.array("u_id", "v_id")).alias("old"), "keep", "now")
        for side, was in (("a", "u"), ("b", "v")):
            edges = edges.join(new.select("grp", F.col("old").alias(side), F.col("keep").alias("_keep"), F.col("now").alias("_now")), ["grp", side], "left").withColumns(
                {side: F.coalesce("_keep", side), was: F.coalesce("_now", was)}).drop("_keep", "_now")
        edges = cut(edges.where((F.col("a") != F.col("b")) & (matters(F.col("u")) | matters(F.col("v"))))
                    .groupBy("grp", "a", "b").agg(F.sum("shared").alias("shared"), F.first("u").alias("u"), F.first("v").alias("v")))
    if gone is None:
        return tiles.select("grp", "unit", F.col("unit").alias("tile"))
    link = gone.select(F.struct("grp", "unit").alias("guest_id"), F.struct("grp", F.col("tile").alias("unit")).alias("host_id"))
    last = roots(link).select("guest_id.*", F.col("root_id.unit").alias("tile"))
    return tiles.select("grp", "unit").join(last, ["grp", "unit"], "left").select("grp", "unit", F.coalesce("tile", "unit").alias("tile"))


def _joined() -> Column:
    """Outline of tiles u and v together."""
    return F.col("u.perimeter") + F.col("v.perimeter") - 2 * F.col("shared")


def merge_undersized(units: DataFrame, border: DataFrame) -> DataFrame:
    """Merge units of one or two places with their cheapest neighbour (G09): grp, unit, tile.

    ``units``: grp, unit, n_places, perimeter, kmask. Cost is added outline plus four times the share of kinds not held in
    common. Fewest places first; equal ones in the order of their ids' digests, and what merging made after those. A
    tile is named for the smaller id, never crosses a border, and stays when it has no neighbour.
    """
    x, y = F.col("u.kmask"), F.col("v.kmask")
    common = F.when((x != 0) & (y != 0), F.bit_count(x.bitwiseAND(y)) / F.bit_count(x.bitwiseOR(y))).otherwise(0.0)
    longer = _joined() - F.greatest("u.perimeter", "v.perimeter")
    price = F.greatest(F.lit(0.0), longer) + 4.0 * (1.0 - common)
    tiles = units.select("grp", "unit", F.col("n_places").cast("long").alias("weight"), F.concat(F.lit("0"), F.md5("unit")).alias("pos"), F.col("perimeter").cast("double"), F.col("kmask").cast("long"))
    # a tile that merging made comes after all it was made beside, in the order of the merges
    become = lambda: {"unit": F.least("u_id", "v_id"), "weight": F.col("u.weight") + F.col("v.weight"),
                      "pos": F.concat(F.lit("1"), F.col("u.weight").cast("string"), F.col("u.pos")), "perimeter": _joined(), "kmask": x.bitwiseOR(y)}
    return _contract(tiles, border, lambda w: (w > 0) & (w < TILE_MIN_PLACES), F.struct(price, "v.pos"), become, in_turn=True)


def side_deg(width_mm: float) -> float:
    """Degrees that print as the smallest cuttable side."""
    return CUT_MM / (width_mm / 360.0)


def merge_to_size(units: DataFrame, border: DataFrame, width_mm: float, cap_times: float = 3.0) -> DataFrame:
    """Merge the smallest tile into its longest-border neighbour until all can be cut (G10): grp, unit, tile.

    ``units``: grp, unit, deg2 (above 0). Of the neighbours that stay within ``cap_times`` the least size, the one with the
    longest border takes it; where none does, the smallest. Equal ones go by their ids' digests. A tile keeps the id of
    what took in the rest.
    """
    least = side_deg(width_mm) ** 2
    fits = F.col("u.weight") + F.col("v.weight") <= least * cap_times
    # later digests first among equal borders, earlier ones among equal sizes
    best = F.struct(F.when(fits, 0).otherwise(1), F.when(fits, -F.col("shared")).otherwise(F.col("v.weight")),
                    F.when(fits, F.translate("v.pos", "0123456789abcdef", "fedcba9876543210")).otherwise(F.col("v.pos")))
    tiles = units.select("grp", "unit", F.col("deg2").cast("double").alias("weight"), F.md5("unit").alias("pos"))
    become = lambda: {"unit": F.col("v_id"), "weight": F.col("v.weight") + F.col("u.weight"), "pos": F.col("v.pos")}
    return _contract(tiles, border, lambda w: w < least, best, become)


def nest_levels(cells: DataFrame, base: DataFrame, q: float, widths=LEVEL_WIDTHS) -> DataFrame:
    """Nested cut levels (G10): one row per base tile with the tile it belongs to at each width.

    ``base``: owner, app_places. A level's tile is named for its member with most places.
    """
    level = cut(base.select("owner", "app_places").join(cells.select("owner", "grp").distinct(), "owner")
                .withColumn("L0", F.col("owner")))
    current = "L0"
    for w in widths:
        named = cut(cells.join(level.select("owner", F.col(current).alias("_t")), "owner").select("grp", "gy", "gx", F.col("_t").alias("owner")))
        size = measures(named, q).select("grp", F.col("owner").alias("unit"), "deg2")
        merged = cut(merge_to_size(size, borders(named, q), w))
        weight = level.groupBy(F.col(current).alias("unit")).agg(F.sum("app_places").alias("_p")).join(size.select("unit", "deg2"), "unit")
        best = merged.join(weight, "unit").groupBy("grp", "tile").agg(F.max(F.struct("_p", "deg2", "unit")).alias("_b"))
        head = merged.join(best, ["grp", "tile"]).select(F.col("unit").alias(current), F.col("_b.unit").alias(f"w{w}"))
        level = cut(level.join(head, current))
        current = f"w{w}"
    return level


def level_report(cells: DataFrame, levels: DataFrame, q: float) -> DataFrame:
    """Tiles per level and how many are too small at each width."""
    out = None
    for name in ["L0", *[f"w{w}" for w in LEVEL_WIDTHS]]:
        size = (cells.join(levels.select("owner", F.col(name).alias("_t")), "owner").groupBy("_t").agg(
            (F.count(F.lit(1)) * q * q).alias("deg2")))
        side = F.sqrt("deg2")
        row = size.agg(F.count(F.lit(1)).alias("tiles"), *[F.count(F.when(side * (w / 360.0) < CUT_MM, 1)).alias(f"under_{w}") for w in LEVEL_WIDTHS])
        row = row.withColumn("level", F.lit(name)).withColumn("for_map_mm", F.lit(None if name == "L0" else int(name[1:])).cast("int"))
        out = row if out is None else out.unionByName(row)
    return out


# ------------------------------------------------------------------ growing tiles
def _touching(pieces: DataFrame, tiles: DataFrame) -> DataFrame:
    """For pieces beside a tile: the smallest touching tile id."""
    one = _neighbours(pieces.select("grp", "gy", "gx", "piece"), tiles, "owner").select("piece", F.col("n_owner").alias("owner"))
    two = _neighbours(tiles.select("grp", "gy", "gx", "owner"), pieces, "piece").select(F.col("n_piece").alias("piece"), "owner")
    return one.unionByName(two).groupBy("piece").agg(F.min("owner").alias("owner"))


def _nearest_owner(pieces: DataFrame, tiles: DataFrame, q: float) -> DataFrame:
    """Nearest tile of the same country for each piece: piece, owner."""
    touch = cut(_touching(pieces, tiles))
    far = pieces.join(touch, "piece", "left_anti").select(
        "grp", "piece", F.struct("piece", cell_id().alias("cid")).alias("pid"), ((F.col("gy") + 0.5) * q).alias("lat"), ((F.col("gx") + 0.5) * q).alias("lon"))
    near = _nearest_cells(far, tiles, q, "pid", "owner")
    best = near.groupBy("pid.piece").agg(F.min(F.struct("km", "owner")).alias("_b"))
    return touch.unionByName(best.select("piece", "_b.owner"))


def grow_tiles(tiles: DataFrame, land: DataFrame, admin: DataFrame, q: float) -> DataFrame:
    """Grow tiles until they cover their country (G12): grp, gy, gx, owner, grey.

    Left-over land is cut on admin lines into connected pieces. Small pieces join the nearest
    tile; large ones become grey tiles, halved while too large and merged while too small.
    """
    keys = ["grp", "gy", "gx"]
    tiles = cut(tiles.join(land.select(*keys), keys, "left_semi").select(*keys, "owner"))
    bare = land.select(*keys).join(tiles.select(*keys), keys, "left_anti")
    unit = admin.select(*keys, F.col("owner").alias("_u")).groupBy(*keys).agg(F.min("_u").alias("_u"))
    bare = bare.join(unit, keys, "left").select(*keys, F.coalesce("_u", F.lit("")).alias("owner"))
    piece = F.concat_ws("/", "grp", F.col("part").cast("string"))
    pieces = cut(parts(bare).select(*keys, "owner", piece.alias("piece")))
    has_tiles = tiles.select("grp").distinct().withColumn("_t", F.lit(True))
    size = pieces.groupBy("grp", "piece").agg(F.sum(cell_km2(q)).alias("km2")).join(has_tiles, "grp", "left")
    grey_ids = size.where(F.col("_t").isNull() | (F.col("km2") >= ABSORB_KM2)).select("piece")
    small = cut(pieces.join(grey_ids, "piece", "left_anti"))
    joined = small.drop("owner").join(_nearest_owner(small, tiles, q), "piece").select(*keys, "owner")
    tiles = cut(tiles.unionByName(joined))
    grey = cut(pieces.join(grey_ids, "piece", "left_semi").select(*keys, "owner", "piece"))
    # halve pieces that are too large along their longer side
    while True:
        box = grey.groupBy("grp", "piece").agg(F.sum(cell_km2(q)).alias("km2"), F.min("gx").alias("x0"), F.max("gx").alias("x1"),
                                              F.min("gy").alias("y0"), F.max("gy").alias("y1"))
        big = box.where((F.col("km2") > MAX_GREY_KM2) & ((F.col("x1") > F.col("x0")) | (F.col("y1") > F.col("y0"))))
        big = cut(big)
        if is_empty(big):
            break
        mid = F.radians((F.col("y0") + F.col("y1") + 1) / 2 * q)
        wide = (F.col("x1") - F.col("x0") + 1) * F.cos(mid) >= (F.col("y1") - F.col("y0") + 1)
        half = F.when(wide & (F.col("x1") > F.col("x0")) | (F.col("y1") == F.col("y0")), F.col("gx") * 2 > F.col("x0") + F.col("x1")).otherwise(F.col("gy") * 2 > F.col("y0") + F.col("y1"))
        cutting = grey.join(big.drop("grp", "km2"), "piece").withColumn("owner2", F.concat("piece", F.when(half, "a").otherwise("b")))
        again = parts(cutting.select(*keys, F.col("owner2").alias("owner")))
        again = again.select(*keys, F.col("owner").alias("_o"), F.concat_ws("/", "owner", F.col("part").cast("string")).alias("piece"))
        back = again.join(grey.select(*keys, "owner"), keys).select(*keys, "owner", "piece")
        grey = cut(grey.join(big.select("piece"), "piece", "left_anti").unionByName(back))
    size = grey.groupBy("grp", "piece").agg(F.sum(cell_km2(q)).alias("km2"))
    big_ids = cut(size.where(F.col("km2") >= MIN_GREY_KM2).select("grp", "piece"))
    large = grey.join(big_ids.select("piece"), "piece", "left_semi").select(*keys, F.col("piece").alias("owner"))
    tiny = grey.join(big_ids.select("piece"), "piece", "left_anti")
    hosts = cut(tiles.unionByName(large))
    hosted = hosts.select("grp").distinct()
    orphan = tiny.join(hosted, "grp", "left_anti")           # nothing to join: the whole country is one grey tile
    lone = orphan.join(orphan.groupBy("grp").agg(F.min("piece").alias("_p")), "grp").select(*keys, F.col("_p").alias("owner"))
    tiny = cut(tiny.join(hosted, "grp", "left_semi"))
    back = tiny.drop("owner").join(_nearest_owner(tiny, hosts, q), "piece").select(*keys, "owner")
    out = cut(hosts.unionByName(back).unionByName(lone))
    was = tiles.select("owner").distinct().withColumn("_tile", F.lit(True))
    return out.join(was, "owner", "left").select(*keys, "owner", F.col("_tile").isNull().alias("grey"))


# ------------------------------------------------------------------ cut pieces
def cut_pieces(cells: DataFrame, levels: DataFrame, level: str, base: DataFrame, q: float) -> tuple[DataFrame, DataFrame]:
    """Connected, cuttable pieces of a level (G14): pieces, and members (base tile -> piece).

    Parts too small to cut are dropped and their base tiles re-homed to the largest kept part
    of the same tile, so no place falls out of the jigsaw. ``base``: owner, name, app_places, holes.
    """
    width = F.lit(float(level[1:]))
    rows = cells.join(levels.select("owner", F.col(level).alias("tile")), "owner")
    rows = cut(parts(rows.select("grp", "gy", "gx", F.col("owner").alias("base"), F.col("tile").alias("owner"))))
    box = rows.groupBy("grp", F.col("owner").alias("tile"), "part").agg(
        F.count(F.lit(1)).alias("n"), ((F.max("gx") - F.min("gx") + 1) * q).alias("w"), ((F.max("gy") - F.min("gy") + 1) * q).alias("h"),
        ((F.min("gx") + F.max("gx") + 1) / 2 * q).alias("lon"), ((F.min("gy") + F.max("gy") + 1) / 2 * q).alias("lat"))
    box = box.withColumn("min_deg", F.least("w", "h")).withColumn("max_deg", F.greatest("w", "h"))
    box = cut(box.withColumn("fits", cuttable(F.col("min_deg"), F.col("max_deg"), width)))
    best = box.groupBy("tile").agg(F.max("fits").alias("_any"), F.max(F.struct("fits", "n", "part")).alias("_b"))
    box = box.join(best.select("tile", "_any", F.col("_b.part").alias("host")), "tile")
    kept = F.col("fits") | (~F.col("_any") & (F.col("part") == F.col("host")))
    box = cut(box.withColumn("kept", kept))
    home = rows.groupBy("base", F.col("owner").alias("tile"), "part").agg(F.count(F.lit(1)).alias("n"))
    home = home.groupBy("base", "tile").agg(F.max(F.struct("n", (-F.col("part")).alias("neg"))).alias("_b")).select(
        "base", "tile", (-F.col("_b.neg")).alias("part"))
    member = home.join(box.select("tile", "part", "host", "kept"), ["tile", "part"]).select(
        "base", "tile", F.when(F.col("kept"), F.col("part")).otherwise(F.col("host")).alias("part"), (~F.col("kept")).alias("rehomed"))
    member = cut(member)
    fill = member.join(base.withColumnRenamed("owner", "base"), "base").groupBy("tile", "part").agg(
        F.sum("app_places").alias("places"), F.sum("holes").alias("holes"), F.count(F.lit(1)).alias("members"),
        F.max_by("name", F.struct("app_places", "base")).alias("name"))
    pieces = box.where("kept").join(fill, ["tile", "part"], "left").select(
        "grp", "tile", "part", "name", F.coalesce("places", F.lit(0)).alias("places"), F.coalesce("holes", F.lit(0)).alias("holes"),
        F.coalesce("members", F.lit(0)).alias("members"), "min_deg", "max_deg", F.sqrt(F.col("n") * q * q).alias("side_deg"), "lon", "lat")
    return pieces, member


def number_tiles(tiles: DataFrame) -> DataFrame:
    """Global 1..N by country, then west to east, then north to south."""
    from placekit.plans.session import number_rows

    return number_rows(tiles, [F.col("country"), F.col("lon"), F.col("lat").desc(), F.col("tile_id")], "number")


# ------------------------------------------------------------------ territories (A26) and dissolve
def territory_kinds(places: DataFrame, tile: str = "territory_id") -> DataFrame:
    """Strongest kinds of each tile, at most three."""
    return places.groupBy(tile).agg(kinds.max_vector("kinds").alias("_v")).select(tile, F.slice(kinds.names(F.col("_v")), 1, 3).alias("kinds"))


def territories(measured: DataFrame, min_extent_km: float) -> DataFrame:
    """Extent and whether a tile is large enough to handle."""
    extent = geo.extent_km(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return measured.withColumn("extent_km", extent).withColumn("printable", F.col("extent_km") >= min_extent_km)


def dissolve(cells: DataFrame) -> DataFrame:
    """Country cells with disputed labels folded into their host (J24, S11): a relabel, no geometry."""
    return cells.withColumn("grp", text.canonical_country(F.col("grp"))).dropDuplicates(["grp", "gy", "gx"])


def relabel_territories(tiles: DataFrame) -> DataFrame:
    """Tiles under a dissolved code move to the host with the next free number."""
    code = text.canonical_iso3(F.col("iso3"))
    moved = code != F.upper(F.trim("iso3"))
    out = tiles.withColumn("_host", code).withColumn("_moved", moved)
    used = F.regexp_extract("territory_id", "-T(\\d+)$", 1).try_cast("int")
    top = out.where(~F.col("_moved")).groupBy("_host").agg(F.max(used).alias("_top"))
    # only relabelled tiles are numbered, a handful by construction of the dissolve table
    order = W.partitionBy("_host").orderBy("territory_id")
    fresh = out.where("_moved").withColumn("_n", F.row_number().over(order)).join(top, "_host", "left")
    fresh = fresh.withColumn("territory_id", geo.iso3_id(F.col("_host"), "T", F.coalesce("_top", F.lit(0)) + F.col("_n")))
    done = fresh.drop("_n", "_top").unionByName(out.where(~F.col("_moved")))
    return done.withColumn("iso3", F.col("_host")).withColumn("country", text.canonical_country(F.col("country"))).drop("_host", "_moved")


def flag_disputed(places: DataFrame) -> DataFrame:
    """Places under a dissolved label keep their point, take the host and carry the flag."""
    host = text.canonical_country(F.col("country"))
    moved = (host != F.trim("country")) | (text.canonical_iso3(F.col("iso3")) != F.upper(F.trim("iso3")))
    return (places.withColumn("disputed", F.when(moved, "ESH").otherwise(F.col("disputed") if "disputed" in places.columns else F.lit(None).cast("string")))
            .withColumn("country", F.when(moved & (text.canonical_iso3(F.col("iso3")) == "MAR"), "Morocco").otherwise(host))
            .withColumn("iso3", text.canonical_iso3(F.col("iso3"))))
