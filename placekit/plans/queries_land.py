"""Registered queries: polygons, cells, regions, tiles and levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from placekit.functions import kinds
from placekit.operators import land
from placekit.plans import build as jobs
from placekit.plans.oracles import km, sql
from placekit.plans.queries import query, r6
from placekit.plans.session import cut

Q = 0.25  # cell size in degrees; each admin rectangle is 4 x 4 cells


def _edges(v):
    return land.rect_edges(v.admin_rect, "region_id", "iso3")


def _points(v):
    return v.pin.select(F.col("place_id").alias("point_id"), F.col("iso3").alias("grp"), "lat", "lon")


def _cells(v):
    return cut(land.rasterise(_edges(v), Q))


def _busy_units(v):
    """Admin rectangles with their cells; the tessellation thins where few places are."""
    cells = _cells(v)
    at = land.place_in_cells(v.pin.select("place_id", F.col("iso3").alias("grp"), "lat", "lon"), cells, Q, "owner")
    fill = v.pin.join(at, "place_id").groupBy("owner").agg(
        F.count(F.lit(1)).alias("n"), F.bit_or("kmask").alias("kmask"), F.count(F.when(F.col("printed"), 1)).alias("holes"))
    return cells, cut(fill)


_CELLS = """cells AS (SELECT region_id AS owner, iso3 AS grp, gy.g AS gy, gx.g AS gx FROM admin_rect,
  LATERAL (SELECT unnest(range((y0 * 4)::BIGINT, (y1 * 4)::BIGINT)) AS g) gy, LATERAL (SELECT unnest(range((x0 * 4)::BIGINT, (x1 * 4)::BIGINT)) AS g) gx)"""


def with_cells(final: str, *needs: str) -> str:
    return sql("", *needs, "admin_rect").rstrip() + ",\n" + _CELLS + ("" if final.strip().startswith(",") else "\n") + final.strip()


@query("point_in_region", sql("""SELECT place_id, region_id FROM pin p JOIN admin_rect r ON r.iso3 = p.iso3 AND lat >= y0 AND lat < y1 AND lon >= x0 AND lon < x1""", "pin", "admin_rect"))
def _(v):
    return land.locate(_points(v), _edges(v)).select(F.col("point_id").alias("place_id"), F.col("poly_id").alias("region_id"))


_DEG = "sqrt(pow(greatest(x0 - lon, lon - x1, 0), 2) + pow(greatest(y0 - lat, lat - y1, 0), 2))"


@query("nearest_region", sql(f"""SELECT place_id, region_id, how FROM (
  SELECT place_id, region_id, CASE WHEN inside THEN 'inside' ELSE 'nearest' END AS how, row_number() OVER (PARTITION BY place_id ORDER BY NOT inside, d, region_id) AS rn FROM (
    SELECT place_id, region_id, lat >= y0 AND lat < y1 AND lon >= x0 AND lon < x1 AS inside, round_even({_DEG} * 1e6, 0) / 1e6 AS d
    FROM pin p JOIN admin_rect r ON r.iso3 = p.iso3)) WHERE rn = 1""", "pin", "admin_rect"))
def _(v):
    out = land.assign_to_polygons(_points(v), _edges(v), 50.0)
    return out.select(F.col("point_id").alias("place_id"), F.col("poly_id").alias("region_id"), "how")


@query("polygon_km2", sql("""SELECT region_id, round(6371.0088 * 6371.0088 * radians(x1 - x0) * abs(sin(radians(y1)) - sin(radians(y0))) + 1e-9, 3) AS cell_km2,
  round(abs(radians(x1 - x0) * (2 + 2 * sin(radians(y0))) + radians(x0 - x1) * (2 + 2 * sin(radians(y1)))) * 6371.0088 * 6371.0088 / 2 + 1e-9, 3) AS km2 FROM admin_rect""", "admin_rect"))
def _(v):
    ring = land.km2(_edges(v)).select(F.col("poly_id").alias("region_id"), F.round(F.col("km2") + 1e-9, 3).alias("km2"))
    cell = land.measures(_cells(v), Q).select(F.col("owner").alias("region_id"), F.round(F.col("km2") + 1e-9, 3).alias("cell_km2"))
    return ring.join(cell, "region_id")


@query("border_lengths", with_cells("""SELECT grp, least(a.owner, b.owner) AS a, greatest(a.owner, b.owner) AS b, count(*) * 0.25::DOUBLE AS shared
  FROM cells a JOIN cells b USING (grp) WHERE a.owner <> b.owner AND ((b.gy = a.gy AND b.gx = a.gx + 1) OR (b.gx = a.gx AND b.gy = a.gy + 1)) GROUP BY ALL"""))
def _(v):
    return land.borders(_cells(v), Q)


@query("tile_measures", sql("""SELECT region_id AS owner, 16 AS n_cells, 1.0::DOUBLE AS deg2, 4.0::DOUBLE AS perimeter,
  round(greatest(111.32 * cos(radians((y0 + y1) / 2.0)), 111.32) + 1e-9, 6) AS extent_km FROM admin_rect""", "admin_rect"))
def _(v):
    out = land.territories(land.measures(_cells(v), Q), 160.0)
    return out.select("owner", "n_cells", "deg2", "perimeter", r6("extent_km").alias("extent_km"))


@query("region_coverage_gap", with_cells("""SELECT grp, count(*) AS cells, round(count(*) FILTER (owner LIKE '%-R0%' AND right(owner, 1) = '7' AND ((gx % 4) + 4) % 4 = 1 AND ((gy % 4) + 4) % 4 IN (1, 2)) / count(*) + 1e-9, 6) AS gap FROM (
  SELECT DISTINCT ON (grp, gy, gx) * FROM cells) GROUP BY ALL"""))
def _(v):
    cells = _cells(v)
    hole = F.col("owner").endswith("-R07") & (F.pmod(F.col("gx"), F.lit(4)) == 1) & F.pmod(F.col("gy"), F.lit(4)).isin(1, 2)
    return land.coverage_gap(cells, cells.where(~hole), Q, rings=0).select("grp", "cells", r6("gap").alias("gap"))


@query("owner_partition", with_cells("""SELECT gy, gx, owner FROM (SELECT *, row_number() OVER (PARTITION BY gy, gx ORDER BY p DESC, owner) AS rn FROM (
  SELECT owner, gy, gx, 0 AS p FROM cells UNION ALL SELECT 'big-' || iso3, c.gy, c.gx, n % 3 - 1 FROM cells c JOIN (SELECT DISTINCT iso3, n FROM admin_rect) m ON m.iso3 = c.grp WHERE c.gy % 2 = 0)) WHERE rn = 1"""))
def _(v):
    cells = _cells(v)
    n = v.admin_rect.select(F.col("iso3").alias("grp"), "n").distinct()
    big = cells.where(F.col("gy") % 2 == 0).join(n, "grp").select(F.concat(F.lit("big-"), "grp").alias("owner"), "grp", "gy", "gx", (F.col("n") % 3 - 1).alias("p"))
    both = cells.withColumn("p", F.lit(0)).unionByName(big)
    return land.disjoint(both, [F.col("p").desc()]).select("gy", "gx", "owner")


_SIDES = """sides AS (SELECT a.grp, a.owner AS a, b.owner AS b, count(*) * 0.25::DOUBLE AS s FROM cells a JOIN cells b USING (grp)
  WHERE a.owner <> b.owner AND abs(b.gy - a.gy) + abs(b.gx - a.gx) = 1 GROUP BY ALL)"""
# a place off the land is nearest to the cell at the land's edge beside it
_FILL = """box AS (SELECT grp, min(gy) AS y0, max(gy) AS y1, min(gx) AS x0, max(gx) AS x1 FROM cells GROUP BY grp),
fill AS (SELECT c.owner AS id, count(*) AS n, bit_or(kmask) AS kmask, count(*) FILTER (printed) AS holes FROM pin p JOIN box b ON b.grp = p.iso3
  JOIN cells c ON c.grp = p.iso3 AND c.gy = least(greatest(CAST(floor(lat * 4) AS BIGINT), y0), y1) AND c.gx = least(greatest(CAST(floor(lon * 4) AS BIGINT), x0), x1) GROUP BY c.owner)"""
_UNITS = """units AS (SELECT r.iso3 AS grp, region_id AS id, (x1 - x0) * (y1 - y0)::DOUBLE AS deg2, 2.0::DOUBLE * (x1 - x0 + y1 - y0) AS perimeter, coalesce(fill.n, 0)::BIGINT AS n_places, coalesce(fill.kmask, 0)::BIGINT AS kmask
  FROM admin_rect r LEFT JOIN fill ON fill.id = region_id)"""


def _merging(weight: str, pos: str, small: str, order: str, keep: str, new_pos: str, final: str) -> str:
    """SQL that merges one tile at a time per country: the lightest small one that touches another (u) with its best neighbour (v)."""
    tile = "{'id': %s, 'w': %s, 'pos': %s, 'per': %s, 'k': %s}"
    u, v = "list_filter(tiles, lambda t: t.id = u.id)[1]", "list_filter(tiles, lambda t: t.id = e.b)[1]"
    return with_cells(f""", {_SIDES}, {_FILL}, {_UNITS},
walk AS (SELECT grp, 0 AS step, list({tile % ('id', weight, pos, 'perimeter', 'kmask')} ORDER BY id) AS tiles, list({{'unit': id, 'tile': id}} ORDER BY id) AS made, any_value(e.edges) AS edges
    FROM units JOIN (SELECT grp, list({{'a': a, 'b': b, 's': s}} ORDER BY a, b) AS edges FROM sides GROUP BY grp) e USING (grp) GROUP BY grp
  UNION ALL SELECT grp, step + 1, list_append(list_filter(tiles, lambda t: t.id <> u.id AND t.id <> v.id), {tile % (keep, 'u.w + v.w', new_pos, 'u.per + v.per - 2 * v.s', 'u.k | v.k')}),
    list_transform(made, lambda m: {{'unit': m.unit, 'tile': CASE WHEN m.tile = u.id OR m.tile = v.id THEN {keep} ELSE m.tile END}}),
    list_transform(list_distinct(list_transform(moved, lambda e: {{'a': e.a, 'b': e.b}})), lambda p: {{'a': p.a, 'b': p.b, 's': list_sum(list_transform(list_filter(moved, lambda e: e.a = p.a AND e.b = p.b), lambda e: e.s))}}) FROM (
      SELECT *, list_transform(list_filter(edges, lambda e: NOT (e.a IN (u.id, v.id) AND e.b IN (u.id, v.id))),
        lambda e: {{'a': CASE WHEN e.a IN (u.id, v.id) THEN {keep} ELSE e.a END, 'b': CASE WHEN e.b IN (u.id, v.id) THEN {keep} ELSE e.b END, 's': e.s}}) AS moved FROM (
        SELECT *, list_sort(list_transform(list_filter(beside, lambda v: true), lambda v: {order}))[1].v AS v FROM (
          SELECT *, list_transform(list_filter(edges, lambda e: e.a = u.id), lambda e: {{'id': e.b, 's': e.s, 'w': {v}.w, 'pos': {v}.pos, 'per': {v}.per, 'k': {v}.k}}) AS beside FROM (
            SELECT *, list_sort(list_transform(list_filter(tiles, lambda t: {small} AND len(list_filter(edges, lambda e: e.a = t.id)) > 0), lambda t: {{'w': t.w, 'pos': t.pos, 'id': t.id, 'per': t.per, 'k': t.k}}))[1] AS u FROM walk)
          WHERE u IS NOT NULL)))),
done AS (SELECT grp, unnest(made) AS m FROM (SELECT grp, max_by(made, step) AS made FROM walk GROUP BY grp)),
tile AS (SELECT grp, m.unit AS unit, m.tile AS tile FROM done)
{final}""", "pin").replace("WITH ", "WITH RECURSIVE ", 1)


_ALIKE = "CASE WHEN u.k <> 0 AND v.k <> 0 THEN bit_count(u.k & v.k)::DOUBLE / bit_count(u.k | v.k) ELSE 0 END"
_THIN = _merging("n_places", "'0' || md5(id)", "t.w > 0 AND t.w < 3", f"{{'c': greatest(0, u.per + v.per - 2 * v.s - greatest(u.per, v.per)) + 4 * (1 - {_ALIKE}), 'p': v.pos, 'v': v}}",
                 "least(u.id, v.id)", "'1' || u.w || u.pos", "SELECT grp, unit, tile FROM tile")
_LEAST = f"{land.side_deg(1400.0) ** 2!r}::DOUBLE"
_SIZED = _merging("deg2", "md5(id)", f"t.w < {_LEAST}", f"CASE WHEN u.w + v.w <= 3 * {_LEAST} THEN {{'f': 0, 'x': -v.s, 'p': translate(v.pos, '0123456789abcdef', 'fedcba9876543210'), 'v': v}} ELSE {{'f': 1, 'x': v.w, 'p': v.pos, 'v': v}} END",
                  "v.id", "v.pos", "SELECT grp, unit, tile FROM tile")


@query("merge_undersized", _THIN)
def _(v):
    cells, fill = _busy_units(v)
    units = land.measures(cells, Q).select("grp", F.col("owner").alias("unit"), "perimeter").join(fill.withColumnRenamed("owner", "unit"), "unit", "left")
    units = units.select("grp", "unit", "perimeter", F.coalesce("n", F.lit(0)).alias("n_places"), F.coalesce("kmask", F.lit(0)).alias("kmask"))
    return land.merge_undersized(units, land.borders(cells, Q))


@query("merge_to_size", _SIZED)
def _(v):
    cells, _ = _busy_units(v)
    units = land.measures(cells, Q).select("grp", F.col("owner").alias("unit"), "deg2")
    return land.merge_to_size(units, land.borders(cells, Q), 1400.0)


def _levels(v):
    cells, fill = _busy_units(v)
    base = cells.select("owner").distinct().join(fill, "owner", "left").select("owner", F.coalesce("n", F.lit(0)).alias("app_places"), F.coalesce("holes", F.lit(0)).alias("holes"))
    base = cut(base.withColumn("name", F.concat(F.lit("Land "), "owner")))
    return cells, base, cut(land.nest_levels(cells, base, Q))


@query("nested_levels")
def _(v):
    return _levels(v)[2].select("owner", "L0", "w2000", "w1400", "w1000", "w700")


@query("level_report")
def _(v):
    cells, _, levels = _levels(v)
    return land.level_report(cells, levels, Q)


@query("cut_pieces")
def _(v):
    cells, base, levels = _levels(v)
    return land.cut_pieces(cells, levels, "w1400", base, Q)[0]


def _land_with_gap(v):
    """Country land and admin cells with one rectangle of each country left out of the admin layer."""
    cells = _cells(v)
    return cells, cells.where(~F.col("owner").endswith("-R06"))


_REGION_IDS = """ids AS (SELECT iso3, region_id AS unit, iso3 || '-R' || lpad(CAST(row_number() OVER (PARTITION BY iso3 ORDER BY region_id LIKE '%-R06', region_id) AS VARCHAR), 2, '0') AS region_id FROM admin_rect)"""


@query("regions", with_cells(f""", {_REGION_IDS}
  SELECT ids.region_id, grp, gy, gx, CASE WHEN unit LIKE '%-R06' THEN NULL ELSE unit END AS unit FROM cells JOIN ids ON cells.owner = ids.unit"""))
def _(v):
    cells, admin = _land_with_gap(v)
    iso3 = v.country.select(F.col("iso3").alias("grp"), "iso3")
    return land.regions(admin, cells, iso3).select("region_id", "grp", "gy", "gx", "unit")


# a place off the land is nearest to the cell at the land's edge beside it
@query("place_regions", with_cells(f""", {_REGION_IDS},
  box AS (SELECT grp, min(gy) AS y0, max(gy) AS y1, min(gx) AS x0, max(gx) AS x1 FROM cells GROUP BY grp)
  SELECT place_id, min(ids.region_id) AS region_id FROM pin p JOIN box b ON b.grp = p.iso3
    JOIN cells c ON c.grp = p.iso3 AND c.gy = least(greatest(CAST(floor(lat * 4) AS BIGINT), y0), y1) AND c.gx = least(greatest(CAST(floor(lon * 4) AS BIGINT), x0), x1)
    JOIN ids ON ids.unit = c.owner GROUP BY place_id""", "pin"))
def _(v):
    cells, admin = _land_with_gap(v)
    regions = cut(land.regions(admin, cells, v.country.select(F.col("iso3").alias("grp"), "iso3")))
    return land.place_in_cells(v.pin.withColumn("grp", F.col("iso3")), regions, Q, "region_id")


@query("grow_tiles", sql("""SELECT iso3 AS grp, count(*) * 16 AS cells FROM admin_rect GROUP BY ALL""", "admin_rect"))
def _(v):
    cells = _cells(v)
    tiles = cells.where(F.col("owner").rlike("-R0[1-5]$"))
    return land.grow_tiles(tiles, cells, cells, Q).groupBy("grp").agg(F.count_distinct("gy", "gx").alias("cells"))


@query("grown_tile_owners")
def _(v):
    cells = _cells(v)
    tiles = cells.where(F.col("owner").rlike("-R0[1-5]$"))
    return land.grow_tiles(tiles, cells, cells, Q).groupBy("grp", "owner", "grey").agg(F.count(F.lit(1)).alias("cells"))


@query("name_pieces", with_cells("""SELECT region_id AS owner, 'Land ' || region_id AS name FROM admin_rect WHERE region_id NOT LIKE '%-R06'
  UNION ALL SELECT r.region_id, coalesce((SELECT name FROM pin p WHERE p.lat >= r.y0 AND p.lat < r.y1 AND p.lon >= r.x0 AND p.lon < r.x1 ORDER BY score DESC, name LIMIT 1),
    'South-western ' || c.country) FROM admin_rect r JOIN country c USING (iso3) WHERE region_id LIKE '%-R06'""", "pin", "country"))
def _(v):
    cells, admin = _land_with_gap(v)
    names = v.admin_rect.select(F.col("region_id").alias("owner"), F.concat(F.lit("Land "), "region_id").alias("name"))
    towns = v.pin.select("name", "lat", "lon", F.col("score").cast("double").alias("population"))
    return land.name_pieces(cells, admin, names, towns, v.country.select(F.col("iso3").alias("grp"), "country"), Q)


@query("territory_kinds", sql("""SELECT region_id, string_agg(kind, '/' ORDER BY ord) AS kinds FROM (
  SELECT region_id, kind, ord, row_number() OVER (PARTITION BY region_id ORDER BY ord) AS rn FROM (SELECT DISTINCT region_id, kind, ord FROM pin p
    JOIN admin_rect r ON r.iso3 = p.iso3 AND lat >= y0 AND lat < y1 AND lon >= x0 AND lon < x1 JOIN kindtab ON kmask & (1 << (ord - 1)::INT) <> 0)) WHERE rn <= 3 GROUP BY ALL""", "pin", "admin_rect", "kindtab"))
def _(v):
    at = land.locate(_points(v), _edges(v)).select(F.col("point_id").alias("place_id"), F.col("poly_id").alias("region_id"))
    vec = F.transform(kinds.codes(), lambda c: F.when(F.array_contains(kinds.decode(F.col("kmask")), c), 0.5).otherwise(0.0))
    rows = v.pin.withColumn("kinds", vec).join(at, "place_id")
    return land.territory_kinds(rows, "region_id").select("region_id", F.array_join("kinds", "/").alias("kinds"))


@query("padded_boxes", sql("""SELECT iso3, min(lon) - 0.15 AS x0, min(lat) - 0.15 AS y0, max(lon) + 0.15 AS x1, max(lat) + 0.15 AS y1 FROM pin GROUP BY ALL""", "pin"))
def _(v):
    return land.padded_boxes(v.pin, "iso3")


@query("bundle_export", sql("""SELECT territory_id, count(*) AS app_places FROM (SELECT place_id, region_id AS territory_id FROM (
  SELECT place_id, region_id, row_number() OVER (PARTITION BY place_id ORDER BY NOT inside, d, region_id) AS rn FROM (
    SELECT place_id, region_id, lat >= y0 AND lat < y1 AND lon >= x0 AND lon < x1 AS inside, round_even(""" + _DEG + """ * 1e6, 0) / 1e6 AS d
    FROM pin p JOIN admin_rect r ON r.iso3 = p.iso3)) WHERE rn = 1) GROUP BY ALL""", "pin", "admin_rect"))
def _(v):
    places = v.pin.drop("country").withColumn("country", F.col("iso3"))
    tiles = v.admin_rect.select(F.col("region_id").alias("territory_id"), "iso3")
    out = jobs.export_bundle(places, _edges(v), tiles)["territories"]
    return out.where(F.col("app_places") > 0).select("territory_id", "app_places")


@query("dissolved_land", with_cells("SELECT 'Morocco' AS grp, count(*) AS cells FROM cells WHERE grp IN ('NAA', 'NAB')"))
def _(v):
    cells = _cells(v)
    named = cells.withColumn("grp", F.when(F.col("grp") == "NAA", "W. Sahara").when(F.col("grp") == "NAB", " morocco").otherwise(F.col("grp")))
    named = named.withColumn("grp", F.when(F.trim("grp") == "morocco", "Morocco").otherwise(F.col("grp")))
    return land.dissolve(named).groupBy("grp").agg(F.count(F.lit(1)).alias("cells")).where(F.col("grp") == "Morocco")
