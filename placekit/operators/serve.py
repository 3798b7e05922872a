"""Questions over the published places: scope, filter, density, coverage, search, clusters, exports.

A pin frame has ``place_id, name, iso3, lat, lon, score, kmask, months, printed, whs,
territory_id, region_id``; visits have ``user_id, place_id, visited, marked_at, visited_on, note``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placekit.functions import geo, kinds, text
from placekit.functions.vocab import (
    CLIENT_EARTH_KM, CUT_MIN_MM, CUT_MM, KIND_CODES, KINDS, PIN_SPACING_MM, lookup,
)
from placekit.operators import spatial

DENSITY_MIN, DENSITY_MAX = 6, 48
ROW_ADVISORY = 10_000

MOST_LEVELS = 1_000  # cut levels of one bundle


# ------------------------------------------------------------------ filters
def clamp_density(n: float | None) -> int:
    """0 means all that pass; anything else is held to 6..48."""
    if n is None or not math.isfinite(n) or n <= 0:
        return 0
    return int(min(DENSITY_MAX, max(DENSITY_MIN, math.floor(n + 0.5))))


@dataclass(frozen=True)
class Scope:
    kind: str = "world"          # world | country | territory | region
    id: str | None = None

    def where(self) -> Column:
        column = {"country": "iso3", "territory": "territory_id", "region": "region_id"}.get(self.kind)
        return F.lit(True) if column is None else F.col(column) == self.id


@dataclass(frozen=True)
class Filters:
    visited: str = "all"         # all | yes | no
    kinds: tuple[str, ...] = ()
    printed_only: bool = False
    whs_only: bool = False
    score_min: int = 0
    months: tuple[int, ...] = ()
    search: str = ""
    entry_states: tuple[str, ...] = ()
    density: float = 0

    @property
    def active(self) -> bool:
        return bool(self.visited != "all" or self.kinds or self.printed_only or self.whs_only
                    or self.score_min > 0 or self.months or self.search.strip()
                    or self.entry_states or self.density > 0)

    def where(self, scope: Scope, seen: str = "seen", entry: str | None = None) -> Column:
        """One predicate; parts on stored columns reach the scan."""
        keep = F.lit(True)
        if self.visited != "all":
            keep = keep & (F.col(seen) if self.visited == "yes" else ~F.col(seen))
        if self.printed_only:
            keep = keep & F.col("printed")
        if self.whs_only:
            keep = keep & (F.col("whs") != 0)
        if self.score_min > 0 and scope.kind == "country":  # scores only compare inside a country
            keep = keep & (F.col("score") >= self.score_min)
        if self.kinds:
            keep = keep & kinds.has_any(F.col("kmask"), self.kinds)
        if self.months:
            keep = keep & kinds.has_any_month(F.coalesce("months", F.lit(0)), self.months)
        if self.entry_states and entry:
            keep = keep & F.coalesce(F.col(entry).isin(*self.entry_states), F.lit(False))
        if self.search.strip():
            keep = keep & F.contains(F.lower("name"), F.lit(self.search.strip().lower()))
        return keep


def cap_per_country(pins: DataFrame, n: int) -> DataFrame:
    """Best ``n`` of each country by score, then name (W01). The top-n is taken per map task first."""
    if n <= 0:
        return pins
    best = W.partitionBy("iso3").orderBy(F.col("score").desc(), "name", "place_id")
    return pins.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= n).drop("_nth")


def with_seen(pins: DataFrame, visits: DataFrame) -> DataFrame:
    """Mark pins one traveller has visited."""
    marks = visits.where("visited").select("place_id").distinct().withColumn("_v", F.lit(True))
    return pins.join(marks, "place_id", "left").withColumn("seen", F.col("_v").isNotNull()).drop("_v")


def apply_filters(pins: DataFrame, filters: Filters, scope: Scope = Scope(), entry: DataFrame | None = None) -> DataFrame:
    """Scope, filter row, then the per-country density cap."""
    rows = pins.where(scope.where())
    if entry is not None and filters.entry_states:
        rows = rows.join(entry.select(F.col("destination").alias("iso3"), F.col("r").alias("_entry")), "iso3", "left")
        rows = rows.where(filters.where(scope, entry="_entry")).drop("_entry")
    else:
        rows = rows.where(filters.where(scope))
    return cap_per_country(rows, clamp_density(filters.density))


def sort_pins(pins: DataFrame, key: str, scope: Scope = Scope(), origin: tuple[float, float] | None = None) -> DataFrame:
    """Name, most recent mark, distance or score (W03); the world is never ranked by score."""
    if key == "name":
        return pins.orderBy("name", "place_id")
    if key == "recent":
        return pins.orderBy(F.col("marked_at").desc_nulls_last(), "place_id")
    if key == "distance":
        if origin is None:
            return pins
        km = geo.haversine(F.lit(origin[0]), F.lit(origin[1]), F.col("lat"), F.col("lon"), CLIENT_EARTH_KM)
        return pins.withColumn("km", geo.tick(km)).orderBy("km", "place_id")
    if scope.kind == "world":
        return pins.orderBy("country", F.col("score").desc(), "place_id")
    return pins.orderBy(F.col("score").desc(), "name", "place_id")


def take_distributed(pins: DataFrame, n: int) -> DataFrame:
    """Best of each country in turn until ``n`` are taken."""
    best = W.partitionBy("iso3").orderBy(F.col("score").desc(), "name", "place_id")
    rows = pins.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= n)
    return rows.orderBy("turn", "iso3").limit(n)


def top_of(pins: DataFrame, group: str, k: int) -> DataFrame:
    """Best ``k`` of a tile, country or region."""
    best = W.partitionBy(group).orderBy(F.col("score").desc(), "name", "place_id")
    return pins.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)


def bulk_list(pins: DataFrame, group: str, fallback: int = 24) -> DataFrame:
    """The marking list of a group: its printed places, or its top ``fallback`` when none is printed."""
    any_printed = pins.where("printed").select(group).distinct()
    return (pins.where("printed").unionByName(
        top_of(pins.join(any_printed, group, "left_anti"), group, fallback).drop("nth")))


# ------------------------------------------------------------------ coverage
def coverage_rows(pins: DataFrame, by: list[str]) -> DataFrame:
    """available and seen per kind for each scope key, all twelve kinds, zero where absent."""
    counts = []
    for code in KIND_CODES:
        has = kinds.has(F.col("kmask"), code)
        counts.append(F.count(F.when(has, 1)).alias(f"a_{code}"))
        counts.append(F.count(F.when(has & F.col("seen"), 1)).alias(f"s_{code}"))
    wide = pins.groupBy(*by).agg(*counts, F.count(F.lit(1)).alias("places"), F.count(F.when(F.col("seen"), 1)).alias("visited"))
    rows = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(c).alias("kind"), F.col(f"a_{c}").alias("available"),
                              F.col(f"s_{c}").alias("seen")) for i, c in enumerate(KIND_CODES)])
    return wide.select(*by, "places", "visited", rows.alias("rows"))


def coverage(pins: DataFrame, by: list[str]) -> DataFrame:
    """Kinds seen, available, unseen and absent per scope (A18). Never a share of places."""
    rows = F.col("rows")

    def pick(test) -> Column:
        return F.transform(F.filter(rows, test), lambda r: r["kind"])

    return coverage_rows(pins, by).select(
        *by, "places", "visited", "rows",
        F.size(F.filter(rows, lambda r: r["available"] > 0)).alias("available_kinds"),
        F.size(F.filter(rows, lambda r: r["seen"] > 0)).alias("seen_kinds"),
        pick(lambda r: (r["available"] > 0) & (r["seen"] == 0)).alias("unseen"),
        pick(lambda r: r["available"] == 0).alias("absent"))


def seen_mask(pins: DataFrame, by: list[str]) -> DataFrame:
    """Bitmask of kinds seen per scope: one bit-or, no exploding."""
    return pins.where("seen").groupBy(*by).agg(F.bit_or("kmask").alias("mask"))


def newly_seen(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Kinds seen after and not before, per scope."""
    old = before.withColumnRenamed("mask", "_old")
    new = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0))))
    return after.join(old, by, "left").withColumn("mask", new).where(F.col("mask") != 0).select(
        *by, kinds.decode(F.col("mask")).alias("kinds"))


# ------------------------------------------------------------------ joins for reading
def nearby(pins: DataFrame, km: float = 120.0, k: int = 8) -> DataFrame:
    """The nearest ``k`` other places within a day's reach of each place."""
    left = pins.select("place_id", "lat", "lon")
    right = spatial.as_right(left, near_id="place_id")
    # a place is its own nearest row, so one more is asked for and itself dropped
    near = spatial.nearest_k(left, right, k + 1, km, "place_id", "near_id").where(F.col("place_id") != F.col("near_id"))
    order = W.partitionBy("place_id").orderBy("km", "near_id")
    return near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def entry_lookup(pins: DataFrame, entry: DataFrame) -> DataFrame:
    """Each pin's entry requirement for one or more passports."""
    return pins.join(entry.withColumnRenamed("destination", "iso3"), "iso3", "left")


def uncovered(pins: DataFrame, entry: DataFrame) -> DataFrame:
    """Countries in view the passport index does not carry."""
    return pins.select("iso3").distinct().join(entry.select(F.col("destination").alias("iso3")), "iso3", "left_anti")


def visits_with_places(visits: DataFrame, places: DataFrame) -> DataFrame:
    """Visits with what is known of their place; a place missing from this build is kept and flagged."""
    known = places.select("place_id", "name", "iso3").withColumn("_here", F.lit(True))
    return visits.join(known, "place_id", "left").withColumn("dangling", F.col("_here").isNull()).drop("_here")


def dangling(visits: DataFrame, places: DataFrame) -> DataFrame:
    return visits.join(places.select("place_id"), "place_id", "left_anti")


def search(q: str, places: DataFrame, regions: DataFrame, countries: DataFrame, limit: int = 8) -> DataFrame:
    """Countries, regions and already filtered places, best name match first."""
    q = q.strip().lower()

    def rank(name: Column) -> Column:
        low = F.lower(name)
        return F.when(low == q, 0).when(F.startswith(low, F.lit(q)), 1).when(F.contains(low, F.lit(q)), 2).otherwise(9)

    def shaped(df: DataFrame, kind: str, order: int, id_: str, country: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.lit(order).alias("_type"), F.col(id_).alias("id"), "name",
                         F.col(country).alias("country"), rank(F.col("name")).alias("match"))

    hits = shaped(countries.withColumn("name", F.col("country")), "country", 0, "iso3", "country").where(F.col("match") < 9)
    hits = hits.unionByName(shaped(regions, "region", 1, "region_id", "country").where(F.col("match") < 9))
    hits = hits.unionByName(shaped(places, "place", 2, "place_id", "country"))
    if not q:
        return hits.limit(0).drop("_type")
    return hits.orderBy("match", "_type", "name", "id").limit(limit).drop("_type")


def clusters(pins: DataFrame, zoom: float, max_zoom: float = 4.6) -> DataFrame:
    """Grid clusters of one zoom level (A24); empty at and above ``max_zoom``."""
    if zoom >= max_zoom:
        pins = pins.limit(0)
    cell = 360.0 / max(6, math.floor(8 * 2 ** zoom + 0.5))
    return (pins.groupBy(F.floor(F.col("lon") / cell).alias("cx"), F.floor(F.col("lat") / cell).alias("cy"))
            .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("seen"), 1)).alias("seen"),
                 F.count(F.when(F.col("in_scope"), 1)).alias("in_scope"),
                 F.avg("lon").alias("lon"), F.avg("lat").alias("lat")))


# ------------------------------------------------------------------ exports
def sheet(pins: DataFrame, countries: DataFrame, regions: DataFrame, visits: DataFrame, sources: DataFrame) -> DataFrame:
    """The thirteen spreadsheet columns of a filtered or ticked set."""
    out = (pins.join(countries.select("iso3", "country"), "iso3", "left")
           .join(regions.select("region_id", F.col("name").alias("region")), "region_id", "left")
           .join(visits.select("place_id", "visited", "visited_on", "note"), "place_id", "left")
           .join(sources.select("place_id", "sources"), "place_id", "left"))
    blank = F.lit("")
    return out.select(
        "name", "country", F.coalesce("region", blank).alias("region"), "lat", "lon",
        F.array_join(kinds.labels(kinds.decode(F.col("kmask"))), "; ").alias("kinds"),
        F.concat(F.col("score").cast("string"), F.lit(" of 100 in "), "country").alias("score"),
        F.when(F.col("visited"), "yes").otherwise("no").alias("visited"),
        F.coalesce(F.col("visited_on").cast("string"), blank).alias("visited_on"), F.coalesce("note", blank).alias("note"),
        F.col("whs").alias("WHS"), F.coalesce(F.array_join("sources", "; "), blank).alias("sources"), "place_id")


def row_advisory(rows: DataFrame) -> DataFrame:
    """Row count and whether a spreadsheet of it will be slow to open."""
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("slow", F.col("n") > ROW_ADVISORY)


# ------------------------------------------------------------------ poster advice
def poster_advice(requests: DataFrame) -> DataFrame:
    """Spacing, size and sheet advice over (request_id, scope, width_mm, height_mm, n)."""
    w, h, n = F.col("width_mm"), F.col("height_mm"), F.col("n")
    spacing = F.when((w > 0) & (h > 0) & (n > 0), F.sqrt(w * h / n))
    return (requests.withColumn("spacing_mm", spacing)
            .withColumn("pins_overlap", F.coalesce(spacing < PIN_SPACING_MM, F.lit(False)))
            .withColumn("below_a4", w * h < 210 * 297)
            .withColumn("suggest_width_mm", F.when(F.col("scope") == "world", 1400).when(F.col("scope") == "country", 500).otherwise(400))
            .withColumn("suggest_height_mm", F.when(F.col("scope") == "world", 700).when(F.col("scope") == "country", 620).otherwise(400))
            .withColumn("suggest_cap", F.when(F.col("scope") == "world", F.least(F.lit(1200), n)).otherwise(n)))


def cuttable(min_deg: Column, max_deg: Column, width_mm: Column) -> Column:
    """Enough of a piece to hold, and enough across its narrow way for scissors."""
    mm = width_mm / 360.0
    return (max_deg * mm >= CUT_MM) & (min_deg * mm >= CUT_MIN_MM)


def tile_size_report(tiles: DataFrame, width_mm: float, by: list[str] | None = None) -> DataFrame:
    """Pieces too small to cut at a width, places on them, and a width that cuts most."""
    w = F.lit(float(width_mm))
    group = by or ["_all"]
    rows = (tiles if by else tiles.withColumn("_all", F.lit(0))).withColumn("_small", ~cuttable(F.col("min_deg"), F.col("max_deg"), w))
    out = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("tiles"), F.count(F.when(F.col("_small"), 1)).alias("too_small"),
        F.sum(F.when(F.col("_small"), F.col("places")).otherwise(0)).alias("places_lost"))
    # sides are counted first, so only distinct ones are ordered
    sides = rows.where("_small").groupBy(*group, F.col("max_deg").alias("_side")).agg(F.count(F.lit(1)).alias("_n"))
    down = W.partitionBy(*group).orderBy(F.desc("_side"))
    upto, n = F.sum("_n").over(down.rowsBetween(W.unboundedPreceding, W.currentRow)), F.sum("_n").over(W.partitionBy(*group))
    at = sides.withColumns({"_upto": upto, "_at": F.floor(n * 0.35)}).where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n")))
    want = F.when(F.col("_side") > 0, F.ceil((CUT_MM / F.col("_side")) * 360.0 / 100.0) * 100).otherwise(w)
    return (out.join(at.select(*group, "_side"), group, "left")
            .withColumn("suggest_width_mm", F.greatest(w, want.cast("double"))).drop("_side", "_all"))


def level_for_width(levels: DataFrame, requests: DataFrame) -> DataFrame:
    """Finest level that is still cuttable at each width, else the coarsest.

    ``levels`` is the handful of widths a bundle was cut at; they become part of the expression, so more than
    ``MOST_LEVELS`` of them are refused.
    """
    usable = [(r["for_map_mm"], r["level"]) for r in levels.where(F.col("for_map_mm").isNotNull()).orderBy("for_map_mm", "level").limit(MOST_LEVELS + 1).collect()]
    if len(usable) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} cut levels")
    level = F.lit(usable[0][1] if usable else "L0")
    for mm, name in usable[1:]:
        level = F.when(F.col("width_mm") >= mm, F.lit(name)).otherwise(level)
    # a later, wider level is tested first: the last one wrapped is the outermost
    return requests.withColumn("level", F.when(F.col("width_mm").isNull(), F.lit("L0")).otherwise(level))


def poster_suggestion(scope: str, count: int) -> dict[str, int]:
    """Suggested sheet for a scope."""
    if scope == "world":
        return {"width_mm": 1400, "height_mm": 700, "cap": min(1200, count)}
    if scope == "country":
        return {"width_mm": 500, "height_mm": 620, "cap": count}
    return {"width_mm": 400, "height_mm": 400, "cap": count}


# ------------------------------------------------------------------ counts
def kind_counts(places: DataFrame) -> DataFrame:
    """Places per kind, by country and for the world (iso3 null)."""
    flags = places.select("iso3", F.explode(kinds.decode(F.col("kmask"))).alias("kind"))
    return flags.groupingSets([["iso3", "kind"], ["kind"]], "iso3", "kind").agg(F.count(F.lit(1)).alias("n"))


def provenance_counts(places: DataFrame) -> DataFrame:
    """Places each source contributes to."""
    return places.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("places"))


def country_index(places: DataFrame) -> DataFrame:
    """Per country: places, printed places, kinds present."""
    return places.groupBy("iso3").agg(
        F.count(F.lit(1)).alias("places"), F.count(F.when(F.col("printed"), 1)).alias("holes"),
        F.bit_count(F.bit_or("kmask")).alias("kinds"))


def inspect_country(places: DataFrame, country: str, k: int = 25) -> DataFrame:
    """A country's top places."""
    return places.where(F.lower("country") == country.lower()).orderBy(F.col("score").desc(), "name").limit(k)
