"""Source readers (S01-S19): files in, asset or candidate rows out.

A source is a function from a session and options to a DataFrame in the asset schema or the
candidate schema. New sources register with :func:`source`.
"""

from __future__ import annotations

import html.entities
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placekit.functions import text
from placekit.functions.vocab import TIER_NAMES, lookup, sql_value
from placekit.operators.resolve import complete

ASSET = ("asset_id", "tier", "name", "source", "source_url", "retrieved", "country", "lat", "lon", "radius_km", "extra")


class SourceError(RuntimeError):
    """A source that cannot be trusted: missing columns, no rows, broken records."""


@dataclass(frozen=True)
class Source:
    name: str
    licence: str
    attribution: str
    cross_country: bool
    load: Callable[..., DataFrame]
    gives: str  # "assets" or "candidates"


REGISTRY: dict[str, Source] = {}


def source(name: str, licence: str, attribution: str, cross_country: bool, gives: str = "assets"):
    def keep(fn):
        REGISTRY[name] = Source(name, licence, attribution, cross_country, fn, gives)
        return fn

    return keep


def provenance(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Licence and attribution of the sources a build used."""
    rows = [(s.name, s.licence, s.attribution, s.cross_country) for n, s in REGISTRY.items() if names is None or n in names]
    return spark.createDataFrame(rows, "source string, licence string, attribution string, cross_country boolean").withColumn(
        "retrieved", F.current_date())


# ------------------------------------------------------------------ helpers
def _csv(spark: SparkSession, path: str) -> DataFrame:
    # every column is text and cast on use, so no pass over the data guesses types
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _pick(df: DataFrame, names: tuple[str, ...], label: str, who: str) -> Column:
    for n in names:
        if n in df.columns:
            return F.col(f"`{n}`")
    raise SourceError(f"{who}: no column for {label}; tried {', '.join(names)}")


def _opt(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)


def _number(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def _located(df: DataFrame, lat: Column, lon: Column) -> DataFrame:
    return df.withColumn("lat", _number(lat)).withColumn("lon", _number(lon)).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def _assets(df: DataFrame, **cols: Column) -> DataFrame:
    extra = F.create_map().cast("map<string,string>")
    base = {"name": F.lit(""), "source_url": F.lit(""), "retrieved": F.current_date(), "country": F.lit(""),
            "lat": F.col("lat"), "lon": F.col("lon"), "radius_km": F.lit(0.0), "extra": extra}
    base.update(cols)
    return df.select(*[base[c].alias(c) for c in ASSET])


def _extra(**parts: Column) -> Column:
    flat = [x for k, v in parts.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*flat), lambda k, v: v.isNotNull())


# ------------------------------------------------------------------ settlements
@source("ghsl-ucdb", "CC-BY-4.0", "European Commission JRC, GHSL", False, "candidates")
def settlements(spark: SparkSession, path: str, floor: float = 5_000.0) -> DataFrame:
    """Urban centres above a population floor, under any of the known header layouts."""
    df, who = _csv(spark, path), "ghsl-ucdb"
    # Header names of the known releases.
    name = _pick(df, ("GC_UCN_MAI_2025", "UC_NM_MN", "name"), "name", who)
    country = _pick(df, ("GC_CNT_GAD_2025", "CTR_MN_NM", "country"), "country", who)
    heads = _pick(df, ("GH_BUS_TOT_2025", "P15", "population"), "population", who)
    lat = _pick(df, ("GC_UCA_LTC_2025", "latitude", "lat", "GCPNT_LAT"), "latitude", who)
    lon = _pick(df, ("GC_UCA_LNC_2025", "longitude", "lon", "GCPNT_LON"), "longitude", who)
    key = _opt(df, "ID_UC_G0")
    rows = df.withColumn("_key", F.coalesce(key, F.concat_ws("_", lat, lon))).withColumn("_heads", F.coalesce(_number(heads), F.when(F.trim(F.coalesce(heads, F.lit(""))) == "", 0.0)))
    rows = _located(rows, lat, lon).where(F.col("_heads") >= floor)
    clean = F.nullif(F.trim(name), F.lit(""))
    return complete(rows.select(
        F.concat(F.lit("uc-"), "_key").alias("candidate_id"), F.coalesce(clean, F.concat(F.lit("Urban centre "), "_key")).alias("name"),
        F.coalesce(F.trim(country), F.lit("")).alias("country"), "lat", "lon", F.col("_heads").alias("population"),
        F.array(F.lit(who)).alias("sources")))


def normalise_settlements(df: DataFrame) -> DataFrame:
    """Gazetteer columns to the settlement layout; rows without numbers drop."""
    rows = _located(df, F.col("lat"), F.col("lon")).withColumn("population", F.coalesce(_number(F.col("population")), F.when(F.coalesce("population", F.lit("")) == "", 0.0)))
    return rows.where(F.col("population").isNotNull()).select(
        F.col("geonameid").alias("ID_UC_G0"), F.col("settlement").alias("name"), "country", "population",
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))


# ------------------------------------------------------------------ World Heritage
def repair_xml(raw: Column) -> Column:
    """Named HTML entities become characters (the five XML ones stay), two prose fields are emptied."""
    out = raw
    for tag in ("short_description", "justification"):
        out = F.regexp_replace(out, f"(?s)<{tag}>.*?</{tag}>", f"<{tag}/>")
    keep = {"amp", "lt", "gt", "quot", "apos"}
    names = {n[:-1]: c for n, c in html.entities.html5.items() if n.endswith(";") and n[:-1].isalnum() and n[:-1] not in keep}
    # markup characters stay escaped; the table itself comes from the standard library
    safe = {n: c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for n, c in names.items()}
    table = F.expr("map(" + ", ".join(sql_value(x) for kv in safe.items() for x in (kv[0], kv[1].replace("\\", "\\\\"))) + ")")
    # split on '&name;' and look each name up
    bits = F.split(F.regexp_replace(out, "&([a-zA-Z][a-zA-Z0-9]{1,30});", "\u0001$1\u0002"), "\u0001")

    def one(part: Column, i: Column) -> Column:
        name, rest = F.substring_index(part, "\u0002", 1), F.substring_index(part, "\u0002", -1)
        shown = F.when(name.isin(*keep), F.concat(F.lit("&"), name, F.lit(";"))).otherwise(F.coalesce(F.element_at(table, name), F.lit("")))
        return F.when(i == 0, part).otherwise(F.concat(shown, rest))

    return F.array_join(F.transform(bits, one), "")


_WHS_SCHEMA = """category string, danger string, iso_code string, id_number string, unique_number string, latitude string, longitude string,
  name_en string, site string, state string, states string, geolocations struct<poi: array<struct<iso2: string, latitude: string, longitude: string>>>"""


def read_inscriptions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the World Heritage export; none at all is an error."""
    rows = spark.read.format("xml").option("rowTag", "row").option("nullValue", "").schema(_WHS_SCHEMA).load(path)
    if not rows.take(1):
        raise SourceError("unesco-whs: no <row> elements; the layout changed")
    return rows


def per_state_party(rows: DataFrame, iso2: DataFrame) -> DataFrame:
    """One row per inscription and state party, first point per country (P02). ``iso2``: iso2, country."""
    uid = F.coalesce("id_number", "unique_number")
    rows = rows.withColumn("uid", uid)
    poi = rows.select("*", F.posexplode_outer("geolocations.poi").alias("_i", "_p"))
    code = F.lower(F.trim(F.coalesce("_p.iso2", F.lit(""))))
    good = poi.where((F.coalesce("_p.latitude", F.lit("")) != "") & (F.coalesce("_p.longitude", F.lit("")) != "")).withColumn("_iso", code)
    first = W.partitionBy("uid", "_iso").orderBy("_i")
    good = good.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).withColumn("_lat", F.col("_p.latitude")).withColumn("_lon", F.col("_p.longitude"))
    bare = rows.join(good.select("uid").distinct(), "uid", "left_anti").withColumn(
        "_iso", F.lower(F.trim(F.split_part(F.coalesce("iso_code", F.lit("")), F.lit(","), F.lit(1))))).withColumn("_lat", F.col("latitude")).withColumn("_lon", F.col("longitude"))
    both = good.drop("_i", "_p", "_n").unionByName(bare)
    out = _located(both.drop("latitude", "longitude"), F.col("_lat"), F.col("_lon")).join(iso2.select(F.lower("iso2").alias("_iso"), F.col("country").alias("_c")), "_iso", "left")
    return out.select("uid", F.coalesce("site", "name_en").alias("site"), "category", "danger", F.coalesce("_c", "states").alias("states"), "lat", "lon")


@source("unesco-whs", "UNESCO terms, attribution required", "UNESCO World Heritage Centre", True)
def world_heritage(spark: SparkSession, path: str, iso2: DataFrame | None = None) -> DataFrame:
    """Inscriptions; a mixed one is a cultural and a natural asset."""
    rows = read_inscriptions(spark, path)
    if iso2 is not None:
        rows = per_state_party(rows, iso2)
    else:
        rows = _located(rows.withColumn("uid", F.coalesce("id_number", "unique_number")).withColumn("site", F.coalesce("site", "name_en"))
                        .withColumn("states", F.coalesce("states", "state")), F.col("latitude"), F.col("longitude"))
    cat = F.lower(F.trim(F.coalesce("category", F.lit(""))))
    both = F.filter(F.array(F.when(cat.isin("cultural", "mixed"), F.struct(F.lit("whs-c-").alias("p"), F.lit("whs_cultural").alias("t"))),
                            F.when(cat.isin("natural", "mixed"), F.struct(F.lit("whs-n-").alias("p"), F.lit("whs_natural").alias("t")))), lambda x: x.isNotNull())
    rows = rows.withColumn("_a", F.explode(both)).withColumn("uid", F.coalesce("uid", F.lit("")))
    return _assets(rows, asset_id=F.concat("_a.p", "uid"), tier=F.col("_a.t"), name=F.coalesce("site", F.concat(F.lit("WHS "), "uid")),
                   source=F.lit("unesco-whs"), source_url=F.concat(F.lit("https://whc.unesco.org/en/list/"), "uid"),
                   country=F.coalesce("states", F.lit("")), extra=_extra(category=cat, in_danger=F.coalesce("danger", F.lit("")) != ""))


def _point_csv(spark, path, prefix, tier, who, **more) -> DataFrame:
    df = _csv(spark, path)
    rows = _located(df, F.col("lat"), F.col("lon"))
    built = {k: v(df) for k, v in more.items()}
    return _assets(rows, asset_id=F.concat(F.lit(prefix), F.coalesce(_opt(df, "id"), F.lit(""))), tier=F.lit(tier), source=F.lit(who),
                   name=F.coalesce(_opt(df, "name"), F.lit("")), country=F.coalesce(_opt(df, "country"), F.lit("")), **built)


@source("unesco-whs-tentative", "UNESCO terms, attribution required", "UNESCO World Heritage Centre", True)
def tentative_list(spark: SparkSession, path: str) -> DataFrame:
    return _point_csv(spark, path, "whs-t-", "whs_tentative", "unesco-whs-tentative")


@source("unesco-ich", "UNESCO terms, attribution required", "UNESCO Intangible Cultural Heritage", True)
def intangible_heritage(spark: SparkSession, path: str) -> DataFrame:
    """Practices with a region: radius 60 km unless stated."""
    radius = lambda df: F.coalesce(_number(_opt(df, "radius_km")), F.lit(60.0))
    return _point_csv(spark, path, "ich-", "ich_unesco", "unesco-ich", radius_km=lambda df: F.when(radius(df) == 0, 60.0).otherwise(radius(df)),
                      extra=lambda df: _extra(list=_opt(df, "list")))


# ------------------------------------------------------------------ protected land
# IUCN categories that count, and the tier each maps to.
IUCN_TIER = {"IA": "wdpa_iucn_i_ii", "IB": "wdpa_iucn_i_ii", "II": "wdpa_iucn_i_ii", "III": "wdpa_iucn_iii_iv", "IV": "wdpa_iucn_iii_iv"}
MIN_AREA_KM2 = 25.0


def _iucn(c: Column) -> Column:
    return F.replace(F.upper(F.trim(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit(""))


@source("wdpa", "Protected Planet terms, non-commercial by default", "UNEP-WCMC and IUCN, Protected Planet", True)
def protected_areas(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path)
    lat, lon = F.coalesce(_opt(df, "latitude"), _opt(df, "lat")), F.coalesce(_opt(df, "longitude"), _opt(df, "lon"))
    area = F.coalesce(_number(_opt(df, "GIS_AREA")), F.lit(0.0))
    cat = _iucn(_opt(df, "IUCN_CAT"))
    rows = _located(df.withColumn("_t", lookup(IUCN_TIER, cat)).where(F.col("_t").isNotNull() & (area >= MIN_AREA_KM2)), lat, lon)
    return _assets(rows, asset_id=F.concat(F.lit("wdpa-"), F.coalesce(_opt(df, "WDPAID"), F.lit(""))), tier=F.col("_t"),
                   name=F.trim(F.coalesce(_opt(df, "NAME"), F.lit(""))), source=F.lit("wdpa"), country=F.trim(F.coalesce(_opt(df, "ISO3"), F.lit(""))),
                   extra=_extra(iucn=cat, area_km2=area))


@source("ramsar-geopark", "Ramsar / UNESCO terms, attribution required", "Ramsar Sites Information Service; UNESCO Global Geoparks", True)
def wetlands_and_geoparks(spark: SparkSession, path: str) -> DataFrame:
    return _point_csv(spark, path, "rg-", "ramsar_geopark", "ramsar-geopark", extra=lambda df: _extra(kind=_opt(df, "kind")))


def merge_protected(parts: list[DataFrame], iso3: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts of a protected-area export as one table under country names, and unmapped codes with counts."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = rows.where(F.coalesce("WDPAID", F.lit("")) != "").withColumn("_iso", F.upper(F.trim(F.coalesce("ISO3", F.lit("")))))
    named = rows.join(iso3.select(F.upper("iso3").alias("_iso"), F.col("country").alias("_c")), "_iso", "left")
    unmapped = named.where(F.col("_c").isNull()).groupBy(F.col("_iso").alias("iso3")).agg(F.count(F.lit(1)).alias("rows"))
    kept = named.where(F.col("_c").isNotNull()).dropDuplicates(["WDPAID"]).withColumn("ISO3", F.col("_c")).drop("_iso", "_c")
    return kept, unmapped


def clean_centroids(df: DataFrame) -> DataFrame:
    """Usable centroids only: category, area, range, no null island, first code, unique ids."""
    rows = df.withColumn("IUCN_CAT", _iucn(F.col("IUCN_CAT"))).withColumn("GIS_AREA", _number(F.col("GIS_AREA").cast("string")))
    rows = rows.where(F.col("IUCN_CAT").isin(*IUCN_TIER) & (F.col("GIS_AREA") >= MIN_AREA_KM2))
    rows = rows.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0)))
    rows = rows.where(F.coalesce("WDPAID", F.lit("")) != "").withColumn("ISO3", F.trim(F.split_part("ISO3", F.lit(";"), F.lit(1))))
    return rows.withColumn("NAME", F.trim(F.replace("NAME", F.lit("\n"), F.lit(" ")))).dropDuplicates(["WDPAID"])


# ------------------------------------------------------------------ Wikidata
_BINDING = "struct<value: string>"
_BINDINGS = f"results struct<bindings: array<struct<item: {_BINDING}, itemLabel: {_BINDING}, coord: {_BINDING}, sitelinks: {_BINDING}, countryLabel: {_BINDING}, class: {_BINDING}>>>"
# Saved result sets, their tier, id prefix and least number of language links.
WIKIDATA_SETS = {"heritage": ("wikidata_multilingual", "wd-h-", 5), "festival": ("festival", "wd-f-", 3), "pilgrimage": ("pilgrimage_major", "wd-p-", 0)}


def _bindings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BINDINGS).option("multiLine", True).json(path).select(F.explode("results.bindings").alias("b"))


@source("wikidata", "CC0-1.0", "Wikidata contributors", True)
def wikidata(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Saved query results per set."""
    out = None
    for kind, path in paths.items():
        tier, prefix, least = WIKIDATA_SETS[kind]
        lat, lon = text.parse_point(F.col("b.coord.value"))
        rows = _bindings(spark, path).withColumn("lat", lat).withColumn("lon", lon).where(F.col("lat").isNotNull())
        links = F.coalesce(F.col("b.sitelinks.value").try_cast("int"), F.lit(0))
        item = F.col("b.item.value")
        part = _assets(rows.where(links >= least), asset_id=F.concat(F.lit(prefix), text.qid(item)), tier=F.lit(tier), source=F.lit("wikidata"),
                       name=F.coalesce("b.itemLabel.value", text.qid(item)), source_url=item, country=F.coalesce("b.countryLabel.value", F.lit("")),
                       extra=_extra(sitelinks=links))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------------ OSM
_ELEMENTS = "elements array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string,string>>>"


def osm_elements(spark: SparkSession, path: str) -> DataFrame:
    """Saved elements with node or way-centre coordinates."""
    rows = spark.read.schema(_ELEMENTS).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    rows = rows.select("e.type", "e.id", F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), F.col("e.tags").alias("tags"))
    return rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def _tag(name: str) -> Column:
    return F.coalesce(F.try_element_at("tags", F.lit(name)), F.lit(""))


@source("osm", "ODbL-1.0", "OpenStreetMap contributors", False)
def openstreetmap(spark: SparkSession, path: str, country: str = "") -> DataFrame:
    """Tagged elements to heritage, institution, market and craft assets (S08); an element may be several."""
    # The tags and tag values that make an element an asset of a tier.
    rules = {
        "osm_heritage": (_tag("historic") != "") | (_tag("heritage") != "") | _tag("building").rlike("^(cathedral|mosque|temple|castle|palace|synagogue)$"),
        "institution": (_tag("tourism") == "museum") | _tag("amenity").rlike("^(theatre|arts_centre)$"),
        "market": _tag("amenity") == "marketplace",
        "craft_cluster": _tag("craft") != "",
    }
    tiers = F.filter(F.array(*[F.when(r, F.lit(t)) for t, r in rules.items()]), lambda t: t.isNotNull())
    rows = osm_elements(spark, path).withColumn("_t", F.explode(tiers))
    ref = F.concat_ws("/", "type", F.col("id").cast("string"))
    return _assets(rows, asset_id=F.concat(F.lit("osm-"), "type", F.lit("-"), F.col("id").cast("string")), tier=F.col("_t"), name=_tag("name"),
                   source=F.lit("osm"), source_url=F.concat(F.lit("https://www.openstreetmap.org/"), ref), country=F.lit(country))


def lodging_points(spark: SparkSession, path: str) -> DataFrame:
    rows = osm_elements(spark, path)
    # What counts as lodging.
    return rows.where(_tag("tourism").rlike("^(hotel|guest_house|hostel|camp_site|apartment)$")).select("type", "id", "lat", "lon")


# Distinctive tags and the kind and weight each evidences, in order of reading.
TAG_KINDS = {
    "historic": {"castle": ("A2", 0.5), "palace": ("A2", 0.5), "fort": ("A2", 0.5), "fortress": ("A2", 0.5), "city_walls": ("A2", 0.5),
                 "archaeological_site": ("A2", 0.5), "monastery": ("A2", 0.5)},
    "building": {"castle": ("A2", 0.5), "palace": ("A2", 0.5), "cathedral": ("A2", 0.5)},
    "natural": {"beach": ("A3", 0.9), "bay": ("A3", 0.9), "cape": ("A3", 0.7), "peak": ("A4", 0.9), "ridge": ("A4", 0.7), "cliff": ("A4", 0.5),
                "glacier": ("A4", 0.7), "desert": ("A5", 0.95), "dune": ("A5", 0.8), "wetland": ("A7", 0.6), "volcano": ("A8", 0.95),
                "geyser": ("A8", 0.9), "hot_spring": ("A8", 0.9)},
    "water": {"lake": ("A7", 0.85)},
    "waterway": {"waterfall": ("A7", 0.7)},
    "boundary": {"protected_area": ("A9", 0.4), "national_park": ("A9", 0.8)},
    "leisure": {"nature_reserve": ("A9", 0.8)},
}
# Wikidata classes and the kind and weight each evidences.
CLASS_KINDS = {
    "Q23413": ("A2", 0.5), "Q751876": ("A2", 0.5), "Q839954": ("A2", 0.5), "Q16560": ("A2", 0.5), "Q57821": ("A2", 0.5),
    "Q44539": ("A10", 0.6), "Q2977": ("A10", 0.6), "Q8502": ("A4", 0.9), "Q8072": ("A8", 0.95), "Q23397": ("A7", 0.85),
    "Q34038": ("A7", 0.7), "Q170321": ("A7", 0.6), "Q4421": ("A6", 0.8), "Q132453": ("A6", 0.95), "Q8514": ("A5", 0.95),
    "Q25391": ("A5", 0.8), "Q35148": ("A5", 0.7), "Q39816": ("A3", 0.9), "Q40080": ("A3", 0.9), "Q185113": ("A3", 0.7),
    "Q46169": ("A9", 0.8), "Q23442": ("A3", 0.7), "Q45776": ("A3", 0.6), "Q150784": ("A4", 0.5), "Q180874": ("A5", 0.7),
    "Q23552": ("A5", 0.6), "Q43262": ("A9", 0.8), "Q35558": ("A9", 0.3),
}


def kind_from_tags() -> Column:
    """First mapped tag as struct<kind, weight> (P15); pilgrimage and craft come first."""
    def said(kind: str, weight: float) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))

    out = F.when(_tag("pilgrimage") == "yes", said("A10", 0.95)).when(_tag("craft") != "", said("A11", 0.6))
    for key, table in TAG_KINDS.items():
        found = lookup({v: k for v, (k, _) in table.items()}, _tag(key))
        out = out.when(found.isNotNull(), F.struct(found.alias("kind"), lookup({v: w for v, (_, w) in table.items()}, _tag(key)).alias("weight")))
    return out


def osm_kind_points(elements: DataFrame) -> DataFrame:
    """Elements to kind points, each element once (P15, P16): point_id, lat, lon, kind, weight."""
    rows = elements.withColumn("_k", kind_from_tags()).where(F.col("_k").isNotNull()).dropDuplicates(["type", "id"])
    return rows.select(F.concat(F.lit("osm-"), "type", F.lit("-"), F.col("id").cast("string")).alias("point_id"),
                       F.bround("lat", 5).alias("lat"), F.bround("lon", 5).alias("lon"), "_k.kind", "_k.weight")


def wikidata_kind_points(spark: SparkSession, path: str) -> DataFrame:
    """Class harvest to kind points, each item once."""
    cls = text.qid(F.col("b.class.value"))
    lat, lon = text.parse_point(F.col("b.coord.value"))
    rows = _bindings(spark, path).select(text.qid(F.col("b.item.value")).alias("point_id"), lat.alias("lat"), lon.alias("lon"),
                                         lookup({q: k for q, (k, _) in CLASS_KINDS.items()}, cls).alias("kind"),
                                         lookup({q: w for q, (_, w) in CLASS_KINDS.items()}, cls).alias("weight"))
    return rows.where(F.col("kind").isNotNull() & F.col("lat").isNotNull()).dropDuplicates(["point_id"])


def wikidata_points(spark: SparkSession, path: str) -> DataFrame:
    """Feature harvest to points, each item once: point_id, lat, lon."""
    lat, lon = text.parse_point(F.col("b.coord.value"))
    rows = _bindings(spark, path).select(text.qid(F.col("b.item.value")).alias("point_id"), lat.alias("lat"), lon.alias("lon"))
    return rows.where(F.col("lat").isNotNull() & (F.col("point_id") != "")).dropDuplicates(["point_id"])


def merge_by_id(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """New rows replace old ones of the same id."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.dropDuplicates([key]), allowMissingColumns=True)


# ------------------------------------------------------------------ POI Parquet
# Category words in order of precedence.
POI_TIERS = (("museum", "institution"), ("performing arts venue", "institution"), ("theater", "institution"), ("market", "market"),
             ("farmers market", "market"), ("monument", "osm_heritage"), ("historic site", "osm_heritage"))


@source("foursquare-os", "Apache-2.0", "Foursquare OS Places", False)
def poi_parquet(spark: SparkSession, path: str, countries: list[str] | None = None) -> DataFrame:
    """Points of interest; the country list and null tests reach the scan."""
    rows = spark.read.parquet(path).select("fsq_place_id", "name", "latitude", "longitude", "country", "fsq_category_labels")
    rows = rows.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("fsq_category_labels").isNotNull())
    if countries:
        rows = rows.where(F.col("country").isin(*countries))
    category = F.lower(F.get("fsq_category_labels", F.lit(0)))
    tier = F.lit(None).cast("string")
    for word, name in reversed(POI_TIERS):
        tier = F.when(F.contains(category, F.lit(word)), name).otherwise(tier)
    rows = rows.withColumn("_t", tier).where(F.col("_t").isNotNull()).withColumn("lat", F.col("latitude").cast("double")).withColumn("lon", F.col("longitude").cast("double"))
    return _assets(rows, asset_id=F.concat(F.lit("fsq-"), "fsq_place_id"), tier=F.col("_t"), name=F.coalesce("name", F.lit("")),
                   source=F.lit("foursquare-os"), country=F.coalesce("country", F.lit("")), extra=_extra(category=category))


# ------------------------------------------------------------------ cuisine
def cuisine_records(spark: SparkSession, path: str) -> DataFrame:
    """Compiled regions with the list of rules each breaks."""
    df = _csv(spark, path)
    parts = lambda c: F.filter(F.split(F.coalesce(_opt(df, c), F.lit("")), "\\|"), lambda x: x != "")
    raw = F.coalesce(_opt(df, "radius_km"), F.lit(""))
    rows = df.select(
        F.col("id"), *[F.coalesce(_opt(df, c), F.lit("")).alias(c) for c in ("name_en", "name_local", "country", "retrieved")],
        _number(_opt(df, "lat")).alias("lat"), _number(_opt(df, "lon")).alias("lon"),
        F.when(raw == "", 0.0).otherwise(_number(raw)).alias("radius_km"), parts("dishes").alias("dishes"), parts("sources").alias("cited"),
        F.lower(F.trim(F.coalesce(_opt(df, "is_modal"), F.lit("")))).isin("1", "true", "yes").alias("is_modal"))
    unread = F.col("lat").isNull() | F.col("lon").isNull() | F.col("radius_km").isNull()
    rules = [
        F.when(unread, F.lit("a number that can't be read")),
        F.when(F.size("dishes") < 3, F.concat(F.lit("dishes: "), F.size("dishes").cast("string"), F.lit(" of at least 3"))),
        F.when(F.size("cited") < 2, F.concat(F.lit("sources: "), F.size("cited").cast("string"), F.lit(" of at least 2"))),
        F.when(F.col("name_local") == "", "no local name"), F.when(F.col("retrieved") == "", "no date of retrieval"),
        F.when(~((F.col("radius_km") > 0) & (F.col("radius_km") <= 600)), F.concat(F.lit("radius of "), F.col("radius_km").cast("string"), F.lit(" km is out of range"))),
    ]
    return rows.withColumn("problems", F.filter(F.array(*rules), lambda p: p.isNotNull()))


def cuisine_rejects(records: DataFrame) -> DataFrame:
    return records.where(F.size("problems") > 0).select("id", "problems")


@source("cuisine", "Own compilation; per-record attribution", "Compiled from openly licensed sources", False)
def cuisine(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Regions that meet the record standard (S10); strict mode refuses a file with any that does not."""
    records = cuisine_records(spark, path)
    if strict:
        bad = cuisine_rejects(records).take(10)
        if bad:
            raise SourceError("cuisine: records fail the standard: " + "; ".join(f"{r['id']}: {', '.join(r['problems'])}" for r in bad))
    rows = records.where(F.size("problems") == 0)
    return _assets(rows, asset_id=F.concat(F.lit("cuisine-"), "id"), tier=F.lit("cuisine_region"), name=F.coalesce(F.nullif(F.col("name_local"), F.lit("")), F.col("name_en")),
                   source=F.lit("cuisine"), retrieved=F.col("retrieved").try_cast("date"), country=F.col("country"), radius_km=F.col("radius_km"),
                   extra=_extra(dishes=F.array_join("dishes", "|"), sources=F.array_join("cited", "|"), is_modal=F.col("is_modal")))


# ------------------------------------------------------------------ generic layers
@source("tiered-csv", "per layer", "per layer", False)
def tiered_csv(spark: SparkSession, path: str, iso2: DataFrame, tier: str | None = None, prefix: str = "x", source_name: str = "wikidata",
               skip: tuple[str, ...] = ()) -> DataFrame:
    """`qid,tier,lat,lon,[sitelinks|radius_km],iso` with a fixed or per-row tier."""
    df = _csv(spark, path)
    rows = _located(df, F.col("lat"), F.col("lon")).withColumn("_t", F.coalesce(F.nullif(_opt(df, "tier"), F.lit("")), F.lit(tier)))
    rows = rows.where(F.col("_t").isin(*[t for t in TIER_NAMES if t not in skip])).withColumn("_iso", F.lower(F.coalesce(_opt(df, "iso"), F.lit(""))))
    rows = rows.join(iso2.select(F.lower("iso2").alias("_iso"), F.col("country").alias("_c")), "_iso", "left")
    # Entity pages by source.
    page = {"wikidata": "https://www.wikidata.org/entity/", "osm": "https://www.openstreetmap.org/"}.get(source_name)
    return _assets(rows, asset_id=F.concat(F.lit(f"{prefix}-"), "qid"), tier=F.col("_t"), name=F.col("qid"), source=F.lit(source_name),
                   source_url=F.concat(F.lit(page), "qid") if page else F.lit(""), country=F.coalesce("_c", F.lit("")),
                   radius_km=F.coalesce(_number(_opt(df, "radius_km")), F.lit(0.0)), extra=_extra(sitelinks=F.coalesce(_opt(df, "sitelinks").try_cast("int"), F.lit(0))))


def landform_layer(spark: SparkSession, path: str) -> DataFrame:
    """candidate id tail, position and landform tokens: source_id, lat, lon, forms."""
    df = _csv(spark, path)
    forms = F.filter(F.split(F.coalesce(_opt(df, "landforms"), F.lit("")), "\\|"), lambda t: t != "")
    return df.select(F.substring_index(F.coalesce(_opt(df, "candidate_id"), F.lit("")), "-", -1).alias("source_id"), _number(_opt(df, "lat")).alias("lat"),
                     _number(_opt(df, "lon")).alias("lon"), forms.alias("forms")).where(F.size("forms") > 0)


def kind_point_layer(spark: SparkSession, path: str, floor: float = 0.30) -> DataFrame:
    df = _csv(spark, path)
    rows = _located(df, F.col("lat"), F.col("lon")).withColumn("weight", _number(F.col("weight")))
    return rows.where((F.coalesce("kind", F.lit("")) != "") & (F.col("weight") >= floor)).select(F.col("id").alias("point_id"), "lat", "lon", "kind", "weight")


def point_layer(spark: SparkSession, path: str, key: str = "qid") -> DataFrame:
    df = _csv(spark, path)
    lat, lon = F.coalesce(_opt(df, "lat"), _opt(df, "latitude")), F.coalesce(_opt(df, "lon"), _opt(df, "longitude"))
    return _located(df.withColumn("point_id", F.coalesce(_opt(df, key), _opt(df, "WDPAID"), _opt(df, "NAME"), F.lit(""))), lat, lon).select("point_id", "lat", "lon")


def manual_kinds(spark: SparkSession, path: str, floor: float = 0.30) -> DataFrame:
    rows = spark.read.schema("places array<struct<place_id: string, kind: string, weight: double, source: string>>").option("multiLine", True).json(path)
    rows = rows.select(F.explode("places").alias("p")).select("p.*")
    return rows.where((F.coalesce("place_id", F.lit("")) != "") & (F.coalesce("kind", F.lit("")) != "") & (F.col("weight") >= floor))


def harvested_codes(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path).select(F.upper(F.trim("iso")).alias("iso")).where(F.col("iso") != "").distinct()


# ------------------------------------------------------------------ passports, countries, bundles
def passports(spark: SparkSession, path: str) -> DataFrame:
    """Tidy requirement rows with their states."""
    df = _csv(spark, path)
    rows = df.select(F.col("Passport").alias("passport"), F.col("Destination").alias("destination"), text.entry_state(F.col("Requirement")).alias("e"))
    return rows.select("passport", "destination", "e.*")


def country_facts(spark: SparkSession, path: str) -> DataFrame:
    """Country, ISO codes and area; countries without an area drop."""
    df = _csv(spark, path)
    low = {c.strip().lower(): c for c in df.columns}
    get = lambda n: F.trim(F.col(f"`{low[n]}`")) if n in low else F.lit(None).cast("string")
    area = _number(F.coalesce(get("area km2"), get("area_km2")))
    return df.select(get("country").alias("country"), F.coalesce(get("iso"), get("iso2")).alias("iso2"), get("iso3").alias("iso3"), area.alias("area_km2")).where(
        (F.coalesce("country", F.lit("")) != "") & (F.col("area_km2") > 0))


_FEATURE = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"


def published_pins(spark: SparkSession, path: str) -> DataFrame:
    """Pins of a published GeoJSON layer."""
    schema = """features array<struct<properties: struct<id: string, place_id: string, n: string, name: string, c: string, country: string, hole: int,
      on_printed_map: boolean, s: int, a: int, whs: int, t: string, r: string>, geometry: struct<coordinates: array<double>>>>"""
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    p = F.col("f.properties")
    return f.select(F.coalesce(p["id"], p["place_id"]).alias("place_id"), F.coalesce(p["n"], p["name"], F.lit("")).alias("name"),
                    F.coalesce(p["c"], p["country"], F.lit("")).alias("country"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"),
                    F.get("f.geometry.coordinates", F.lit(0)).alias("lon"), p["s"].alias("score"), F.coalesce(p["a"], F.lit(0)).alias("kmask"),
                    F.coalesce(p["whs"], F.lit(0)).alias("whs"), F.nullif(p["t"], F.lit("")).alias("territory_id"), F.nullif(p["r"], F.lit("")).alias("region_id"),
                    (F.coalesce(p["hole"] == 1, F.lit(False)) | F.coalesce(p["on_printed_map"], F.lit(False))).alias("printed"))


def published_registers(spark: SparkSession, path: str) -> DataFrame:
    """Places of published country registers or an app export."""
    schema = """country string, iso3 string, places array<struct<place_id: string, name: string, country: string, lat: double, lon: double, score: int, is_site: boolean,
      archetypes: array<string>, archetype_weights: array<double>, whs: int, sources: array<string>, on_printed_map: boolean, printed_rank: int,
      territory_id: string, region_id: string, disputed: string, merged_from: array<string>, reach: string, best_months: array<int>>>"""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.col("iso3"), F.explode("places").alias("p")).select("iso3", "p.*")


# ------------------------------------------------------------------ polygons
def polygons(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON polygons: properties map, and rings of all parts as array<array<struct<x,y>>>."""
    raw = spark.read.schema(_FEATURE).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    deep = "array<array<array<array<double>>>>"
    kind, body = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    multi = F.when(kind == "MultiPolygon", F.from_json(body, deep)).when(kind == "Polygon", F.from_json(F.concat(F.lit("["), body, F.lit("]")), deep))
    rings = F.transform(F.flatten(multi), lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return raw.select(F.col("f.properties").alias("props"), rings.alias("rings")).where(F.size("rings") > 0)


def _prop(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at("props", F.lit(n))), F.lit("")) for n in names])


def country_outlines(spark: SparkSession, path: str) -> DataFrame:
    """Country outlines with disputed names dissolved into their host by union of rings (S11): poly_id, grp, rings."""
    rows = polygons(spark, path).withColumn("grp", text.canonical_country(_prop("NAME", "ADMIN", "NAME_EN", "name", "country"))).where(F.col("grp").isNotNull())
    merged = rows.groupBy("grp").agg(F.flatten(F.collect_list("rings")).alias("rings"))  # a country's outlines
    return merged.select(F.col("grp").alias("poly_id"), "grp", "rings")


def admin_units(spark: SparkSession, path: str, iso2: DataFrame, iso3: DataFrame) -> DataFrame:
    """Admin-1 polygons keyed by ISO3 then ISO2 (S17): unit_id, name, grp, rings."""
    rows = polygons(spark, path).select(
        "rings", text.canonical_iso3(_prop("adm0_a3", "ADM0_A3")).alias("_a3"), F.lower(_prop("iso_a2", "ISO_A2")).alias("_a2"),
        _prop("adm1_code", "ADM1_CODE").alias("unit_id"), F.coalesce(_prop("name_en", "name", "NAME_EN", "NAME"), F.lit("unnamed")).alias("name"))
    rows = rows.join(iso3.select(F.col("iso3").alias("_a3"), F.col("country").alias("_c3")), "_a3", "left").join(
        iso2.select(F.lower("iso2").alias("_a2"), F.col("country").alias("_c2")), "_a2", "left")
    rows = rows.withColumn("grp", text.canonical_country(F.coalesce("_c3", "_c2"))).where(F.col("grp").isNotNull() & F.col("unit_id").isNotNull())
    return rows.select("unit_id", "name", "grp", "rings")


# ------------------------------------------------------------------ config
def load(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Everything a build configuration names: candidates, assets, countries, provenance."""
    facts = [(n, str(f.get("iso", "")), str(f.get("iso3", "")), float(f["area_km2"])) for n, f in config.get("countries", {}).items()]
    countries = spark.createDataFrame(facts, "country string, iso2 string, iso3 string, area_km2 double")
    cands, assets = [], []
    for name, options in config.get("sources", {}).items():
        src = REGISTRY.get(name)
        if src is None:
            raise SourceError(f"unknown source {name!r}; known: {', '.join(sorted(REGISTRY))}")
        options = dict(options)
        if name == "tiered-csv":
            options.setdefault("iso2", countries)
        (cands if src.gives == "candidates" else assets).append(src.load(spark, **options))
    if not cands:
        raise SourceError("no candidates: at least one settlement source is required")
    union = lambda dfs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    all_cands = union(cands)
    if not all_cands.take(1):
        raise SourceError("no candidates: the settlement sources hold no usable rows")
    all_assets = union(assets) if assets else spark.createDataFrame([], "asset_id string, tier string, name string, source string, source_url string, "
                                                                   "retrieved date, country string, lat double, lon double, radius_km double, extra map<string,string>")
    return all_cands, all_assets, countries, provenance(spark, list(config.get("sources", {})))
