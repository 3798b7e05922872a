"""Model parameters and controlled vocabularies.

Everything here is a fixed value of the place model: changing one changes results.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """Defaults of the place model."""

    delta: float = 0.95
    power: float = 2.0
    beta: float = 0.0
    coherence: float = 0.25
    w_h: float = 0.30
    w_n: float = 0.35
    w_l: float = 0.35
    lam_red: float = 1.0
    quality_relief: float = 0.4
    coverage_decay: float = 0.5
    catchment_km: float = 60.0
    absorb_similarity: float = 0.5
    pin_spacing_km: float = 60.0
    spacing_density_coef: float = 0.35
    hole_budget: int = 3000
    quota_area: float = 2.5
    quota_archetypes: float = 0.6
    quota_global: float = 1.2
    quota_area_ref_km2: float = 50_000.0
    quota_min: int = 1
    quota_max: int = 40
    quota_small_country_floor: int = 6
    small_country_archetypes: int = 6
    score_floor: float = 0.10
    harvest_spacing_coef: float = 0.35
    harvest_min_spacing_km: float = 8.0
    harvest_max_spacing_km: float = 80.0
    harvest_city_pop: float = 50_000.0
    rarity_country_cap: float = 3.0
    close_pair_km: float = 2.0
    suburb_share: float = 0.40
    area_fanout: int = 40
    world_countries: int = 195
    default_area_km2: float = 100_000.0

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


PARAMS = Params()

# Kind codes and their labels.
KINDS = {
    "A1": "Imperial & historic capital",
    "A2": "Living old town / medina",
    "A3": "Coastal & maritime",
    "A4": "High mountain",
    "A5": "Desert & steppe",
    "A6": "Forest & jungle",
    "A7": "Lake & river",
    "A8": "Volcanic & geothermal",
    "A9": "Wildlife & wilderness",
    "A10": "Sacred & pilgrimage",
    "A11": "Rural vernacular & agrarian",
    "A12": "Modern metropolis & industry",
}
KIND_CODES = tuple(KINDS)

# Asset tiers as (tier, pillar, weight, may inform cross-country numbers).
TIERS = (
    ("whs_cultural", "H", 10.0, True),
    ("whs_tentative", "H", 4.0, True),
    ("national_top", "H", 3.0, False),
    ("wikidata_multilingual", "H", 2.0, True),
    ("national_other", "H", 1.0, False),
    ("osm_heritage", "H", 0.3, False),
    ("whs_natural", "N", 10.0, True),
    ("wdpa_iucn_i_ii", "N", 5.0, True),
    ("ramsar_geopark", "N", 3.0, True),
    ("wdpa_iucn_iii_iv", "N", 2.5, True),
    ("ich_unesco", "L", 8.0, True),
    ("pilgrimage_major", "L", 6.0, False),
    ("cuisine_region", "L", 5.0, False),
    ("festival", "L", 3.0, False),
    ("craft_cluster", "L", 3.0, False),
    ("ich_national", "L", 2.0, False),
    ("institution", "L", 2.0, False),
    ("market", "L", 1.0, False),
)
TIER_NAMES = tuple(t[0] for t in TIERS)
TIER_WEIGHT = {t[0]: t[2] for t in TIERS}
TIER_PILLAR = {t[0]: t[1] for t in TIERS}
CROSS_COUNTRY_TIERS = tuple(t[0] for t in TIERS if t[3])

# Global share of each landform.
LANDFORM_SHARE = {
    "coast": 0.35, "river": 0.45, "lake": 0.20, "forest": 0.30, "mountain": 0.18,
    "desert": 0.06, "volcano": 0.03, "geothermal": 0.015, "glacier": 0.025,
    "fjord": 0.012, "canyon": 0.05, "cave": 0.03, "wetland": 0.07, "steppe": 0.08,
    "island": 0.10, "waterfall": 0.04, "saltflat": 0.008, "rainforest": 0.05,
    "tundra": 0.02, "reef": 0.02, "dunes": 0.025, "gorge": 0.04,
}

# Which kinds a landform evidences, and how strongly.
LANDFORM_KINDS = {
    "coast": {"A3": 0.9},
    "island": {"A3": 0.7},
    "fjord": {"A3": 0.6, "A4": 0.6},
    "reef": {"A3": 0.5, "A9": 0.6},
    "mountain": {"A4": 0.9},
    "glacier": {"A4": 0.7, "A9": 0.4},
    "canyon": {"A4": 0.5, "A5": 0.5},
    "gorge": {"A4": 0.5},
    "desert": {"A5": 0.95},
    "dunes": {"A5": 0.8},
    "saltflat": {"A5": 0.7},
    "steppe": {"A5": 0.6, "A9": 0.3},
    "forest": {"A6": 0.8},
    "rainforest": {"A6": 0.95, "A9": 0.6},
    "lake": {"A7": 0.85},
    "river": {"A7": 0.25},
    "waterfall": {"A7": 0.7},
    "wetland": {"A7": 0.6, "A9": 0.6},
    "volcano": {"A8": 0.95},
    "geothermal": {"A8": 0.9},
    "tundra": {"A9": 0.8},
    "cave": {"A9": 0.3, "A6": 0.2},
}

# Which kinds an asset tier evidences, and how strongly.
TIER_KINDS = {
    "whs_cultural": {"A2": 0.5},
    "whs_tentative": {"A2": 0.25},
    "national_top": {"A2": 0.35},
    "whs_natural": {"A9": 0.6},
    "wdpa_iucn_i_ii": {"A9": 0.8},
    "wdpa_iucn_iii_iv": {"A9": 0.4},
    "ramsar_geopark": {"A9": 0.5, "A7": 0.3},
    "pilgrimage_major": {"A10": 0.95},
    "ich_unesco": {"A11": 0.4},
    "ich_national": {"A11": 0.3},
    "craft_cluster": {"A11": 0.6},
    "market": {"A2": 0.25},
    "festival": {"A11": 0.2},
}

# Kinds implied by a source a published place already carries.
SOURCE_KINDS = {
    "unesco-whs": {"A2": 0.5},
    "wdpa": {"A9": 0.4},
    "ramsar-geopark": {"A9": 0.5, "A7": 0.3},
}

# Kind thresholds.
KIND_FLOOR = 0.30
KIND_LIMIT = 4
KIND_DOMINANT = 0.45
DOMINANT_LIMIT = 3
METROPOLIS_HEADS = 1_000_000.0
VILLAGE_HEADS = 50_000.0
QUARTER_COHERENCE = 0.6
RELIEF_FLOOR_M = 1500.0

# Feasibility.
REACH_FACTOR = {"near": 1.0, "mid": 0.9, "far": 0.7, "remote": 0.5}
REACH_HOURS = ((3.0, "near"), (8.0, "mid"), (24.0, "far"))
PROFILE_KEYS = ("language", "religion", "vernacular", "cuisine")

# Provenance that keeps a record from counting as harvest-only.
PROTECTED_TIERS = (
    "whs_cultural", "whs_natural", "whs_tentative",
    "wdpa_iucn_i_ii", "wdpa_iucn_iii_iv", "ramsar_geopark", "ich_unesco",
)
PROTECTED_SOURCES = ("unesco-whs", "wdpa", "ramsar-geopark")

# City radius by head count, largest step first.
CITY_RADIUS = ((1_000_000.0, 18.0), (500_000.0, 14.0), (250_000.0, 12.0), (50_000.0, 8.0))
CITY_RADIUS_MIN = 5.0
CITY_RADIUS_MAX = 18.0

# Disputed territories. Labels dissolve into the administering state.
DISSOLVE_LABELS = {
    "W. Sahara": "Morocco",
    "Western Sahara": "Morocco",
    "Sahrawi": "Morocco",
    "Sahrawi Arab Democratic Republic": "Morocco",
    "ESH": "Morocco",
    "EH": "Morocco",
}
DISSOLVE_ISO3 = {"ESH": "MAR", "EH": "MAR", "SAH": "MAR"}
UNRULED_LABELS = {
    "kosovo": "Kosovo", "xkx": "Kosovo",
    "taiwan": "Taiwan", "twn": "Taiwan",
    "palestine": "Palestine", "palestinian territory": "Palestine", "pse": "Palestine",
    "n. cyprus": "N. Cyprus", "northern cyprus": "N. Cyprus",
    "somaliland": "Somaliland", "crimea": "Crimea", "kashmir": "Kashmir",
}

# Entry requirement wording to traveller state.
ENTRY_STATES = {
    "visa free": "vf", "visa on arrival": "voa", "e-visa": "ev", "eta": "ev",
    "visa required": "vr", "no admission": "na", "-1": "home",
}
ENTRY_SUBTYPES = {"eta": "eta", "e-visa": "e-visa"}

# Printed map and land arithmetic.
EQUATOR_KM = 40_075.017
EARTH_KM = 6371.0088
CLIENT_EARTH_KM = 6371.0
KM_PER_DEG = 111.32
PIN_SPACING_MM = 4.5
MIN_TILE_MM = 12.0
CUT_MM = 12.0
CUT_MIN_MM = 6.0
MAP_ASPECT = 2.05
REGION_TOLERANCE = 0.02
SMALL_LAND_DEG2 = 0.5
SMALL_LAND_TOLERANCE = 0.08
COAST_BUFFER_DEG = 0.02
SNAP_KM = 50.0
TILE_MIN_PLACES = 3
TILE_MAX_PLACES = 6
LEVEL_WIDTHS = (2000, 1400, 1000, 700)
ABSORB_KM2 = 6_000.0
MIN_GREY_KM2 = 12_000.0
MAX_GREY_KM2 = 700_000.0


def sql_value(x) -> str:
    """A Python value as SQL text."""
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return f"{x!r}D"
    return "'" + x.replace("'", "\\'") + "'" if isinstance(x, str) else str(x)


def lookup(table: dict, key: Column, default=None) -> Column:
    """A small fixed table as a literal map lookup; missing keys give ``default``."""
    found = F.element_at(F.expr("map(" + ", ".join(sql_value(x) for kv in table.items() for x in kv) + ")"), key)
    return found if default is None else F.coalesce(found, F.lit(default))
