"""Geodesy, grid cells and printed-map arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placekit.functions.vocab import (
    EARTH_KM, EQUATOR_KM, KM_PER_DEG, MAP_ASPECT, MIN_TILE_MM, PARAMS, PIN_SPACING_MM, Params,
)

_HALF = 1 << 15


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    """Great-circle kilometres (P12); the root is clamped so antipodes do not give NaN.

    Arguments are column names or columns.
    """
    if all(isinstance(c, str) for c in (lat1, lon1, lat2, lon2)):
        sp = f"sin((radians({lat2}) - radians({lat1})) / 2)"
        sl = f"sin(radians({lon2} - {lon1}) / 2)"
        return F.expr(f"{2 * radius}D * asin(least(1.0D, sqrt({sp} * {sp} + cos(radians({lat1})) * cos(radians({lat2})) * {sl} * {sl})))")
    lat1, lon1, lat2, lon2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2))
    p1, p2 = F.radians(lat1), F.radians(lat2)
    sp = F.sin((p2 - p1) / 2)
    sl = F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(sp * sp + F.cos(p1) * F.cos(p2) * sl * sl)))


# Cube helpers take column names or SQL text, because they run inside every distance join.
def xyz(lat: str, lon: str) -> tuple[str, str, str]:
    """Position on the sphere in kilometres from the centre, as SQL text.

    Chord length never exceeds arc length, so cubes of this space find every neighbour
    within an arc radius with no special case at the poles or at 180 degrees.
    """
    p, l = f"radians({lat})", f"radians({lon})"
    return (f"({EARTH_KM}D * cos({p}) * cos({l}))", f"({EARTH_KM}D * cos({p}) * sin({l}))", f"({EARTH_KM}D * sin({p}))")


def cube_class(km) -> str:
    """Smallest power-of-two class whose cube edge is at least twice the radius, as SQL text."""
    return f"greatest(-2, cast(ceil(log2(2.0D * {number(km)})) as int))"


def number(km) -> str:
    """A number or column as SQL text."""
    return f"{float(km)!r}D" if isinstance(km, (int, float)) else f"({km})"


def cube_key(cls, ix: str, iy: str, iz: str) -> str:
    """One bigint per cube: class and three 16-bit slab numbers."""
    def part(c: str, bits: int) -> str:
        return f"shiftleft(cast(({c}) + {_HALF} as bigint), {bits})"

    return f"(shiftleft(cast(({cls}) + 8 as bigint), 48) + {part(ix, 32)} + {part(iy, 16)} + {part(iz, 0)})"


def cube_at(lat: str, lon: str, cls, shift: float = 0.0) -> str:
    """The cube of class ``cls`` holding a point, of cubes moved by a share of their edge."""
    return cube_key(cls, *(f"floor({v} / pow(2.0D, {cls}) + {shift!r}D)" for v in xyz(lat, lon)))


def chord(km) -> str:
    """Chord length of an arc."""
    return f"({2 * EARTH_KM}D * sin(least({number(km)} / {2 * EARTH_KM}D, 1.5707963267948966D)))"


def tick(km: Column) -> Column:
    """Distance to the millimetre, so equal distances tie the same way everywhere."""
    return F.rint(km * 1e6) / 1e6


# ---------------------------------------------------------------- printed map (P25)
def map_scale(width_m: Column) -> dict[str, Column]:
    """Height, scale denominator and the kilometre sizes a map width implies."""
    per_mm = EQUATOR_KM / (width_m * 1000.0)
    return {
        "height_m": width_m / MAP_ASPECT,
        "scale_denominator": EQUATOR_KM * 1000.0 / width_m,
        "km_per_mm": per_mm,
        "min_place_separation_km": PIN_SPACING_MM * per_mm,
        "min_tile_extent_km": MIN_TILE_MM * per_mm,
    }


def width_for_separation(km: Column) -> Column:
    return PIN_SPACING_MM * EQUATOR_KM / (km * 1000.0)


def inset_factor(km: Column, width_m: float = 3.0) -> Column:
    return F.greatest(F.lit(1.0), width_for_separation(km) / width_m)


def min_spacing(area_km2: Column, n: Column, p: Params = PARAMS) -> Column:
    return F.greatest(F.lit(p.pin_spacing_km),
                      p.spacing_density_coef * F.sqrt(area_km2 / F.greatest(n, F.lit(1))))


def harvest_target(area_km2: Column, n_kinds: Column) -> Column:
    area = F.greatest(area_km2, F.lit(1.0))
    return F.greatest(n_kinds, F.lit(1)) * (8.0 + 4.0 * F.log(1.0 + area / 50_000.0))


def harvest_spacing(area_km2: Column, n_kinds: Column, p: Params = PARAMS) -> Column:
    target = F.greatest(harvest_target(area_km2, n_kinds), F.lit(1.0))
    spread = F.sqrt(F.greatest(area_km2, F.lit(1.0)) / target)
    return F.greatest(F.lit(p.harvest_min_spacing_km), p.harvest_spacing_coef * spread)


# ---------------------------------------------------------------- ids and names
def iso3_id(iso3: Column, kind: str, index: Column) -> Column:
    """`MAR-R01`; anything but a three-letter code is an error."""
    if kind not in ("R", "T", "G"):
        raise ValueError(f"kind must be R, T or G, not {kind!r}")
    code = F.upper(F.trim(iso3))
    number = F.when(index < 100, F.lpad(index.cast("string"), 2, "0")).otherwise(index.cast("string"))
    return F.when(code.rlike("^[A-Z]{3}$"), F.concat(code, F.lit(f"-{kind}"), number)).otherwise(
        F.raise_error(F.concat(F.lit("ids need a 3-letter ISO3, not "), F.coalesce(iso3, F.lit("null")))))


def place_id(iso3: Column, candidate_id: Column) -> Column:
    """Country code plus the last eight alphanumerics of the candidate id."""
    tail = F.regexp_replace(candidate_id, "[^\\p{L}\\p{N}]", "")
    return F.concat(F.upper(iso3), F.lit("-"), F.substring(tail, F.greatest(F.length(tail) - 7, F.lit(1)), F.lit(8)))


def geoname_tail(pid: Column) -> Column:
    """Numeric source id inside a place id: one leading letter before digits is dropped (P20)."""
    tail = F.regexp_replace(pid, "^[^-]*-", "")
    return F.when(tail.rlike("^\\p{L}\\d+$"), F.substring(tail, F.lit(2), F.length(tail))).otherwise(tail)


def compass(dlon: Column, dlat: Column, country: Column) -> Column:
    """Eight-wind qualifier of a position seen from the country's centre."""
    deg = F.degrees(F.atan2(dlon, dlat))
    angle = F.when(deg < 0, deg + 360.0).otherwise(deg)
    winds = ((22.5, "Northern"), (67.5, "North-eastern"), (112.5, "Eastern"),
             (157.5, "South-eastern"), (202.5, "Southern"), (247.5, "South-western"),
             (292.5, "Western"), (337.5, "North-western"))
    wind = F.lit("Northern")
    for limit, word in reversed(winds):
        wind = F.when(angle <= limit, word).otherwise(wind)
    still = (F.abs(dlat) < 1e-9) & (F.abs(dlon) < 1e-9)
    return F.when(still, country).otherwise(F.concat(wind, F.lit(" "), country))


def extent_km(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Longer side of a lon/lat box in kilometres."""
    mid = F.radians((y0 + y1) / 2)
    return F.greatest((x1 - x0) * KM_PER_DEG * F.cos(mid), (y1 - y0) * KM_PER_DEG)
