"""Enriching published places with kinds from real layers; nothing is invented.

Places carry ``place_id, name, country, lat, lon, kinds, sources``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.functions import geo, kinds
from placekit.functions.vocab import KIND_CODES, KIND_FLOOR
from placekit.operators import spatial
from placekit.operators.classify import from_sources, qualifying_landforms
from placekit.plans.session import cut

CAPITAL_KM = 15.0
FEATURE_KM = 60.0


@dataclass
class Layers:
    """Signal inputs; any may be missing."""

    landforms: DataFrame | None = None        # source_id, lat, lon, forms
    capitals: DataFrame | None = None         # point_id, lat, lon
    volcanoes: DataFrame | None = None
    geothermal: DataFrame | None = None
    forests: DataFrame | None = None
    protected: DataFrame | None = None
    harvest: DataFrame | None = None          # point_id, lat, lon, kind, weight
    manual: DataFrame | None = None           # place_id, kind, weight


def points_to_nearest(places: DataFrame, points: DataFrame, km: float) -> DataFrame:
    """Each point marks only its nearest place in range (J05): point_id, place_id, km."""
    right = spatial.as_right(places.select("place_id", "lat", "lon"))
    return spatial.nearest(points.select("point_id", "lat", "lon"), right, km, "point_id", "place_id")


def marked(places: DataFrame, points: DataFrame | None, km: float, flag: str) -> DataFrame:
    """Places holding at least one point, with ``flag`` true elsewhere false."""
    if points is None:
        return places.withColumn(flag, F.lit(False))
    hit = points_to_nearest(places, points, km).select("place_id").distinct().withColumn(flag, F.lit(True))
    return places.join(hit, "place_id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def kind_points_vector(rows: DataFrame, key: str) -> DataFrame:
    """Strongest weight per (key, kind) as a vector."""
    cells = ", ".join(f"coalesce(max(if(kind = '{c}', weight, null)), 0.0D)" for c in KIND_CODES)
    return rows.where(F.col("weight") >= KIND_FLOOR).groupBy(key).agg(F.expr(f"array({cells})").alias("vec"))


def harvest_kinds(places: DataFrame, points: DataFrame, km: float = FEATURE_KM) -> DataFrame:
    """Harvest kinds bound to the nearest place only (A30): place_id, vec."""
    strong = points.where(F.col("weight") >= KIND_FLOOR)
    near = points_to_nearest(places, strong, km).join(strong.select("point_id", "kind", "weight"), "point_id")
    return kind_points_vector(near, "place_id")


def nearest_qualifying(places: DataFrame, landforms: DataFrame, km: float = FEATURE_KM) -> DataFrame:
    """Nearest landform row whose kinds clear the floor (J06): place_id, near_vec."""
    rows = landforms.withColumn("near_vec", qualifying_landforms("forms")).where(kinds.any_kind(F.col("near_vec")))
    right = spatial.as_right(rows.select("source_id", "lat", "lon"))
    near = spatial.nearest(places.select("place_id", "lat", "lon"), right, km, "place_id", "source_id")
    return near.join(rows.select("source_id", "near_vec").dropDuplicates(["source_id"]), "source_id").select("place_id", "near_vec")


def apply_signals(places: DataFrame, layers: Layers) -> DataFrame:
    """Ordered enrichment (A31): adds ``historic_capital`` and one ``via_*`` flag per stage.

    Layers are joined once, then merged per row in order. Landform points and harvest only
    fill places that are still empty; a manual kind only fills what nothing else did.
    """
    out = places
    if layers.landforms is not None:
        by_id = layers.landforms.select(F.col("source_id").alias("_sid"), qualifying_landforms("forms").alias("_id_vec")).dropDuplicates(["_sid"])
        out = out.withColumn("_sid", geo.geoname_tail(F.col("place_id"))).join(by_id, "_sid", "left").drop("_sid")
        empty = out.where(~kinds.any_kind(F.col("kinds")) & ~F.coalesce(kinds.any_kind(F.col("_id_vec")), F.lit(False)))
        out = out.join(nearest_qualifying(empty, layers.landforms), "place_id", "left")
    else:
        out = out.withColumn("_id_vec", kinds.zero()).withColumn("near_vec", kinds.zero())
    for flag, points, km in (
        ("via_capital", layers.capitals, CAPITAL_KM), ("via_volcano", layers.volcanoes, FEATURE_KM),
        ("via_geothermal", layers.geothermal, FEATURE_KM), ("via_forest", layers.forests, FEATURE_KM),
        ("via_protected", layers.protected, FEATURE_KM),
    ):
        out = marked(out, points, km, flag)
    for name, vec in (("_harvest", None if layers.harvest is None else harvest_kinds(places, layers.harvest)),
                      ("_manual", None if layers.manual is None else kind_points_vector(layers.manual, "place_id"))):
        if vec is None:
            out = out.withColumn(name, kinds.zero())
        else:
            out = out.join(vec.withColumnRenamed("vec", name), "place_id", "left").withColumn(name, F.coalesce(name, kinds.zero()))
    out = cut(out)

    vec = "kinds"
    for flag, extra, only_empty in (
        ("via_landform_id", F.coalesce("_id_vec", kinds.zero()), False),
        ("via_landform_near", F.coalesce("near_vec", kinds.zero()), True),
        ("via_capital", kinds.fixed({"A1": 0.9}), False), ("via_volcano", kinds.fixed({"A8": 0.95}), False),
        ("via_geothermal", kinds.fixed({"A8": 0.9}), False), ("via_forest", kinds.fixed({"A6": 0.8}), False),
        ("via_protected", kinds.fixed({"A9": 0.4}), False),
        ("via_harvest", F.col("_harvest"), True), ("via_manual", F.col("_manual"), True),
    ):
        when = F.col(flag) if flag in out.columns else kinds.any_kind(extra)
        if only_empty:
            when = when & ~kinds.any_kind(F.col(vec))
        out = out.withColumn(flag, when).withColumn(vec, F.when(F.col(flag), kinds.merge(F.col(vec), extra)).otherwise(F.col(vec)))
    said = from_sources("sources")
    out = out.withColumn(vec, F.when(kinds.any_kind(said), kinds.merge(F.col(vec), said)).otherwise(F.col(vec)))
    out = out.withColumn("kinds", F.transform("kinds", lambda w: F.bround(w, 2))).withColumn("historic_capital", F.col("via_capital"))
    return out.drop("_id_vec", "near_vec", "_harvest", "_manual")


def omit_dummy(places: DataFrame) -> DataFrame:
    """Reach and months are computed or absent, never a placeholder."""
    out = places
    for c, t in (("reach", "string"), ("best_months", "array<int>")):
        out = out.withColumn(c, F.lit(None).cast(t))
    return out


def signal_stats(enriched: DataFrame) -> DataFrame:
    """How many places each stage touched, and how many stay empty."""
    flags = [c for c in enriched.columns if c.startswith("via_")]
    return enriched.agg(*[F.count(F.when(F.col(c), 1)).alias(c[4:]) for c in flags],
                        F.count(F.when(~kinds.any_kind(F.col("kinds")), 1)).alias("still_empty"))


def fill_preview(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What enrichment would fill (A33): filled places per kind, and still-empty places per country."""
    empty = before.where(~kinds.any_kind(F.col("kinds"))).select("place_id")
    now = after.join(empty, "place_id", "left_semi")
    filled = now.select(F.explode(kinds.names(F.col("kinds"))).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("places"))
    still = now.where(~kinds.any_kind(F.col("kinds"))).groupBy("country").agg(F.count(F.lit(1)).alias("places"))
    return filled, still


def livability(countries: DataFrame, harvested: DataFrame) -> DataFrame:
    """Countries the harvest reached are scored, the rest unscored."""
    reached = harvested.select(F.upper(F.trim("iso")).alias("_iso")).where(F.col("_iso") != "").distinct().withColumn("_hit", F.lit(True))
    out = countries.withColumn("_iso", F.upper(F.trim(F.coalesce("iso2", F.lit(""))))).join(reached, "_iso", "left")
    return out.withColumn("livability", F.when(F.col("_hit"), "scored").otherwise("unscored")).drop("_iso", "_hit")
