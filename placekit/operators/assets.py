"""Attaching assets to candidates by distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.functions import kinds
from placekit.functions.vocab import KM_PER_DEG, PARAMS, TIER_PILLAR, Params, lookup
from placekit.operators import spatial


def split_point_and_area(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets with a radius of their own are areas; the rest are points."""
    radius = F.coalesce(F.col("radius_km"), F.lit(0.0))
    return assets.where(radius <= 0), assets.where(radius > 0)


def _sites(cands: DataFrame) -> DataFrame:
    return spatial.as_right(cands.select("candidate_id", "lat", "lon"))


def assign(cands: DataFrame, assets: DataFrame, km: float = PARAMS.catchment_km) -> DataFrame:
    """Each asset to exactly one candidate, its nearest within the catchment.

    Returns the asset columns plus ``candidate_id, km``.
    """
    pairs = spatial.nearest(assets.select("asset_id", "lat", "lon"), _sites(cands), km,
                            "asset_id", "candidate_id")
    return assets.join(pairs, "asset_id")


def orphans(assets: DataFrame, assigned: DataFrame) -> DataFrame:
    """Assets outside every catchment."""
    return assets.join(assigned.select("asset_id"), "asset_id", "left_anti")


def fan_out(cands: DataFrame, areas: DataFrame, limit: int = PARAMS.area_fanout) -> DataFrame:
    """Area assets reach the nearest ``limit`` candidates inside their own radius."""
    rest = tuple(c for c in areas.columns if c not in ("asset_id", "lat", "lon", "radius_km"))
    places = areas.withColumns({"_lat": F.col("lat"), "_lon": F.col("lon"), "_radius_km": F.col("radius_km")})
    pairs = spatial.nearest_k(places, _sites(cands), limit, "radius_km", "asset_id", "candidate_id",
                              keep=("_lat", "_lon", "_radius_km", *rest))
    return pairs.withColumnsRenamed({"_lat": "lat", "_lon": "lon", "_radius_km": "radius_km"})


def tier_table(*attached: DataFrame) -> DataFrame:
    """Tier counts and sources per candidate: partial sums per map task, one shuffle."""
    rows = None
    for df in attached:
        part = df.select("candidate_id", "tier", "source")
        rows = part if rows is None else rows.unionByName(part)
    # a candidate has few different (tier, source), so only those travel
    rows = rows.groupBy("candidate_id", "tier", "source").agg(F.count(F.lit(1)).alias("_n"))
    return rows.groupBy("candidate_id").agg(
        kinds.tier_counts("tier", "_n").alias("tiers"),
        F.array_sort(F.collect_set("source")).alias("asset_sources"))


def attach(cands: DataFrame, *attached: DataFrame) -> DataFrame:
    """Add attached tier counts and sources onto candidates that may already hold some."""
    table = tier_table(*attached).withColumnRenamed("tiers", "_more")
    out = cands.join(table, "candidate_id", "left")
    return (out.withColumn("tiers", kinds.add_tiers(F.col("tiers"), F.coalesce("_more", kinds.no_tiers())))
            .withColumn("sources", F.array_sort(F.array_union(
                F.col("sources"), F.coalesce("asset_sources", F.array().cast("array<string>")))))
            .drop("_more", "asset_sources"))


def coherence(assigned: DataFrame) -> DataFrame:
    """Share of a candidate's heritage points in its fullest ~1 km cell.

    One point gives 1.0; candidates with none are absent (their coherence is 0).
    """
    deg = 1.0 / KM_PER_DEG
    heritage = assigned.where(lookup(TIER_PILLAR, F.col("tier")) == "H")
    cells = (heritage.groupBy("candidate_id", (F.col("lat") / deg).cast("int").alias("gy"),
                              (F.col("lon") / deg).cast("int").alias("gx"))
             .agg(F.count(F.lit(1)).alias("n")))
    return cells.groupBy("candidate_id").agg((F.max("n") / F.sum("n")).alias("coherence"))
