"""Whole-pipeline jobs: build, repair, export, publish.

Stages that do not commute are kept apart by cutting lineage after each one; a stage that is
lost is recomputed from the table before it, not from the sources.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placekit.functions import geo, kinds
from placekit.functions.vocab import PARAMS, SNAP_KM, TIER_WEIGHT, Params, lookup
from placekit.operators import assets as att
from placekit.operators import classify, identity, land, resolve, scoring, selection, serve, signals
from placekit.plans.session import cut
from placekit.sources import sinks


@dataclass
class BuildResult:
    places: DataFrame
    scored: DataFrame
    quotas: DataFrame
    log: DataFrame
    conflicts: DataFrame
    stats: DataFrame


def attach_stage(cands: DataFrame, assets: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Assets to candidates, orphans to sites, light orphans again, areas last."""
    cands, assets = cut(resolve.complete(cands)), cut(assets)
    point, area = att.split_point_and_area(assets)
    first = cut(att.assign(cands, point, p.catchment_km))
    lost = cut(att.orphans(point, first))
    sites, _ = resolve.orphan_sites(lost, p)
    everyone = cut(att.attach(cands, first).unionByName(sites))
    light = lost.where(lookup(TIER_WEIGHT, F.col("tier")) < 4.0)
    again = att.assign(everyone, light, p.catchment_km)
    return cut(att.attach(everyone, again, att.fan_out(everyone, area, p.area_fanout)))


def resolve_stage(cands: DataFrame, countries: DataFrame, p: Params = PARAMS, sites: bool = True) -> tuple[DataFrame, DataFrame]:
    """Spellings, suburbs, sites, near duplicates, density: in this order, with one log."""
    logs = []
    for step in ("spellings", "suburbs", "sites", "near", "density"):
        if step == "spellings":
            got = resolve.merge_transliterations(cands, p)
        elif step == "suburbs":
            got = resolve.agglomerate(cands, p)
        elif step == "sites":
            if not sites:
                continue
            # absorption compares kinds, so they are derived first
            cands = cut(classify.derive(cands, keep_existing=True))
            got = resolve.absorb_sites(cands, p)
        elif step == "near":
            got = resolve.absorb_near_duplicates(cands, p)
        else:
            got = resolve.cap_density(cands, countries, p)
        cands = cut(got.kept)
        logs.append(cut(got.log))
    log = logs[0]
    for more in logs[1:]:
        log = log.unionByName(more)
    return cands, log


def build(cands: DataFrame, assets: DataFrame, countries: DataFrame, p: Params = PARAMS) -> BuildResult:
    """Candidates, assets and country facts to places.

    ``countries``: country, iso3, area_km2.
    """
    attached = attach_stage(cands, assets, p)
    merged, log = resolve_stage(attached, countries, p)
    scored = cut(scoring.score(classify.derive(merged), p))
    quotas = cut(scoring.quotas(scoring.country_facts(scored, countries, p), p))
    kept = cut(scoring.above_floor(scored, p))
    picks = cut(selection.select_coverage(kept, quotas, p))
    conflicts = cut(selection.spacing_conflicts(kept, quotas, p))
    places = cut(assemble(kept, picks, quotas, log))
    return BuildResult(places, scored, quotas, log, conflicts, country_stats(scored, places, quotas, conflicts, kept))


def assemble(kept: DataFrame, picks: DataFrame, quotas: DataFrame, log: DataFrame) -> DataFrame:
    """Place rows (A15): ids, dominant kinds, printed rank, lineage count."""
    chosen = picks.select("candidate_id", F.col("pick").alias("printed_rank"))
    lineage = resolve.moved_ids(log, kept).groupBy(F.col("new_id").alias("candidate_id")).agg(F.count(F.lit(1)).alias("merged"))
    out = (kept.join(chosen, "candidate_id", "left").join(lineage, "candidate_id", "left")
           .join(quotas.select("country", "iso3"), "country", "left"))
    code = F.coalesce("iso3", F.upper(F.substring(F.regexp_replace("country", "[^A-Za-z0-9]", ""), 1, 3)))
    top = kinds.dominant(F.col("kinds"))
    tiers = F.col("tiers")
    return out.select(
        geo.place_id(code, F.col("candidate_id")).alias("place_id"), "candidate_id", "name", "country", code.alias("iso3"), "lat", "lon", "is_site",
        F.col("score100").alias("score"), top.alias("archetypes"),
        F.transform(top, lambda c: F.element_at("kinds", F.array_position(kinds.codes(), c).cast("int"))).alias("archetype_weights"),
        kinds.mask_of(top).alias("kmask"), "kinds",
        (kinds.tier(tiers, "whs_cultural") + kinds.tier(tiers, "whs_natural")).cast("int").alias("whs"), "reach",
        F.col("printed_rank").isNotNull().alias("on_printed_map"), F.col("printed_rank").isNotNull().alias("printed"), "printed_rank",
        "sources", F.coalesce("merged", F.lit(0)).alias("merged"), "population", "tiers", "historic_capital", "h", "n", "liv")


def country_stats(scored: DataFrame, places: DataFrame, quotas: DataFrame, conflicts: DataFrame, kept: DataFrame) -> DataFrame:
    """Evidence per country (A16): matched by id, not by name."""
    chosen = kept.join(places.where("on_printed_map").select("candidate_id"), "candidate_id", "left_semi")
    pairs = selection.pair_stats(chosen).select("country", "redundancy", "closest_km")
    counts = places.groupBy("country").agg(F.count(F.lit(1)).alias("in_app"), F.count(F.when(F.col("on_printed_map"), 1)).alias("on_printed_map"))
    clash = conflicts.groupBy("country").agg(F.count(F.lit(1)).alias("spacing_conflicts"))
    zero = F.lit(0).cast("bigint")
    return (scored.groupBy("country").agg(F.count(F.lit(1)).alias("candidates")).join(counts, "country", "left")
            .join(quotas.select("country", "quota"), "country", "left").join(pairs, "country", "left").join(clash, "country", "left")
            .select("country", "candidates", F.coalesce("in_app", zero).alias("in_app"), F.coalesce("on_printed_map", zero).alias("on_printed_map"),
                    "quota", F.bround("redundancy", 3).alias("redundancy"), F.bround("closest_km", 1).alias("closest_km"),
                    F.coalesce("spacing_conflicts", zero).alias("spacing_conflicts")))


def write_build(result: BuildResult, path: str) -> None:
    """Every table of a build."""
    sinks.write_places(sinks.thin(result.places), f"{path}/places")
    sinks.write_printed(result.places, result.quotas, result.conflicts, f"{path}/printed")
    sinks.write_report(result.stats, result.log, result.conflicts, f"{path}/report")


# ------------------------------------------------------------------ repairs
def repair_candidates(places: DataFrame, countries: DataFrame, p: Params = PARAMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolution steps over published places (B02): places, moved ids, log.

    ``places`` are place rows with kinds and population. Folded records hand their printed and
    World Heritage flags to their host.
    """
    cands = cut(resolve.complete(places.drop("candidate_id").withColumnRenamed("place_id", "candidate_id").drop("tiers")))
    kept, log = resolve_stage(cands, countries, p, sites=False)
    moved = cut(resolve.moved_ids(log, kept))
    flagged = identity.host_flags(places, moved)
    new = kept.select(F.col("candidate_id").alias("place_id"), F.col("kinds").alias("_k"), F.col("sources").alias("_s"), F.col("population").alias("_p"))
    out = flagged.join(new, "place_id").withColumn("kinds", F.col("_k")).withColumn("sources", F.col("_s")).withColumn("population", F.col("_p"))
    out = out.drop("_k", "_s", "_p").withColumn("kmask", kinds.mask(F.col("kinds")))
    return cut(out), moved, log


def repair_signals(places: DataFrame, layers: signals.Layers) -> tuple[DataFrame, DataFrame]:
    """Enrich kinds and drop placeholder metadata (B03): places and stage counters."""
    out = cut(signals.omit_dummy(signals.apply_signals(places, layers)))
    stats = signals.signal_stats(out)
    flags = [c for c in out.columns if c.startswith("via_")]
    return out.drop(*flags).withColumn("kmask", kinds.mask(F.col("kinds"))), stats


def repair_geography(places: DataFrame, tiles: DataFrame, admin: DataFrame, land_cells: DataFrame, iso3: DataFrame, q: float) -> dict[str, DataFrame]:
    """Dissolve disputed labels, tessellate land, give every place a region."""
    land_cells, admin = cut(land.dissolve(land_cells)), cut(land.dissolve(admin))
    named = land.flag_disputed(places)
    regions = cut(land.regions(admin, land_cells, iso3))
    at = land.place_in_cells(named.withColumn("grp", F.col("country")), regions, q, "region_id")
    return {"places": named.drop("region_id").join(at, "place_id", "left"), "regions": regions, "tiles": land.relabel_territories(tiles),
            "coverage": land.coverage_gap(land_cells, regions, q)}


# ------------------------------------------------------------------ export and publish
def assign_tiles(places: DataFrame, tile_edges: DataFrame, cap_km: float = SNAP_KM) -> DataFrame:
    """Tile of every place: inside, else the nearest of its country within the snap distance."""
    pts = places.select(F.col("place_id").alias("point_id"), F.col("country").alias("grp"), "lat", "lon")
    at = land.assign_to_polygons(pts, tile_edges, cap_km).select(F.col("point_id").alias("place_id"), F.col("poly_id").alias("territory_id"))
    return places.drop("territory_id").join(at, "place_id", "left")


def export_bundle(places: DataFrame, tile_edges: DataFrame, territories: DataFrame, previous: DataFrame | None = None,
                  mapping: DataFrame | None = None) -> dict[str, DataFrame]:
    """Bundle tables (B05): places with tiles, pins, registers, country index, counts, manifest.

    With a previous snapshot, any broken id promise stops the export.
    """
    placed = cut(assign_tiles(places, tile_edges))
    if previous is not None:
        empty = previous.select(F.col("place_id").alias("old_id"), F.col("place_id").alias("new_id")).limit(0)
        bad = identity.stability(previous, placed, mapping if mapping is not None else empty).take(5)
        if bad:
            raise ValueError("place ids moved without a mapping: " + ", ".join(f"{r['problem']} {r['place_id']}" for r in bad))
    roster = placed.where(F.col("territory_id").isNotNull()).groupBy("territory_id").agg(F.count(F.lit(1)).alias("app_places"))
    tiles = territories.join(roster, "territory_id", "left").withColumn("app_places", F.coalesce("app_places", F.lit(0)))
    counts = identity.bundle_counts(placed, tiles)
    manifest = counts.join(F.broadcast(identity.build_number(placed)))  # one row each
    return {"places": placed, "pins": sinks.pin_layer(placed), "index": serve.country_index(placed), "kinds": serve.kind_counts(placed),
            "territories": tiles, "manifest": manifest}


def write_bundle(bundle: dict[str, DataFrame], path: str) -> None:
    """Bundle tables in one folder, with the id snapshot the next build is held to."""
    for name, df in bundle.items():
        if name == "places":
            sinks.write_places(df, f"{path}/places")
        else:
            sinks.write_table(df, f"{path}/{name}")
    sinks.write_table(identity.snapshot(bundle["places"]), f"{path}/snapshot")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("places", "pins", "index", "kinds", "territories", "manifest")}


def publish(spark: SparkSession, bundle: dict[str, DataFrame], live: str, checks) -> DataFrame:
    """All or nothing (K13): write a new version, gate it as written, then point the live name at it.

    ``checks`` maps a bundle to a gate table (gate, ok, detail), which is stored with the version either way. A failed
    gate leaves the live pointer as it was. A pointer is one new file that is created only if it isn't there; none is
    ever rewritten, so a crash at any point leaves the version before, and of two publishers that started from one
    version the second is refused with ``Overtaken``. Returns the gate table.
    """
    number = _last_pointer(spark, live) + 1
    version = f"{live}/versions/{uuid.uuid4().hex}"
    write_bundle(bundle, version)
    result = cut(checks(read_bundle(spark, version)))
    sinks.write_table(result, f"{version}/gates")
    if result.where(~F.col("ok")).take(1):
        return result
    _create_pointer(spark, live, number, version)
    return result


class Overtaken(RuntimeError):
    """Another publisher made a version live since this one started."""


def _pointer_file(spark: SparkSession, live: str, name: str = ""):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{live}/current/{name}".rstrip("/"))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _last_pointer(spark: SparkSession, live: str) -> int:
    """Number of the newest pointer, by its file's name, so that one left empty by a crash counts too."""
    folder, files = _pointer_file(spark, live)
    if not files.exists(folder):
        return 0
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit()), default=0)


def _create_pointer(spark: SparkSession, live: str, number: int, version: str) -> None:
    path, files = _pointer_file(spark, live, f"{number:09d}.json")
    try:
        out = files.create(path, False)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName() or files.exists(path):
            raise Overtaken(f"version {number} of {live} is another publisher's") from None
        raise
    try:
        out.write(bytearray(json.dumps({"number": number, "version": version}).encode()))
    finally:
        out.close()


_POINTER = "number long, version string"


def _pointers(spark: SparkSession, live: str) -> DataFrame:
    """Every version that has been live, numbered in order."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(_POINTER).json(f"{live}/current")
    except AnalysisException:
        return spark.createDataFrame([], _POINTER)


def live_version(spark: SparkSession, live: str) -> str | None:
    """Folder of the live version, or None when nothing was published."""
    return _pointers(spark, live).where(F.col("version").isNotNull()).agg(F.max_by("version", "number")).first()[0]


def publish_from_tables(places: DataFrame, tile_edges: DataFrame, territories: DataFrame) -> dict[str, DataFrame]:
    """Publish straight from tables (B06); tiles without an outline get a padded box around their places."""
    bundle = export_bundle(places, tile_edges, territories)
    have = tile_edges.select(F.col("poly_id").alias("territory_id")).distinct()
    bare = territories.join(have, "territory_id", "left_anti").select("territory_id")
    bundle["boxes"] = land.padded_boxes(bundle["places"].join(bare, "territory_id", "left_semi"), "territory_id")
    return bundle


