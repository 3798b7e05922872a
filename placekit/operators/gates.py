"""Release gates and checks: rules over tables that yield gate, ok, detail (Q01-Q09).

A gate aborts a publish; a check does too but is not one of the six gates; a report informs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placekit.functions import geo, kinds, text
from placekit.functions.vocab import DISSOLVE_ISO3, DISSOLVE_LABELS, PARAMS, Params
from placekit.operators import identity, resolve, spatial

GATES = ("kind_audit", "region_coverage", "dissolve_resolution", "polygon_naming", "place_id_stability", "manifest_agreement")


def _rule(gate: str, label: str, bad: DataFrame, sample: Column) -> DataFrame:
    """A rule holds when ``bad`` is empty; the detail counts rows and shows the smallest sample."""
    seen = bad.select(sample.cast("string").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"))
    return seen.select(F.lit(gate).alias("gate"), F.lit(label).alias("rule"), (F.col("n") == 0).alias("ok"), F.col("n").alias("bad"), F.col("s").alias("sample"))


def _all(rules: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), rules)


def kind_audit(places: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """All twelve kinds present, no place without one, every listed country kind on a place (Q01)."""
    have = places.agg(F.bit_or("kmask").alias("m"))
    missing = have.select(F.explode(kinds.decode(F.bitwise_not(F.coalesce("m", F.lit(0))))).alias("kind"))
    rules = [_rule("kind_audit", "every kind is present", missing, F.col("kind")),
             _rule("kind_audit", "no place without a kind", places.where(F.coalesce("kmask", F.lit(0)) == 0), F.col("place_id"))]
    if listed is not None:
        real = places.select("iso3", F.explode(kinds.decode(F.col("kmask"))).alias("kind")).distinct()
        rules.append(_rule("kind_audit", "no country lists a kind it lacks", listed.select("iso3", "kind").join(real, ["iso3", "kind"], "left_anti"), F.concat_ws(" ", "iso3", "kind")))
    return _all(rules)


def region_coverage(places: DataFrame, gaps: DataFrame) -> DataFrame:
    """Every place has a region, and regions cover land within tolerance (Q02)."""
    return _all([_rule("region_coverage", "every place has a region", places.where(F.coalesce("region_id", F.lit("")) == ""), F.col("place_id")),
                 _rule("region_coverage", "regions cover land", gaps.where(~F.col("ok")), F.col("grp"))])


def dissolve_resolution(places: DataFrame, shapes: DataFrame) -> DataFrame:
    """No polygon, register or pin under a dissolved label, and flagged places carry the host (Q03)."""
    codes, labels = list(DISSOLVE_ISO3), [x.lower() for x in DISSOLVE_LABELS]

    def aliased(df: DataFrame) -> DataFrame:
        return df.where(F.upper("iso3").isin(*codes) | F.lower(F.trim("country")).isin(*labels))

    rules = [_rule("dissolve_resolution", "no dissolved polygon", aliased(shapes), F.col("iso3")),
             _rule("dissolve_resolution", "no dissolved place", aliased(places), F.col("place_id"))]
    if "disputed" in places.columns:
        astray = places.where(F.col("disputed").isNotNull() & (F.col("iso3") != text.canonical_iso3(F.col("disputed"))))
        rules.append(_rule("dissolve_resolution", "flagged places carry the host", astray, F.col("place_id")))
    return _all(rules)


def polygon_naming(towns: DataFrame, regions: DataFrame) -> DataFrame:
    """The region a town lies in must bear the town's name or a known respelling of it (Q04).

    ``towns``: name, region_id, iso3 of the towns the rule is for. ``regions``: region_id, iso3, name. A town whose
    region is missing fails.
    """
    r = regions.select("iso3", "region_id", F.col("name").alias("region_name"), text.fold_words("name").alias("_region"), text.fold_words(text.head_word(F.col("name"))).alias("_head"))
    t = towns.select("iso3", "region_id", "name", text.fold_words("name").alias("_town")).join(r, ["iso3", "region_id"], "left")
    wrong = t.where(~F.coalesce(text.namesake_in(F.col("_region"), F.col("_town"), F.col("_head")), F.lit(False)))
    return _rule("polygon_naming", "a town's region bears its name", wrong, F.concat_ws(" in ", "name", F.coalesce("region_name", F.lit("no region"))))


def id_stability(places: DataFrame, previous: DataFrame, mapping: DataFrame) -> DataFrame:
    """Ids unique, none vanished, misdirected or reused (Q05)."""
    twice = places.groupBy("place_id").count().where(F.col("count") > 1)
    broken = identity.stability(previous, places, mapping)
    return _all([_rule("place_id_stability", "ids are unique", twice, F.col("place_id")),
                 _rule("place_id_stability", "ids are stable", broken, F.concat_ws(" ", "problem", "place_id"))])


def manifest_agreement(places: DataFrame, territories: DataFrame, manifest: DataFrame, report_build: str | None = None) -> DataFrame:
    """Claimed totals and build number equal what is there (Q06)."""
    errors = identity.manifest_errors(manifest, identity.bundle_counts(places, territories))
    said = F.concat(F.col("item"), F.lit(" claimed "), F.coalesce(F.col("claimed").cast("string"), F.lit("nothing")), F.lit(", found "), F.col("actual").cast("string"))
    build = identity.build_number(places)
    other = manifest.select(F.col("build").alias("claimed")).join(F.broadcast(build)).where(~F.col("claimed").eqNullSafe(F.col("build")))  # one row each
    rules = [_rule("manifest_agreement", "totals equal the tables", errors, said), _rule("manifest_agreement", "build equals the ids", other, F.col("claimed"))]
    if report_build is not None:
        rules.append(_rule("manifest_agreement", "report names the same build", build.where(F.col("build") != report_build), F.col("build")))
    return _all(rules)


def shape_checks(places: DataFrame, quotas: DataFrame, stats: DataFrame | None = None, p: Params = PARAMS) -> DataFrame:
    """Ranges, names, provenance, budget, ranks, spacing and quota of a build (Q07).

    Spacing is checked with a distance join of printed places only.
    """
    printed = places.where("printed")
    lat, lon = F.col("lat"), F.col("lon")
    facts = quotas.select("country", "quota", geo.min_spacing(F.col("area_km2"), F.col("quota"), p).alias("d_min"))
    with_d = printed.join(facts, "country").select("place_id", "country", "lat", "lon", F.col("d_min").alias("reach"))
    other = spatial.as_right(printed.select("place_id", "country", "lat", "lon"), other="place_id")
    tight = spatial.radius_join(with_d, other, "reach", ["country"]).where((F.col("place_id") < F.col("other")) & (F.col("km") < F.col("reach") - 0.5))
    over = printed.groupBy("country").count().join(facts, "country").where(F.col("count") > F.col("quota"))
    budget = printed.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > p.hole_budget)
    rules = [
        _rule("shape", "ids are unique", places.groupBy("place_id").count().where(F.col("count") > 1), F.col("place_id")),
        _rule("shape", "coordinates in range, never null island", places.where(~(lat.between(-90, 90) & lon.between(-180, 180)) | ((lat == 0) & (lon == 0))), F.col("place_id")),
        _rule("shape", "every place has a name", places.where(F.trim(F.coalesce("name", F.lit(""))) == ""), F.col("place_id")),
        _rule("shape", "every place carries provenance", places.where(F.size(F.coalesce("sources", F.array().cast("array<string>"))) <= 0), F.col("place_id")),
        _rule("shape", "scores are 0-100", places.where(~F.col("score").between(0, 100)), F.col("place_id")),
        _rule("shape", "hole budget respected", budget, F.col("n")),
        _rule("shape", "every printed place has a rank", printed.where(F.col("printed_rank").isNull()), F.col("place_id")),
        _rule("shape", "no two holes under the country's spacing", tight, F.concat_ws("+", "place_id", "other")),
        _rule("shape", "no country exceeds its quota", over, F.col("country")),
    ]
    if stats is not None:
        mean = stats.where(F.col("redundancy").isNotNull()).agg(F.avg("redundancy").alias("m")).where(F.col("m") >= 0.6)
        rules.append(_rule("shape", "mean redundancy below 0.6", mean, F.col("m")))
    return _all(rules)


def tile_checks(places: DataFrame, assigned: DataFrame, tiles: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Tile ids unique, no place in two tiles, no empty tile, region and tile ids apart."""
    rules = [
        _rule("tiles", "tile ids are unique", tiles.groupBy("territory_id").count().where(F.col("count") > 1), F.col("territory_id")),
        _rule("tiles", "no place in two tiles", assigned.groupBy("place_id").agg(F.count_distinct("territory_id").alias("n")).where(F.col("n") > 1), F.col("place_id")),
        _rule("tiles", "no empty tile", tiles.join(assigned, "territory_id", "left_anti"), F.col("territory_id")),
        _rule("tiles", "every printed place has a tile", places.where("printed").join(assigned, "place_id", "left_anti"), F.col("place_id")),
    ]
    if regions is not None:
        both = regions.select(F.col("region_id").alias("territory_id")).distinct().join(tiles, "territory_id", "left_semi")
        rules.append(_rule("tiles", "regions are not tiles", both, F.col("territory_id")))
    return _all(rules)


def candidate_checks(places: DataFrame, allowed: DataFrame, log: DataFrame | None = None, dense: str | None = None, sparse: str | None = None) -> DataFrame:
    """No same-kind pair under two kilometres, others on the list, absorption happened, density ratio.

    ``places`` carry kinds vectors; ``allowed``: id_a, id_b.
    """
    pairs = resolve.close_pairs(places.drop("candidate_id").withColumnRenamed("place_id", "candidate_id"))
    key = [F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")]
    unknown = pairs.where(~F.col("same_kind")).join(allowed.select(*key), ["id_a", "id_b"], "left_anti")
    rules = [_rule("candidates", "no same-kind pair under 2 km", pairs.where("same_kind"), F.concat_ws("+", "id_a", "id_b")),
             _rule("candidates", "close different-kind pairs are listed", unknown, F.concat_ws("+", "id_a", "id_b"))]
    if log is not None:
        folded = log.where(F.col("decision").isin(*resolve.FOLDING)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
        rules.append(_rule("candidates", "absorption is not zero", folded, F.col("n")))
    if dense and sparse:
        per = places.where(F.col("iso3").isin(dense, sparse)).groupBy("iso3").agg((F.count(F.lit(1)) / F.greatest(F.bit_count(F.bit_or("kmask")), F.lit(1))).alias("r"))
        ratio = per.agg((F.max(F.when(F.col("iso3") == dense, F.col("r"))) / F.max(F.when(F.col("iso3") == sparse, F.col("r")))).alias("x")).where(F.col("x") > 3.0)
        rules.append(_rule("candidates", "places per kind are comparable", ratio, F.col("x")))
    return _all(rules)


def metadata_checks(places: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """No placeholder reach or months; anchor scores hold (Q09). ``anchors``: name, iso3, score."""
    dummy = F.lit(False)
    if "reach" in places.columns:
        dummy = dummy | F.coalesce(F.col("reach") == "near", F.lit(False))
    if "best_months" in places.columns:
        dummy = dummy | (F.size(F.coalesce("best_months", F.array().cast("array<int>"))) > 0)
    rules = [_rule("metadata", "reach and months are not placeholders", places.where(dummy), F.col("place_id"))]
    if anchors is not None:
        off = anchors.join(places.select("name", "iso3", F.col("score").alias("_s")), ["name", "iso3"], "left").where(~F.col("score").eqNullSafe(F.col("_s")))
        rules.append(_rule("metadata", "anchor scores hold", off, F.col("name")))
    return _all(rules)


def failed(result: DataFrame) -> list[str]:
    """Names of gates with a broken rule; gate tables have a few dozen rows."""
    return sorted({r["gate"] for r in result.where(~F.col("ok")).select("gate").distinct().collect()})
