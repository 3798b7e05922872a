"""Build numbers, id stability and manifest agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placekit.functions import text

PREFIX = 3  # hex digits: 4,096 groups of ids, digested on their own


def build_number(ids: DataFrame, id_col: str = "place_id") -> DataFrame:
    """Twelve hex of a digest over the sorted ids (A20): one row, ``build``.

    The same at every size: ids are grouped by the first digits of their own digest, each group's sorted ids are
    digested in parallel, and the groups' digests are digested in order. No group holds more than a few thousandths.
    """
    part = ids.groupBy(F.substring(F.sha2(F.col(id_col), 256), 1, PREFIX).alias("p")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(id_col)), "\n"), 256).alias("d"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: F.concat_ws(":", x["p"], x["d"])), "\n")
    return part.agg(F.substring(F.sha2(lines, 256), 1, 12).alias("build"))


def bundle_counts(places: DataFrame, territories: DataFrame) -> DataFrame:
    """What a bundle holds: places, printed, countries, territories."""
    a = places.agg(F.count(F.lit(1)).alias("places"), F.count(F.when(F.col("printed"), 1)).alias("printed"),
                   F.count_distinct("iso3").alias("countries"))
    b = territories.agg(F.count(F.lit(1)).alias("territories"))
    return a.join(F.broadcast(b))  # one row each


def manifest_errors(claimed: DataFrame, actual: DataFrame) -> DataFrame:
    """Every total that differs, with both numbers (A21): item, claimed, actual."""
    items = ("places", "printed", "countries", "territories")

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(i).alias("item"), F.col(i).cast("bigint").alias(name)) for i in items])
        return df.select(F.explode(pairs).alias("p")).select("p.*")

    both = long(claimed, "claimed").join(long(actual, "actual"), "item")
    return both.where(~F.col("claimed").eqNullSafe(F.col("actual")) | F.col("claimed").isNull())


def _same_place() -> Column:
    def low(c: str) -> Column:
        return F.lower(F.trim(F.coalesce(c, F.lit(""))))

    return ((low("old_name") == low("name")) & (F.bround("old_lat", 3) == F.bround("lat", 3))
            & (F.bround("old_lon", 3) == F.bround("lon", 3))
            & text.same_identity_country(F.col("old_country"), F.col("country")))


def stability(previous: DataFrame, current: DataFrame, mapping: DataFrame) -> DataFrame:
    """Broken id promises (U02): problem, place_id.

    ``vanished``: gone with no mapping. ``missing_target``: a live mapping points nowhere.
    ``reused``: the id now names another place. Mappings of ids already gone are history.
    """
    ids = current.select("place_id")
    live = mapping.join(previous.select(F.col("place_id").alias("old_id")), "old_id", "left_semi")
    missing = live.select(F.col("new_id").alias("place_id")).distinct().join(ids, "place_id", "left_anti")
    vanished = previous.select("place_id").join(ids, "place_id", "left_anti").join(
        live.select(F.col("old_id").alias("place_id")), "place_id", "left_anti")
    old = previous.select("place_id", *[F.col(c).alias(f"old_{c}") for c in ("name", "country", "lat", "lon")])
    both = current.select("place_id", "name", "country", "lat", "lon").join(old, "place_id")
    reused = both.where(~_same_place()).select("place_id")
    out = None
    for problem, rows in (("vanished", vanished), ("missing_target", missing), ("reused", reused)):
        part = rows.select(F.lit(problem).alias("problem"), "place_id")
        out = part if out is None else out.unionByName(part)
    return out


def snapshot(places: DataFrame) -> DataFrame:
    """Identities to hold the next build to."""
    return places.select("place_id", "name", "country", "lat", "lon")


def host_flags(places: DataFrame, moved: DataFrame) -> DataFrame:
    """Carry printed and World Heritage flags of folded records to their host."""
    old = places.select(F.col("place_id").alias("old_id"), "printed", "printed_rank", "whs")
    got = moved.join(old, "old_id").groupBy("new_id").agg(
        F.max("printed").alias("_p"), F.min("printed_rank").alias("_r"), F.max("whs").alias("_w"))
    out = places.join(moved.select(F.col("old_id").alias("place_id")), "place_id", "left_anti")
    out = out.join(got.withColumnRenamed("new_id", "place_id"), "place_id", "left")
    return (out.withColumn("printed", F.col("printed") | F.coalesce("_p", F.lit(False)))
            .withColumn("printed_rank", F.coalesce("printed_rank", "_r"))
            .withColumn("whs", F.greatest("whs", F.coalesce("_w", F.lit(0)))).drop("_p", "_r", "_w"))
