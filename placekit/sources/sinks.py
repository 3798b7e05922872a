"""Published tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.functions import kinds

_STATES = ("vf", "voa", "ev", "vr", "na", "home")


# ------------------------------------------------------------------ shapes
def thin(places: DataFrame) -> DataFrame:
    """Client rows: coordinates to four places, weights to two, empty lineage dropped."""
    out = places.withColumn("lat", F.bround("lat", 4)).withColumn("lon", F.bround("lon", 4))
    if "archetype_weights" in places.columns:
        out = out.withColumn("archetype_weights", F.transform("archetype_weights", lambda w: F.bround(w, 2)))
    if "merged_from" in places.columns:
        out = out.withColumn("merged_from", F.when(F.size("merged_from") > 0, F.col("merged_from")))
    return out


def pin_layer(places: DataFrame) -> DataFrame:
    """Narrow rows under short keys: kinds and months as bitmasks."""
    have = set(places.columns)

    def or_null(c: str, t: str):
        return F.col(c) if c in have else F.lit(None).cast(t)

    return places.select(
        F.col("place_id").alias("id"), F.col("name").alias("n"), F.col("score").alias("s"),
        F.coalesce(F.get(kinds.decode(F.col("kmask")), F.lit(0)), F.lit("")).alias("k"), F.col("kmask").alias("a"),
        or_null("months", "int").alias("m"), F.col("iso3").alias("c"),
        (F.col("is_site") if "is_site" in have else F.lit(False)).cast("int").alias("site"),
        F.col("printed").cast("int").alias("hole"), F.col("whs").alias("whs"),
        or_null("territory_id", "string").alias("t"), or_null("region_id", "string").alias("r"),
        F.bround("lon", 4).alias("lon"), F.bround("lat", 4).alias("lat"))


def registers(places: DataFrame) -> DataFrame:
    """One document per country: its places by score, its kinds with counts.

    A document is per country by definition; very large countries are better read from the
    partitioned place table that :func:`write_places` keeps beside it.
    """
    row = F.struct((-F.col("score")).alias("_neg"), "place_id", "name", "lat", "lon", "score", "kmask", "printed", "whs")
    docs = places.groupBy("iso3").agg(F.array_sort(F.collect_list(row)).alias("places"))
    counts = places.select("iso3", F.explode(kinds.decode(F.col("kmask"))).alias("kind")).groupBy("iso3", "kind").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.groupBy("iso3").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    drop = F.transform("places", lambda p: p.dropFields("_neg"))
    return docs.join(counts, "iso3", "left").withColumn("places", drop)


def country_counts(places: DataFrame) -> DataFrame:
    return places.groupBy("country").agg(F.count(F.lit(1)).alias("in_app"), F.count(F.when(F.col("on_printed_map"), 1)).alias("on_printed_map"))


def passport_summary(entries: DataFrame, register: DataFrame) -> DataFrame:
    """Destinations per state and in our register, per passport."""
    ours = register.select(F.col("iso3").alias("destination")).distinct().withColumn("_ours", F.lit(True))
    return (entries.join(ours, "destination", "left").groupBy("passport").agg(
        *[F.count(F.when(F.col("r") == s, 1)).alias(s) for s in _STATES], F.count(F.when(F.col("_ours"), 1)).alias("in_database")))


def passport_files(entries: DataFrame, register: DataFrame) -> DataFrame:
    """One row per passport with its destinations, a few hundred at most."""
    dest = entries.groupBy("passport").agg(F.array_sort(F.collect_list(F.struct("destination", "r", "d", "v"))).alias("destinations"))
    return dest.join(passport_summary(entries, register), "passport")


# ------------------------------------------------------------------ writing
def write_places(places: DataFrame, path: str) -> None:
    """Full refresh, partitioned by country so a register reads only its own files."""
    places.write.mode("overwrite").partitionBy("iso3").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines; per ``by`` when files are fetched one at a time."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_sheet(rows: DataFrame, path: str) -> DataFrame:
    """Spreadsheet rows as CSV; returns the row advisory."""
    from placekit.operators.serve import row_advisory

    rows.write.mode("overwrite").option("header", True).csv(path)
    return row_advisory(rows)


def write_printed(places: DataFrame, quotas: DataFrame, conflicts: DataFrame, path: str) -> None:
    """Printed subset, quotas and inset candidates."""
    write_table(thin(places.where("on_printed_map")), f"{path}/places")
    write_table(quotas.select("country", "quota"), f"{path}/quotas")
    write_table(conflicts, f"{path}/inset_candidates")


def write_report(country_stats: DataFrame, log: DataFrame, conflicts: DataFrame, path: str) -> None:
    """Build statistics, absorption log, conflicts."""
    for name, df in (("stats", country_stats), ("absorption", log), ("conflicts", conflicts)):
        write_table(df, f"{path}/{name}")


def write_territories(territories: DataFrame, path: str) -> DataFrame:
    """Tiles and how many of them are printable."""
    write_table(territories, path)
    return territories.agg(F.count(F.lit(1)).alias("territories"), F.count(F.when(F.col("printable"), 1)).alias("printable"))
