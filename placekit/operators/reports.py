"""Report tables: score explanations and selection evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.functions import kinds
from placekit.functions.vocab import TIER_NAMES, TIERS


def explain_scores(scored: DataFrame) -> DataFrame:
    """Each candidate's share of the country's top score, its pillars and the tiers behind them."""
    tops = scored.groupBy("country").agg(F.max("score").alias("_top"))
    pairs = F.array(*[F.struct((-kinds.tier(F.col("tiers"), t)).alias("neg"), F.lit(t).alias("tier")) for t in TIER_NAMES])
    held = F.array_sort(F.filter(pairs, lambda p: p["neg"] < 0))
    said = F.array_join(F.transform(held, lambda p: F.concat(p["tier"], F.lit("×"), (-p["neg"]).cast("string"))), ", ")
    return scored.join(tops, "country").select(
        "country", "candidate_id", "name", F.when(F.col("_top") > 0, 100 * F.col("score") / F.col("_top")).alias("of_top"),
        "h", "n", "liv", "feasibility", F.nullif(said, F.lit("")).alias("tiers"))


def tiers_in_play(scored: DataFrame) -> DataFrame:
    """Tiers any of the candidates hold, with weight and pillar."""
    sums = scored.agg(kinds.tier_sum("tiers").alias("t"))
    rows = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(p).alias("pillar"), F.lit(w).alias("weight"),
                              kinds.tier(F.col("t"), t).alias("n")) for t, p, w, _ in TIERS])
    return sums.select(F.explode(rows).alias("r")).select("r.*").where(F.col("n") > 0)


def place_sheet(places: DataFrame) -> DataFrame:
    """One readable row per place, ordered as printed reports are."""
    return places.select(
        "country", "name", F.when(F.col("is_site"), "site").otherwise("settlement").alias("kind"), "lat", "lon", "score",
        F.when(F.col("on_printed_map"), "yes").otherwise("no").alias("on_printed_map"), "printed_rank",
        F.array_join("archetypes", ", ").alias("archetypes"), "whs", F.array_join("sources", ", ").alias("sources")
    ).orderBy("country", F.col("score").desc(), "name")


def selection_evidence(country_stats: DataFrame) -> DataFrame:
    """Per country: candidates, places, printed, quota, redundancy, closest pair, conflicts."""
    return country_stats.orderBy(F.col("on_printed_map").desc(), "country")
