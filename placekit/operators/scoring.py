"""Country-relative scores, quotas and place rows.

Statistics of a country are one aggregated row joined back by name, so a country holding a
third of all candidates is summed in partials and never gathered in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placekit.functions import kinds
from placekit.functions.vocab import (
    CROSS_COUNTRY_TIERS, LANDFORM_SHARE, PARAMS, PROFILE_KEYS, REACH_FACTOR, TIERS, Params, lookup,
)


def saturating(weight, n: Column, delta: float) -> Column:
    """`w (1 - d^n) / (1 - d)`: the fortieth asset of a tier adds almost nothing."""
    w = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight
    return F.when(n > 0, w * (1.0 - F.pow(F.lit(delta), n)) / (1.0 - delta)).otherwise(0.0)


def _tiered_sql(tiers: str, pillar: str, p: Params, cross_country: bool = False) -> str:
    by_weight: dict[float, list[str]] = {}
    for name, pil, weight, cross in TIERS:
        if pil == pillar and (cross or not cross_country):
            by_weight.setdefault(weight, []).append(kinds.tier_at(tiers, name))
    return "(" + " + ".join(f"{w!r}D * (1.0D - pow({p.delta!r}D, {' + '.join(n)})) / {1.0 - p.delta!r}D" for w, n in by_weight.items()) + ")"


def tiered_sum(tiers: str, pillar: str, p: Params = PARAMS, cross_country: bool = False) -> Column:
    """Discounted tier sum of one pillar (A01, A02); tiers of equal weight share one discount."""
    return F.expr(_tiered_sql(tiers, pillar, p, cross_country))


def bulk(tiers: str = "tiers", p: Params = PARAMS) -> Column:
    """All three pillars' tier sums together."""
    return F.expr(" + ".join(_tiered_sql(tiers, x, p) for x in "HNL"))


def rarity(share: float) -> float:
    """Self-information of a landform on a 1..6 scale."""
    return max(1.0, min(6.0, 1.0 + 1.6 * (-math.log2(share) - 2.0)))


_RARITY = {form: rarity(share) for form, share in LANDFORM_SHARE.items()}


def landform_weight(form: Column, lone: Column, p: Params = PARAMS) -> Column:
    """Rarity weight, capped where the country holds a single instance."""
    w = lookup(_RARITY, form, 1.0)
    return F.when(lone, F.least(w, F.lit(p.rarity_country_cap))).otherwise(w)


def landform_instances(cands: DataFrame) -> DataFrame:
    """Candidates per (country, landform), each candidate counted once per landform."""
    return (cands.select("country", F.explode(F.array_distinct("landforms")).alias("landform"))
            .groupBy("country", "landform").agg(F.count(F.lit(1)).alias("instances")))


def pillars(cands: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Raw heritage, nature and living-culture pillars (A03): h_raw, n_raw, l_raw."""
    lone = (landform_instances(cands).where(F.col("instances") <= 1)
            .groupBy("country").agg(F.collect_set("landform").alias("_lone")))  # at most one per landform
    out = cands.join(lone, "country", "left")
    weights = F.transform("landforms", lambda f: F.bround(landform_weight(
        f, F.coalesce(F.array_contains(F.col("_lone"), f), F.lit(False)), p), 3))
    out = out.withColumn("_w", weights)
    setting = F.aggregate(F.array_distinct("_w"), F.lit(0.0), lambda acc, w: acc + saturating(
        w, F.size(F.filter("_w", lambda x: x == w)), p.delta))
    tiers = "tiers"
    return out.select(
        *cands.columns,
        (tiered_sum(tiers, "H", p) * (1.0 + p.coherence * F.col("coherence"))).alias("h_raw"),
        (tiered_sum(tiers, "N", p) + setting
         + 1.5 * F.least(F.col("relief_m"), F.lit(3000.0)) / 1000.0).alias("n_raw"),
        tiered_sum(tiers, "L", p).alias("l_raw"))


def against_top(df: DataFrame, group: str, pairs: dict[str, str]) -> DataFrame:
    """Linear norm against the group's maximum (A06); a group with no positive value is all 0."""
    tops = df.groupBy(group).agg(*[F.max(raw).alias(f"_top_{new}") for new, raw in pairs.items()])
    out = df.join(tops, group)
    for new, raw in pairs.items():
        top = F.col(f"_top_{new}")
        out = out.withColumn(new, F.when(top > 0, F.greatest(F.col(raw), F.lit(0.0)) / top).otherwise(0.0))
    return out.drop(*[f"_top_{new}" for new in pairs])


def feasibility() -> Column:
    """Can a traveller go and sleep there; never above 1."""
    f = lookup(REACH_FACTOR, F.col("reach"))
    f = f * F.when(F.col("has_lodging"), 1.0).otherwise(0.6)
    f = f * F.when(F.col("overtourism"), 0.85).otherwise(1.0)
    f = f * F.when(F.col("access") == "restricted", 0.8).otherwise(1.0)
    return F.when(F.col("access") == "closed", 0.0).otherwise(F.least(F.lit(1.0), f))


def modal_profile(cands: DataFrame) -> DataFrame:
    """Each country's typical profile value per key, weighted by population."""
    rows = cands.select(
        "country", F.greatest(F.col("population") / 1e6, F.lit(0.01)).alias("w"),
        F.explode("profile").alias("key", "value"))
    rows = rows.where(F.col("key").isin(*PROFILE_KEYS) & (F.coalesce("value", F.lit("")) != ""))
    tally = rows.groupBy("country", "key", "value").agg(F.sum("w").alias("w"))
    best = F.min(F.struct((-F.round("w", 9)).alias("neg"), "value")).alias("_b")
    return tally.groupBy("country", "key").agg(best).select("country", "key", F.col("_b.value").alias("mode"))


def order_statistic(df: DataFrame, group: str, value: str, share: float, buckets: int = 1024,
                    levels: int = 2) -> DataFrame:
    """The plain-index quantile ``sorted(v)[int(share * (n - 1))]`` of each group, exactly.

    Values are counted in equal-width buckets (partial sums), the bucket holding the wanted
    index is opened, and so on; only distinct values of the last bucket are ever ordered.
    """
    stats = df.groupBy(group).agg(F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    target = stats.select(group, F.floor(share * (F.col("_n") - 1)).alias("_at"), "_lo", "_hi")
    rows = df.select(group, value).where(F.col(value).isNotNull())
    running = W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    for _ in range(levels):
        width = (F.col("_hi") - F.col("_lo")) / buckets
        bucket = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(buckets - 1))).otherwise(0)
        keyed = rows.join(target, group).where(F.col(value).between(F.col("_lo"), F.col("_hi"))).withColumn("_b", bucket)
        counts = keyed.groupBy(group, "_at", "_b").agg(
            F.count(F.lit(1)).alias("_c"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        # at most `buckets` rows per group
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(running), F.lit(0)))
        target = counts.where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_c"))).select(
            group, (F.col("_at") - F.col("_before")).alias("_at"), "_lo", "_hi")
    last = (rows.join(target, group).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
            .groupBy(group, "_at", F.col(value).alias("_b")).agg(F.count(F.lit(1)).alias("_c")))
    last = last.withColumn("_before", F.coalesce(F.sum("_c").over(running), F.lit(0)))
    hit = (F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_c"))
    return last.where(hit).select(group, F.col("_b").alias(value))


def distinctiveness(cands: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Distance from the country's own norm as a multiplier (A08); 1.0 when beta is 0."""
    if p.beta == 0.0:
        return cands.withColumn("distinctiveness", F.lit(1.0))
    modes = modal_profile(cands).groupBy("country").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "mode"))).alias("_modes"))  # four keys
    p75 = order_statistic(cands, "country", "population", 0.75).withColumnRenamed("population", "_p75")
    out = cands.join(modes, "country", "left").join(p75, "country", "left")
    steps = []
    for key in PROFILE_KEYS:
        v, mode = F.col("profile")[key], F.col("_modes")[key]
        differs = F.when(v == mode, 0.0)
        if key == "language":
            differs = differs.when(F.split_part(v, F.lit(":"), F.lit(1)) == F.split_part(mode, F.lit(":"), F.lit(1)), 0.5)
        known = (F.coalesce(v, F.lit("")) != "") & (F.coalesce(mode, F.lit("")) != "")
        steps.append(F.when(known, differs.otherwise(1.0)))
    have = F.filter(F.array(*steps), lambda d: d.isNotNull())
    raw = F.aggregate(have, F.lit(0.0), lambda acc, d: acc + d) / F.size(have)
    ref = F.sqrt(F.greatest(F.col("_p75") / 1e6, F.lit(1e-4)))
    sat = F.least(F.sqrt(F.greatest(F.col("population") / 1e6, F.lit(1e-4))), ref) / ref
    sat = F.when(F.col("is_site"), F.greatest(sat, F.lit(0.35))).otherwise(sat)
    value = F.when(F.size(have) > 0, 1.0 + p.beta * raw * sat).otherwise(1.0)
    return out.withColumn("distinctiveness", value).drop("_modes", "_p75")


def power_mean(p: Params = PARAMS) -> Column:
    """Weighted power mean of the three normed pillars (A10)."""
    parts = ((p.w_h, "h"), (p.w_n, "n"), (p.w_l, "liv"))
    if p.power == 1.0:
        return sum((w * F.col(c) for w, c in parts), F.lit(0.0))
    total = sum((w * F.pow(F.col(c), F.lit(p.power)) for w, c in parts), F.lit(0.0))
    return F.pow(total, F.lit(1.0 / p.power))


def score(cands: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Pillars, norms, feasibility, composite: everything a candidate is scored on."""
    out = against_top(pillars(cands, p), "country", {"h": "h_raw", "n": "n_raw", "liv": "l_raw"})
    out = distinctiveness(out, p).withColumn("feasibility", feasibility()).withColumn("base", power_mean(p))
    return out.withColumn("score", F.col("base") * F.col("distinctiveness") * F.col("feasibility"))


def country_facts(scored: DataFrame, countries: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Per country: area, kinds covered, globally adjudicated assets, quality."""
    known = countries.select("country", "area_km2", "iso3")
    cross = F.expr(" + ".join(kinds.tier_at("tiers", t) for t in CROSS_COUNTRY_TIERS))
    out = (scored.groupBy("country").agg(
        F.count(F.lit(1)).alias("candidates"), F.bit_or(kinds.covered_mask(F.col("kinds"))).alias("_mask"),
        F.sum(cross).alias("global_assets")).join(known, "country", "left"))
    area = F.coalesce("area_km2", F.lit(p.default_area_km2))
    n_kinds = F.bit_count("_mask")
    quality = (p.quota_area * F.log(1.0 + area / p.quota_area_ref_km2) + p.quota_archetypes * n_kinds
               + p.quota_global * F.log(1.0 + F.col("global_assets")))
    return out.select("country", "iso3", area.alias("area_km2"), "candidates",
                      n_kinds.cast("bigint").alias("kinds_covered"), "global_assets", quality.alias("quality"))


def quotas(facts: DataFrame, p: Params = PARAMS, budget: int | None = None) -> DataFrame:
    """Share the hole budget between countries (A14); pro-rated when few countries are present."""
    whole = facts.agg(F.sum("quality").alias("_q"), F.count(F.lit(1)).alias("_m"))  # one row
    out = facts.join(F.broadcast(whole))
    share = F.least(F.lit(1.0), F.col("_m") / p.world_countries)
    money = F.lit(budget) if budget is not None else F.greatest(F.lit(1), F.bround(p.hole_budget * share, 0))
    total = F.when(F.col("_q") != 0, F.col("_q")).otherwise(1.0)
    n = F.bround(money * F.col("quality") / total, 0).cast("int")
    n = F.when(F.col("kinds_covered") >= p.small_country_archetypes,
               F.greatest(n, F.lit(p.quota_small_country_floor))).otherwise(n)
    quota = F.greatest(F.lit(p.quota_min), F.least(F.lit(p.quota_max), n))
    return out.withColumn("quota", quota.cast("int")).drop("_q", "_m")


def above_floor(scored: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Feasible candidates with at least a tenth of the country's top score, with their 0-100 score."""
    tops = scored.groupBy("country").agg(F.max("score").alias("_top"))
    top = F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)
    out = scored.join(tops, "country").where((F.col("feasibility") > 0) & (F.col("score") >= p.score_floor * top))
    # the best candidate is always kept when it is feasible, and a positive top is feasible
    return out.withColumn("score100", F.bround(100.0 * F.col("score") / top, 0).cast("int")).drop("_top")
