"""Choosing a spaced, diverse subset per country.

Both selections are greedy and at most ``quota_max`` picks long. Each country's best-scored
rows are walked in one bounded batch; the walk stops at the first step it cannot prove (an
unseen row might score higher), and distributed rounds finish exactly what is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placekit.functions import geo, kinds
from placekit.functions.vocab import EARTH_KM, KIND_DOMINANT, PARAMS, Params
from placekit.operators import spatial
from placekit.plans.session import cut, is_empty

HEAD_ROWS = 2_000
PICKS = "country string, candidate_id string, pick int, gain double, complete boolean"


def arc_km(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    """Haversine kilometres from one point to many, to the millimetre."""
    p, q = np.radians(lat), np.radians(lats)
    s = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lons - lon) / 2) ** 2
    return np.rint(2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(s))) * 1e6) / 1e6


def _head(rows: DataFrame, limit: int) -> DataFrame:
    """The best-scored rows of each country, marked with the best score left behind."""
    best_first = W.partitionBy("country").orderBy(F.col("score").desc(), "candidate_id")
    ranked = rows.withColumn("_nth", F.row_number().over(best_first)).where(F.col("_nth") <= limit + 1)
    over = ranked.where(F.col("_nth") == limit + 1).select("country", F.col("score").alias("unseen"))
    return ranked.where(F.col("_nth") <= limit).drop("_nth").join(over, "country", "left")


def _pool(scored: DataFrame, quotas: DataFrame, p: Params) -> DataFrame:
    facts = quotas.select("country", "quota", geo.min_spacing(F.col("area_km2"), F.col("quota"), p).alias("d_min"))
    return (scored.where(F.col("feasibility") > 0)
            .select("country", "candidate_id", "lat", "lon", "score", kinds.unit(F.col("kinds")).alias("unit"))
            .join(facts, "country"))


# ------------------------------------------------------------------ coverage selection
def _strong(unit: np.ndarray) -> np.ndarray:
    """Weights that count: those at the coverage threshold, else whatever is there."""
    strong = np.where(unit >= KIND_DOMINANT, unit, 0.0)
    weak = ~strong.any(axis=1)
    strong[weak] = unit[weak]
    return strong


def _pick_country(pdf: pd.DataFrame, p: Params) -> pd.DataFrame:
    pdf = pdf.sort_values("candidate_id").reset_index(drop=True)
    lat, lon, score = (pdf[c].to_numpy() for c in ("lat", "lon", "score"))
    unit = np.array(pdf["unit"].tolist(), dtype=float)
    strong = _strong(unit)
    total = strong.sum(axis=1)
    d_min, quota = float(pdf["d_min"].iloc[0]), int(pdf["quota"].iloc[0])
    unseen = pdf["unseen"].iloc[0]
    unseen = -1.0 if pd.isna(unseen) else float(unseen)
    top = score.max() or 1.0
    nearest = np.full(len(pdf), np.inf)
    seen = np.zeros(unit.shape[1])
    left = np.ones(len(pdf), dtype=bool)
    rows, complete = [], True
    for pick in range(1, quota + 1):
        spatial_ = np.ones(len(pdf)) if pick == 1 else np.where(
            nearest < d_min, 0.0, np.minimum(1.0, (nearest - d_min) / d_min))
        new = np.divide(strong @ (p.coverage_decay ** seen), total, out=np.ones(len(pdf)), where=total > 0)
        relief = p.quality_relief * (score / top)
        gain = score * (p.lam_red * (relief + (1 - relief) * new) + (1 - p.lam_red)) * spatial_
        gain[~left] = -1.0
        i = int(np.argmax(gain))
        # no row can gain more than its score, so a gain not above the best unseen score proves nothing
        if unseen > 0 and gain[i] <= unseen:
            complete = False
            break
        if not left[i] or gain[i] <= 0:
            break
        rows.append((pdf["country"].iloc[0], pdf["candidate_id"].iloc[i], pick, float(gain[i])))
        left[i] = False
        nearest = np.minimum(nearest, arc_km(lat[i], lon[i], lat, lon))
        seen += unit[i] >= KIND_DOMINANT
    out = pd.DataFrame(rows, columns=["country", "candidate_id", "pick", "gain"])
    if not complete and not rows:
        out = pd.DataFrame([(pdf["country"].iloc[0], None, 0, 0.0)], columns=out.columns)
    return out.assign(complete=complete)


def _gain(p: Params) -> Column:
    unit = F.col("unit")
    strong = F.transform(unit, lambda w: F.when(w >= KIND_DOMINANT, w).otherwise(0.0))
    strong = F.when(F.array_max(strong) > 0, strong).otherwise(unit)
    total = F.aggregate(strong, F.lit(0.0), lambda a, w: a + w)
    earned = F.aggregate(F.zip_with(strong, "seen", lambda w, n: w * F.pow(F.lit(p.coverage_decay), n)),
                         F.lit(0.0), lambda a, w: a + w)
    new = F.when(total > 0, earned / total).otherwise(1.0)
    near = F.col("nearest")
    ramp = (F.when(near.isNull(), 1.0).when(near < F.col("d_min"), 0.0)
            .otherwise(F.least(F.lit(1.0), (near - F.col("d_min")) / F.col("d_min"))))
    relief = p.quality_relief * (F.col("score") / F.col("top"))
    return F.col("score") * (p.lam_red * (relief + (1 - relief) * new) + (1 - p.lam_red)) * ramp


def _pick_rounds(pool: DataFrame, picks: DataFrame, p: Params) -> DataFrame:
    """Continue the greedy walk over whole countries, one pick per country and round.

    Each row carries its distance to the nearest pick so far, so a round is one broadcast-size
    join (one row per country), one expression and one partial maximum.
    """
    pool = cut(pool)
    tops = pool.groupBy("country").agg(F.max("score").alias("top"), F.first("quota").alias("quota"))
    tops = tops.withColumn("top", F.when(F.col("top") > 0, F.col("top")).otherwise(1.0))
    had = picks.where(F.col("pick") > 0).join(pool.select("country", "candidate_id", "lat", "lon", "unit"), ["country", "candidate_id"])
    had = cut(had)
    flags = F.transform("unit", lambda w: F.when(w >= KIND_DOMINANT, 1.0).otherwise(0.0))
    old = had.withColumn("_f", flags).groupBy("country").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.array(*[F.sum(F.col("_f")[i]) for i in range(12)]).alias("seen"),
        F.collect_list(F.struct("lat", "lon")).alias("at"))  # at most quota_max picks
    state = tops.join(old, "country", "left").select(
        "country", "top", "quota", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("seen", kinds.zero()).alias("seen"), "at")
    rows = pool.join(state.select("country", "at"), "country")
    dist = F.transform("at", lambda q: geo.tick(geo.haversine(F.col("lat"), F.col("lon"), q["lat"], q["lon"])))
    rows = rows.withColumn("nearest", F.array_min(dist)).drop("at").join(had.select("country", "candidate_id"), ["country", "candidate_id"], "left_anti")
    rows, state, out = cut(rows), cut(state.drop("at")), None
    while True:
        # the largest gain wins, ties go to the smaller id
        live = rows.join(state.where(F.col("n") < F.col("quota")).select("country", "top", "seen", "n"), "country")
        live = live.withColumn("_g", _gain(p)).where(F.col("_g") > 0)
        won = live.groupBy("country", "n").agg(F.min(F.struct((-F.col("_g")).alias("neg"), "candidate_id", "lat", "lon", "unit")).alias("_b"))
        won = cut(won.select("country", (F.col("n") + 1).alias("pick"), (-F.col("_b.neg")).alias("gain"),
                             "_b.candidate_id", F.col("_b.lat").alias("plat"), F.col("_b.lon").alias("plon"), F.col("_b.unit").alias("punit")))
        if is_empty(won):
            return out
        got = won.select("country", "candidate_id", "pick", "gain", F.lit(True).alias("complete"))
        out = got if out is None else out.unionByName(got)
        hit = F.transform("punit", lambda w: F.when(w >= KIND_DOMINANT, 1.0).otherwise(0.0))
        # a country with no winner has stopped: it drops out of the state
        state = cut(state.join(won.select("country", "pick", hit.alias("_h")), "country").select(
            "country", "top", "quota", F.col("pick").alias("n"), F.zip_with("seen", "_h", lambda a, b: a + b).alias("seen")))
        away = geo.tick(geo.haversine("lat", "lon", "plat", "plon"))
        rows = cut(rows.join(won.select("country", F.col("candidate_id").alias("_won"), "plat", "plon"), "country")
                   .where(F.col("candidate_id") != F.col("_won"))
                   .withColumn("nearest", F.least(F.col("nearest"), away)).drop("_won", "plat", "plon"))


def select_coverage(scored: DataFrame, quotas: DataFrame, p: Params = PARAMS, head_rows: int = HEAD_ROWS) -> DataFrame:
    """Greedy coverage selection under hard spacing (G07): country, candidate_id, pick, gain."""
    pool = _pool(scored, quotas, p)
    first = cut(_head(pool, head_rows).groupBy("country").applyInPandas(lambda pdf: _pick_country(pdf, p), PICKS))
    open_ = first.where(~F.col("complete")).select("country").distinct()
    out = first.where(F.col("pick") > 0)
    if not is_empty(open_):
        more = _pick_rounds(pool.join(open_, "country", "left_semi"), first.join(open_, "country", "left_semi"), p)
        out = out if more is None else out.unionByName(more)
    return out.drop("complete")


# ------------------------------------------------------------------ rank baseline
def _rank_country(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["score", "candidate_id"], ascending=[False, True])
    lat, lon = pdf["lat"].to_numpy(), pdf["lon"].to_numpy()
    ids, d_min, quota = pdf["candidate_id"].to_numpy(), float(pdf["d_min"].iloc[0]), int(pdf["quota"].iloc[0])
    base = int(pdf["n"].iloc[0])
    got: list[int] = []
    for i in range(len(ids)):
        if base + len(got) >= quota:
            break
        if not got or (arc_km(lat[i], lon[i], lat[got], lon[got]) >= d_min).all():
            got.append(i)
    done = base + len(got) >= quota or pd.isna(pdf["unseen"].iloc[0])
    out = pd.DataFrame({"country": pdf["country"].iloc[0], "candidate_id": ids[got],
                        "pick": [base + j + 1 for j in range(len(got))], "gain": pdf["score"].to_numpy()[got]})
    return out.assign(complete=done)


def select_by_rank(scored: DataFrame, quotas: DataFrame, p: Params = PARAMS, head_rows: int = HEAD_ROWS) -> DataFrame:
    """Highest scorers that fit the spacing rule (G08). Batches of best-scored rows still clear
    of every pick are walked until the quota is met or nothing is left."""
    pool = cut(_pool(scored, quotas, p).withColumn("n", F.lit(0)))
    out = None
    while True:
        got = cut(_head(pool, head_rows).groupBy("country").applyInPandas(_rank_country, PICKS))
        out = got if out is None else out.unionByName(got)
        open_ = got.groupBy("country").agg(F.max("pick").alias("_n"), F.max("complete").alias("_done")).where(~F.col("_done"))
        if is_empty(open_):
            return out.drop("complete")
        # everything walked is either picked or too close to a pick, so it never comes back
        at = got.join(open_.select("country"), "country", "left_semi").join(pool.select("country", "candidate_id", "lat", "lon"), ["country", "candidate_id"])
        spots = at.groupBy("country").agg(F.collect_list(F.struct("lat", "lon")).alias("at"))  # at most quota_max
        rest = pool.join(open_.select("country", "_n"), "country").join(spots, "country")
        clear = F.forall("at", lambda q: geo.tick(geo.haversine(F.col("lat"), F.col("lon"), q["lat"], q["lon"])) >= F.col("d_min"))
        pool = cut(rest.where(clear).withColumn("n", F.col("_n")).select(*pool.columns))


# ------------------------------------------------------------------ diagnostics
def pair_stats(chosen: DataFrame) -> DataFrame:
    """Mean pairwise kind similarity and closest pair per country of a selection.

    A selection holds at most ``quota_max`` rows per country, so its pairs are few.
    """
    a = chosen.select("country", "candidate_id", "lat", "lon", "kinds")
    b = a.select("country", F.col("candidate_id").alias("id_b"), F.col("lat").alias("lat_b"),
                 F.col("lon").alias("lon_b"), F.col("kinds").alias("kinds_b"))
    pairs = a.join(b, "country").where(F.col("candidate_id") < F.col("id_b"))
    km = geo.tick(geo.haversine("lat", "lon", "lat_b", "lon_b"))
    stats = pairs.groupBy("country").agg(F.avg(kinds.cosine(F.col("kinds"), F.col("kinds_b"))).alias("redundancy"),
                                         F.min(km).alias("closest_km"))
    sizes = a.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(stats, "country", "left").withColumn("redundancy", F.coalesce("redundancy", F.lit(0.0)))


def spacing_conflicts(kept: DataFrame, quotas: DataFrame, p: Params = PARAMS) -> DataFrame:
    """Pairs among a country's first ``3 n`` places too close to both be drilled."""
    best = W.partitionBy("country").orderBy(F.col("score").desc(), "candidate_id")
    facts = quotas.select("country", "quota", geo.min_spacing(F.col("area_km2"), F.col("quota"), p).alias("d_min"))
    top = (kept.select("country", "candidate_id", "name", "lat", "lon", "score")
           .withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= 3 * p.quota_max)
           .join(facts, "country").where(F.col("_nth") <= 3 * F.greatest("quota", F.lit(1))))
    b = spatial.as_right(top.select("country", "candidate_id", "name", "lat", "lon", "_nth"), id_b="candidate_id", b="name", _nth_b="_nth")
    pairs = top.join(b, "country").where(F.col("_nth") < F.col("_nth_b"))
    return (pairs.withColumn("km", geo.tick(geo.haversine("lat", "lon", "r_lat", "r_lon"))).where(F.col("km") < F.col("d_min"))
            .select("country", F.col("candidate_id").alias("id_a"), "id_b", F.col("name").alias("a"), "b", F.bround("km", 1).alias("km")))


def conflict_summary(conflicts: DataFrame, width_m: float = 3.0) -> DataFrame:
    """Pairs, closest pair and inset magnification per country."""
    out = conflicts.groupBy("country").agg(F.count(F.lit(1)).alias("pairs"), F.min("km").alias("closest_km"))
    return out.withColumn("inset", geo.inset_factor(F.greatest(F.col("closest_km"), F.lit(1e-9)), width_m))
