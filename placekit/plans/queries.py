"""Registered queries: scoring, kinds and assignment.

Each query is a function of (spark, folder) returning a DataFrame; where plain SQL can say the
same, the SQL sits beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placekit.functions import kinds
from placekit.functions.vocab import KIND_CODES, PARAMS, TIER_NAMES
from placekit.operators import assets, classify, resolve, scoring, signals, spatial
from placekit.plans.fixtures import Views
from placekit.plans.oracles import km, sql
from placekit.plans.session import cut, tune

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(tune(spark), sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return fn

    return keep


def r6(c):
    """Six digits; the nudge keeps exact halves from depending on the last bit."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


# ------------------------------------------------------------------ shared frames
def candidates(v: Views) -> DataFrame:
    """The candidate frame of the driver's tables, before any asset is attached."""
    forms = v.landform.groupBy("candidate_id").agg(F.array_sort(F.collect_list("landform")).alias("landforms"))
    profile = F.map_from_arrays(F.array(*[F.lit(k) for k in ("language", "religion", "vernacular", "cuisine")]),
                                F.array("language", "religion", "vernacular", "cuisine"))
    rows = (v.cand.join(v.attr, "candidate_id").join(forms, "candidate_id", "left").join(v.country, "n")
            .withColumn("profile", profile).withColumn("sources", F.array("source"))
            .withColumn("landforms", F.coalesce("landforms", F.array().cast("array<string>"))))
    return resolve.complete(rows)


def asset_rows(v: Views) -> DataFrame:
    return v.asset.join(v.country.select("n", "country"), "n")


def attached(v: Views) -> DataFrame:
    """Candidates with their point and area assets and derived kinds."""
    cands = cut(candidates(v))
    point, area = assets.split_point_and_area(cut(asset_rows(v)))
    held = assets.attach(cands, assets.assign(cands, point), assets.fan_out(cands, area))
    # scoring reads this several times (per country, then per candidate)
    return cut(classify.derive(held))


def long_tiers(cands: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(t).alias("tier"), kinds.tier(F.col("tiers"), t).alias("n")) for t in TIER_NAMES])
    return cands.select("candidate_id", F.explode(pairs).alias("p")).select("candidate_id", "p.*").where(F.col("n") > 0)


def long_kinds(df: DataFrame, key: str = "candidate_id", col: str = "kinds") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), kinds.at(F.col(col), c).alias("weight")) for c in KIND_CODES])
    return df.select(key, F.explode(pairs).alias("p")).select(key, "p.*").where(F.col("weight") > 0)


# ------------------------------------------------------------------ assignment
@query("nearest_asset_assignment", sql("SELECT asset_id, tier, candidate_id, km FROM near", "near"))
def _(v):
    point, _ = assets.split_point_and_area(cut(v.asset))
    return assets.assign(cut(v.cand), point).select("asset_id", "tier", "candidate_id", "km")


@query("orphan_assets", sql("""SELECT asset_id, tier FROM asset WHERE radius_km = 0
  AND asset_id NOT IN (SELECT asset_id FROM near)""", "asset", "near"))
def _(v):
    point, _ = assets.split_point_and_area(cut(v.asset))
    return assets.orphans(point, assets.assign(cut(v.cand), point)).select("asset_id", "tier")


@query("area_fanout", sql("SELECT asset_id, candidate_id, km, nth::INT AS nth FROM fan", "fan"))
def _(v):
    _, area = assets.split_point_and_area(cut(v.asset))
    return assets.fan_out(cut(v.cand), area).select("asset_id", "candidate_id", "km", "nth")


@query("tier_counts", sql("SELECT candidate_id, tier, n FROM tn", "tn"))
def _(v):
    return long_tiers(attached(v))


@query("coherence", sql("""SELECT candidate_id, round(max(m) / sum(m) + 1e-9, 6) AS coherence FROM (
  SELECT candidate_id, trunc(lat / (1.0 / 111.32)) AS gy, trunc(lon / (1.0 / 111.32)) AS gx, count(*) AS m
  FROM near JOIN tw USING (tier) WHERE pillar = 'H' GROUP BY ALL) GROUP BY ALL""", "near", "tw"))
def _(v):
    point, _ = assets.split_point_and_area(cut(v.asset))
    return assets.coherence(assets.assign(cut(v.cand), point)).select("candidate_id", r6("coherence").alias("coherence"))


@query("close_pairs", sql(f"""SELECT a.candidate_id AS id_a, b.candidate_id AS id_b, c.country, {km('a', 'b')} AS km
  FROM cand a JOIN cand b ON a.n = b.n AND a.candidate_id < b.candidate_id
    AND b.lat BETWEEN a.lat - 0.2 AND a.lat + 0.2 AND b.lon BETWEEN a.lon - 0.3 AND a.lon + 0.3
  JOIN country c ON c.n = a.n WHERE {km('a', 'b')} <= 15""", "cand", "country"))
def _(v):
    return resolve.close_pairs(candidates(v), 15.0).select("id_a", "id_b", "country", "km")


@query("nearby_places", sql(f"""SELECT place_id, near_id, km, nth::INT AS nth FROM (
  SELECT a.place_id, b.place_id AS near_id, {km('a', 'b')} AS km,
    row_number() OVER (PARTITION BY a.place_id ORDER BY {km('a', 'b')}, b.place_id) AS nth
  FROM pin a JOIN pin b ON a.place_id <> b.place_id AND b.lat BETWEEN a.lat - 1.1 AND a.lat + 1.1 AND b.lon BETWEEN a.lon - 1.6 AND a.lon + 1.6
  WHERE {km('a', 'b')} <= 120) WHERE nth <= 8""", "pin"))
def _(v):
    from placekit.operators.serve import nearby

    return nearby(v.pin).select("place_id", "near_id", "km", "nth")


@query("signal_points_to_nearest", sql(f"""SELECT DISTINCT place_id FROM (
  SELECT c.candidate_id AS place_id, row_number() OVER (PARTITION BY a.asset_id ORDER BY {km('a', 'c')}, c.candidate_id) AS rn
  FROM asset a JOIN cand c ON c.lat BETWEEN a.lat - 0.2 AND a.lat + 0.2 AND c.lon BETWEEN a.lon - 0.3 AND a.lon + 0.3
  WHERE {km('a', 'c')} <= 15) WHERE rn = 1""", "asset", "cand"))
def _(v):
    points = v.asset.select(F.col("asset_id").alias("point_id"), "lat", "lon")
    places = v.cand.withColumnRenamed("candidate_id", "place_id")
    return signals.points_to_nearest(places, points, signals.CAPITAL_KM).select("place_id").distinct()


@query("nearest_qualifying", sql(f"""SELECT place_id, kind, w AS weight FROM (
  SELECT s.candidate_id AS place_id, t.candidate_id AS src, row_number() OVER (PARTITION BY s.candidate_id ORDER BY {km('s', 't')}, t.candidate_id) AS rn
  FROM cand s JOIN cand t ON s.is_site AND NOT t.is_site AND t.lat BETWEEN s.lat - 0.6 AND s.lat + 0.6 AND t.lon BETWEEN s.lon - 1 AND s.lon + 1
  WHERE {km('s', 't')} <= 60 AND t.candidate_id IN (SELECT candidate_id FROM landform JOIN lkind USING (landform) WHERE w >= 0.3)) p
  JOIN (SELECT candidate_id, kind, max(w) AS w FROM landform JOIN lkind USING (landform) WHERE w >= 0.3 GROUP BY ALL) k ON k.candidate_id = p.src
  WHERE rn = 1""", "cand", "landform", "lkind"))
def _(v):
    forms = v.landform.groupBy("candidate_id").agg(F.collect_list("landform").alias("forms"))
    rows = v.cand.where(~F.col("is_site")).join(forms, "candidate_id").withColumnRenamed("candidate_id", "source_id")
    places = v.cand.where("is_site").withColumnRenamed("candidate_id", "place_id")
    return long_kinds(signals.nearest_qualifying(places, rows), "place_id", "near_vec")


# ------------------------------------------------------------------ scoring
@query("tiered_sums", sql("SELECT candidate_id, pillar, round(s + 1e-9, 6) AS tiered FROM tsum", "tsum"))
def _(v):
    c = attached(v)
    pairs = F.array(*[F.struct(F.lit(p).alias("pillar"), r6(scoring.tiered_sum("tiers", p)).alias("tiered")) for p in "HNL"])
    return c.select("candidate_id", F.explode(pairs).alias("p")).select("candidate_id", "p.*").where(F.col("tiered") > 0)


@query("cross_country_sums", sql("""SELECT candidate_id, round(sum(w * (1 - pow(0.95, n)) / (1 - 0.95)) + 1e-9, 6) AS tiered FROM (
  SELECT candidate_id, pillar, weight AS w, sum(n) AS n FROM tn JOIN tw USING (tier) WHERE cross_ok GROUP BY ALL) GROUP BY ALL""", "tn", "tw"))
def _(v):
    total = sum((scoring.tiered_sum("tiers", p, cross_country=True) for p in "HNL"), F.lit(0.0))
    return attached(v).select("candidate_id", r6(total).alias("tiered")).where(F.col("tiered") > 0)


@query("pillars", sql("SELECT candidate_id, round(h_raw + 1e-9, 6) AS h_raw, round(n_raw + 1e-9, 6) AS n_raw, round(l_raw + 1e-9, 6) AS l_raw FROM raw", "raw"))
def _(v):
    return scoring.pillars(attached(v)).select("candidate_id", *[r6(c).alias(c) for c in ("h_raw", "n_raw", "l_raw")])


@query("landform_rarity", sql("""SELECT country, landform, instances, round(weight + 1e-9, 6) AS weight FROM lfw JOIN country USING (n)""", "lfw", "country"))
def _(v):
    rows = scoring.landform_instances(candidates(v))
    w = scoring.landform_weight(F.col("landform"), F.col("instances") <= 1)
    return rows.select("country", "landform", "instances", r6(w).alias("weight"))


@query("modal_profile", sql("""SELECT country, key, value AS mode FROM (
  SELECT country, key, value, row_number() OVER (PARTITION BY country, key ORDER BY round(sum(w), 9) DESC, value) AS rn FROM (
    SELECT c.country, greatest(population / 1e6, 0.01) AS w, u.key, u.value FROM cand JOIN attr USING (candidate_id) JOIN country c USING (n),
      LATERAL (VALUES ('language', language), ('religion', religion), ('vernacular', vernacular), ('cuisine', cuisine)) AS u(key, value))
  GROUP BY country, key, value) WHERE rn = 1""", "cand", "attr", "country"))
def _(v):
    return scoring.modal_profile(candidates(v))


@query("population_p75", sql("""SELECT country, population FROM (
  SELECT c.country, population, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY c.country) AS m
  FROM cand JOIN country c USING (n) WINDOW w AS (PARTITION BY c.country ORDER BY population, candidate_id))
  WHERE i = floor(0.75 * (m - 1))""", "cand", "country"))
def _(v):
    return scoring.order_statistic(v.cand.join(v.country, "n"), "country", "population", 0.75)


_MODES = """modes AS (SELECT country, max(CASE WHEN key = 'language' THEN value END) AS language, max(CASE WHEN key = 'religion' THEN value END) AS religion,
  max(CASE WHEN key = 'vernacular' THEN value END) AS vernacular, max(CASE WHEN key = 'cuisine' THEN value END) AS cuisine FROM (
  SELECT country, key, value, row_number() OVER (PARTITION BY country, key ORDER BY round(sum(w), 9) DESC, value) AS rn FROM (
    SELECT c.country, greatest(population / 1e6, 0.01) AS w, u.key, u.value FROM cand JOIN attr USING (candidate_id) JOIN country c USING (n),
      LATERAL (VALUES ('language', language), ('religion', religion), ('vernacular', vernacular), ('cuisine', cuisine)) AS u(key, value))
  GROUP BY country, key, value) WHERE rn = 1 GROUP BY country),
p75 AS (SELECT country, population AS p FROM (
  SELECT c.country, population, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY c.country) AS m
  FROM cand JOIN country c USING (n) WINDOW w AS (PARTITION BY c.country ORDER BY population, candidate_id)) WHERE i = floor(0.75 * (m - 1)))"""


@query("distinctiveness", sql("", "cand", "attr", "country").rstrip() + ",\n" + _MODES + """
SELECT candidate_id, round(1 + 0.6 * raw * CASE WHEN is_site THEN greatest(sat, 0.35) ELSE sat END + 1e-9, 6) AS distinctiveness FROM (
  SELECT candidate_id, is_site, (CASE WHEN a.language = m.language THEN 0 WHEN split_part(a.language, ':', 1) = split_part(m.language, ':', 1) THEN 0.5 ELSE 1 END
      + (a.religion <> m.religion)::INT + (a.vernacular <> m.vernacular)::INT + (a.cuisine <> m.cuisine)::INT) / 4.0 AS raw,
    least(sqrt(greatest(population / 1e6, 1e-4)), sqrt(greatest(p / 1e6, 1e-4))) / sqrt(greatest(p / 1e6, 1e-4)) AS sat
  FROM cand JOIN attr a USING (candidate_id) JOIN country c USING (n) JOIN modes m ON m.country = c.country JOIN p75 ON p75.country = c.country)""")
def _(v):
    out = scoring.distinctiveness(candidates(v), PARAMS.with_(beta=0.6))
    return out.select("candidate_id", r6("distinctiveness").alias("distinctiveness"))


@query("feasibility", sql("SELECT candidate_id, round(feasibility + 1e-9, 6) AS feasibility FROM feas", "feas"))
def _(v):
    return v.attr.select("candidate_id", r6(scoring.feasibility()).alias("feasibility"))


@query("country_scores", sql("""SELECT candidate_id, round(h + 1e-9, 6) AS h, round(nn + 1e-9, 6) AS n, round(liv + 1e-9, 6) AS liv, round(base + 1e-9, 6) AS base,
  round(score + 1e-9, 6) AS score FROM scored""", "scored"))
def _(v):
    return scoring.score(attached(v)).select("candidate_id", *[r6(c).alias(c) for c in ("h", "n", "liv", "base", "score")])


@query("score_0_100", sql("SELECT candidate_id, score100 FROM top100", "top100"))
def _(v):
    return scoring.above_floor(scoring.score(attached(v))).select("candidate_id", "score100")


@query("quotas", sql("""SELECT country, kinds_covered, global_assets, round(quality + 1e-9, 6) AS quality, quota FROM quota""", "quota"))
def _(v):
    facts = scoring.country_facts(scoring.score(attached(v)), v.country)
    return scoring.quotas(facts).select("country", "kinds_covered", "global_assets", r6("quality").alias("quality"), "quota")


@query("top_per_country", sql("""SELECT country, candidate_id, name, score100 FROM (
  SELECT country, candidate_id, name, score100, row_number() OVER (PARTITION BY n ORDER BY score100 DESC, name, candidate_id) AS rn
  FROM top100 JOIN cand USING (candidate_id, n) JOIN country USING (n)) WHERE rn <= 12""", "top100", "cand", "country"))
def top_per_country(v):
    """Flagship: assets to candidates to scores to the best twelve of each country."""
    from placekit.operators.serve import cap_per_country

    places = scoring.above_floor(scoring.score(attached(v))).select(
        F.col("country").alias("iso3"), F.col("candidate_id").alias("place_id"), "name", F.col("score100").alias("score"))
    return cap_per_country(places, 12).select(F.col("iso3").alias("country"), F.col("place_id").alias("candidate_id"), "name", F.col("score").alias("score100"))


@query("explain_scores", sql("""SELECT s.candidate_id, round(100 * score / max(score) OVER (PARTITION BY s.n)) AS of_top, round(h, 3) AS h, round(nn, 3) AS n,
  round(liv, 3) AS liv, round(feasibility, 2) AS feasibility, t.tiers FROM scored s
  LEFT JOIN (SELECT candidate_id, string_agg(tier || '×' || n, ', ' ORDER BY n DESC, tier) AS tiers FROM tn GROUP BY ALL) t USING (candidate_id)""", "scored", "tn"))
def _(v):
    from placekit.operators.reports import explain_scores

    out = explain_scores(scoring.score(attached(v)))
    return out.select("candidate_id", F.round("of_top", 0).alias("of_top"), F.round("h", 3).alias("h"), F.round("n", 3).alias("n"),
                      F.round("liv", 3).alias("liv"), F.round("feasibility", 2).alias("feasibility"), "tiers")


# ------------------------------------------------------------------ kinds
@query("derive_kinds", sql("SELECT candidate_id, kind, w AS weight FROM kv", "kv"))
def _(v):
    return long_kinds(attached(v))


@query("merge_kinds", sql("""SELECT candidate_id, kind, round_even(w, 3) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY w DESC, ord) AS rn FROM (
    SELECT candidate_id, kind, max(w) AS w FROM (
      SELECT candidate_id, kind, w FROM landform JOIN lkind USING (landform) WHERE w >= 0.3
      UNION ALL SELECT candidate_id, kind, w FROM attr JOIN skind USING (source)) GROUP BY ALL) JOIN kindtab USING (kind))
  WHERE rn <= 4 AND w >= 0.3""", "landform", "lkind", "attr", "skind", "kindtab"))
def _(v):
    c = candidates(v)
    merged = kinds.merge(classify.qualifying_landforms(), classify.from_sources())
    return long_kinds(c.withColumn("kinds", merged))


@query("kind_bitmask", sql("""SELECT candidate_id, sum(1 << (ord - 1)::INT)::INT AS mask, bool_or(kind = 'A9') AS wild FROM kv GROUP BY ALL""", "kv"))
def _(v):
    m = kinds.mask(F.col("kinds"))
    return attached(v).select("candidate_id", m.alias("mask"), kinds.has(m, "A9").alias("wild"))


@query("dominant_kinds", sql("""SELECT candidate_id, string_agg(kind, '/' ORDER BY w DESC, ord) AS kinds FROM (
  SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY w DESC, ord) AS rn FROM kv WHERE w >= 0.45) WHERE rn <= 3 GROUP BY ALL""", "kv"))
def _(v):
    out = attached(v).select("candidate_id", F.array_join(kinds.dominant(F.col("kinds")), "/").alias("kinds"))
    return out.where(F.col("kinds") != "")


@query("kind_similarity", sql(f"""SELECT p.site_id, p.host_id, round(coalesce(sum(a.w * b.w) / min(la.len) / min(lb.len), 0) + 1e-9, 6) AS similarity FROM (
  SELECT * FROM (SELECT s.candidate_id AS site_id, t.candidate_id AS host_id, row_number() OVER (PARTITION BY s.candidate_id ORDER BY {km('s', 't')}, t.candidate_id) AS rn
    FROM cand s JOIN cand t ON s.is_site AND NOT t.is_site AND t.lat BETWEEN s.lat - 0.6 AND s.lat + 0.6 AND t.lon BETWEEN s.lon - 1 AND s.lon + 1
    WHERE {km('s', 't')} <= 60) WHERE rn = 1) p
  LEFT JOIN kv a ON a.candidate_id = p.site_id LEFT JOIN kv b ON b.candidate_id = p.host_id AND b.kind = a.kind
  LEFT JOIN knorm la ON la.candidate_id = p.site_id LEFT JOIN knorm lb ON lb.candidate_id = p.host_id GROUP BY ALL""", "cand", "kv", "knorm"))
def _(v):
    c = cut(attached(v))
    sites, towns = c.where("is_site"), c.where(~F.col("is_site"))
    near = spatial.nearest(sites.select("candidate_id", "lat", "lon"), spatial.as_right(towns.select("candidate_id", "lat", "lon"), host_id="candidate_id"),
                           60.0, "candidate_id", "host_id")
    pairs = near.join(sites.select("candidate_id", F.col("kinds").alias("a")), "candidate_id").join(
        towns.select(F.col("candidate_id").alias("host_id"), F.col("kinds").alias("b")), "host_id")
    return pairs.select(F.col("candidate_id").alias("site_id"), "host_id", r6(kinds.cosine(F.col("a"), F.col("b"))).alias("similarity"))


@query("covered_kinds", sql("""SELECT DISTINCT c.country, kind FROM kv JOIN knorm USING (candidate_id) JOIN cand USING (candidate_id)
  JOIN country c ON c.n = cand.n WHERE w / len >= 0.45""", "kv", "knorm", "cand", "country"))
def _(v):
    masks = attached(v).groupBy("country").agg(F.bit_or(kinds.covered_mask(F.col("kinds"))).alias("m"))
    return masks.select("country", F.explode(kinds.decode(F.col("m"))).alias("kind"))


@query("kind_counts", sql("""SELECT country AS iso3, kind, count(*) AS n FROM kv JOIN cand USING (candidate_id) JOIN country USING (n)
  GROUP BY GROUPING SETS ((country, kind), (kind))""", "kv", "cand", "country"))
def _(v):
    from placekit.operators.serve import kind_counts

    return kind_counts(attached(v).select(F.col("country").alias("iso3"), kinds.mask(F.col("kinds")).alias("kmask")))


@query("country_index", sql("""SELECT iso3, count(*) AS places, count(*) FILTER (printed) AS holes, bit_count(bit_or(kmask))::INT AS kinds FROM pin GROUP BY ALL""", "pin"))
def _(v):
    from placekit.operators.serve import country_index

    return country_index(v.pin)


@query("provenance_counts", sql("SELECT source, count(*) AS places FROM pin GROUP BY ALL", "pin"))
def _(v):
    from placekit.operators.serve import provenance_counts

    return provenance_counts(v.pin.withColumn("sources", F.array("source")))


from placekit.plans import queries_land, queries_records, queries_resolve, queries_serve  # noqa: E402,F401
