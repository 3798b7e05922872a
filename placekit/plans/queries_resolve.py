"""Registered queries: entity resolution, selection, identity, gates and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from placekit.functions import geo, kinds
from placekit.functions.vocab import KIND_DOMINANT, PARAMS, PROTECTED_SOURCES, PROTECTED_TIERS
from placekit.operators import gates, identity, reports, resolve, scoring, selection, signals
from placekit.plans import build as jobs
from placekit.plans.oracles import km, sql
from placekit.plans.queries import asset_rows, attached, candidates, long_kinds, query, r6
from placekit.plans.session import cut


def _built(v) -> jobs.BuildResult:
    return jobs.build(candidates(v), asset_rows(v), v.country)


# ------------------------------------------------------------------ resolution
@query("transliteration_merge", sql("""SELECT country, guest_id, host_id, 'transliteration' AS decision FROM (
  SELECT c.country, b.candidate_id AS guest_id, a.candidate_id AS host_id FROM cand a JOIN cand b ON a.n = b.n AND round_even(a.lat, 3) = round_even(b.lat, 3)
    AND round_even(a.lon, 3) = round_even(b.lon, 3) AND a.candidate_id <> b.candidate_id JOIN country c ON c.n = a.n
    JOIN attr x ON x.candidate_id = a.candidate_id JOIN attr y ON y.candidate_id = b.candidate_id
  WHERE (levenshtein(regexp_replace(lower(a.name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(b.name), '[^a-z0-9]', '', 'g')) <= 2)
    AND ((a.population >= 50000)::INT, (x.source = 'wdpa')::INT, a.population, -length(a.name)) > ((b.population >= 50000)::INT, (y.source = 'wdpa')::INT, b.population, -length(b.name))
    OR (a.n = b.n AND round_even(a.lat, 3) = round_even(b.lat, 3) AND round_even(a.lon, 3) = round_even(b.lon, 3) AND a.candidate_id < b.candidate_id
      AND ((a.population >= 50000)::INT, (x.source = 'wdpa')::INT, a.population, -length(a.name)) = ((b.population >= 50000)::INT, (y.source = 'wdpa')::INT, b.population, -length(b.name))))""",
  "cand", "attr", "country"))
def _(v):
    return resolve.merge_transliterations(candidates(v)).log.select("country", "guest_id", "host_id", "decision")


@query("strength_and_radius", sql("""SELECT candidate_id, source <> 'wdpa' AS harvest_only, source <> 'wdpa' AND population < 50000 AS density_extra,
  CASE WHEN population >= 1000000 THEN 18 WHEN population >= 500000 THEN 14 WHEN population >= 250000 THEN 12 WHEN population >= 50000 THEN 8 ELSE 5 END::DOUBLE AS radius_km
  FROM cand JOIN attr USING (candidate_id)""", "cand", "attr"))
def _(v):
    return candidates(v).select("candidate_id", resolve.harvest_only().alias("harvest_only"), resolve.density_extra().alias("density_extra"),
                                resolve.city_radius(F.col("population")).alias("radius_km"))


@query("harvest_spacing", sql("""SELECT country, round(greatest(8, 0.35 * sqrt(area_km2 / (m * (8 + 4 * ln(1 + area_km2 / 50000.0))))) + 1e-9, 6) AS spacing_km FROM (
  SELECT c.country, area_km2, count(DISTINCT kind) AS m FROM kv JOIN cand USING (candidate_id) JOIN country c ON c.n = cand.n GROUP BY ALL)""", "kv", "cand", "country"))
def _(v):
    rows = resolve.density_rows(attached(v), v.country)
    return rows.select("country", r6("spacing").alias("spacing_km")).distinct()


def _walked(final: str, *needs: str) -> str:
    """SQL with views that call themselves, one step of an ordered walk at a time."""
    return sql("", *needs).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + final


def _closest(rows: str, at: str) -> str:
    """The nearest of a list of places, of equal ones the first of the list, as a list of none or one."""
    return f"list_sort(list_transform({rows}, lambda q: {{'km': {km(at, 'q')}, 'rn': q.rn, 'id': q.id}}))[1]"


# heads from the largest on; the one that is on grows wave by wave, then the next is on
_REACH = "CASE WHEN h.heads >= 1000000 THEN 18 WHEN h.heads >= 500000 THEN 14 WHEN h.heads >= 250000 THEN 12 WHEN h.heads >= 50000 THEN 8 ELSE 5 END"
_GROWTH = _walked(f""",
town AS (SELECT c.country, candidate_id AS id, cand.lat, cand.lon, population AS heads, source <> 'wdpa' AS harvest,
    row_number() OVER (PARTITION BY c.country ORDER BY population DESC, candidate_id) AS rn
  FROM cand JOIN attr USING (candidate_id) JOIN country c USING (n) WHERE NOT is_site),
walk AS (SELECT country, 0 AS step, 1 AS i, list({{'rn': rn, 'id': id, 'lat': lat, 'lon': lon, 'heads': heads, 'harvest': harvest}} ORDER BY rn) AS alive, []::STRUCT(guest VARCHAR, host VARCHAR, km DOUBLE)[] AS folds
    FROM town GROUP BY country
  UNION ALL SELECT country, step + 1, CASE WHEN len(got) = 0 THEN i + 1 ELSE i END,
    list_transform(list_filter(alive, lambda q: NOT list_contains(list_transform(got, lambda g: g.id), q.id)),
      lambda q: {{'rn': q.rn, 'id': q.id, 'lat': q.lat, 'lon': q.lon, 'heads': CASE WHEN q.rn = i AND len(got) > 0 THEN q.heads + list_sum(list_transform(got, lambda g: g.heads)) ELSE q.heads END, 'harvest': q.harvest}}),
    list_concat(folds, list_transform(got, lambda g: {{'guest': g.id, 'host': h.id, 'km': {km('h', 'g')}}})) FROM (
      SELECT *, CASE WHEN h IS NULL OR h.heads <= 0 THEN [] ELSE list_filter(alive, lambda q: q.harvest AND q.rn <> i AND q.heads <= h.heads * {PARAMS.suburb_share} AND {km('h', 'q')} <= {_REACH}) END AS got
      FROM (SELECT *, list_filter(alive, lambda q: q.rn = i)[1] AS h FROM walk WHERE i <= (SELECT max(rn) FROM town t WHERE t.country = walk.country))))
SELECT country, f.guest AS guest_id, f.host AS host_id, round_even(f.km, 1) AS km FROM (SELECT country, unnest(folds) AS f FROM (SELECT country, max_by(folds, step) AS folds FROM walk GROUP BY country))""",
    "cand", "attr", "country")


@query("agglomerate", _GROWTH)
def _(v):
    return resolve.agglomerate(candidates(v)).log.select("country", "guest_id", "host_id", "km")


# each host's sites in the order of their ids; what it takes in lifts its kinds
_SITES = _walked(f""",
beside AS (SELECT site_id, host_id, n, km FROM (SELECT s.candidate_id AS site_id, t.candidate_id AS host_id, s.n, {km('s', 't')} AS km, row_number() OVER (PARTITION BY s.candidate_id ORDER BY {km('s', 't')}, t.candidate_id) AS rn
    FROM cand s JOIN cand t ON s.is_site AND NOT t.is_site AND t.lat BETWEEN s.lat - 0.6 AND s.lat + 0.6 AND t.lon BETWEEN s.lon - 1 AND s.lon + 1 WHERE {km('s', 't')} <= 60) WHERE rn = 1),
vec AS (SELECT candidate_id, list(coalesce(w, 0) ORDER BY k.ord) AS w FROM (SELECT candidate_id, kindtab.ord FROM cand, kindtab) k LEFT JOIN (SELECT candidate_id, ord, w FROM kv) USING (candidate_id, ord) GROUP BY candidate_id),
site AS (SELECT b.*, s.w AS mine, t.w AS held, row_number() OVER (PARTITION BY host_id ORDER BY site_id) AS rn FROM beside b JOIN vec s ON s.candidate_id = site_id JOIN vec t ON t.candidate_id = host_id),
walk AS (SELECT DISTINCT host_id, 0::BIGINT AS i, held, ''::VARCHAR AS site_id, 0::INT AS n, 0::DOUBLE AS km, 0::DOUBLE AS similarity FROM site
  UNION ALL SELECT host_id, rn, CASE WHEN sim >= {PARAMS.absorb_similarity} THEN list_transform(range(1, 13), lambda k: greatest(held[k], mine[k] * 0.8)) ELSE held END, site_id, n, km, sim FROM (
    SELECT w.host_id, s.rn, w.held, s.mine, s.site_id, s.n, s.km, CASE WHEN list_sum(list_transform(s.mine, lambda x: x * x)) > 0 AND list_sum(list_transform(w.held, lambda x: x * x)) > 0
      THEN list_sum(list_transform(range(1, 13), lambda k: s.mine[k] * w.held[k])) / sqrt(list_sum(list_transform(s.mine, lambda x: x * x))) / sqrt(list_sum(list_transform(w.held, lambda x: x * x))) ELSE 0 END AS sim
    FROM walk w JOIN site s ON s.host_id = w.host_id AND s.rn = w.i + 1))
SELECT c.country, site_id AS guest_id, host_id, CASE WHEN similarity >= {PARAMS.absorb_similarity} THEN 'absorbed' ELSE 'retained' END AS decision, round_even(km, 0) AS km, round_even(similarity, 2) AS similarity
FROM walk JOIN country c USING (n) WHERE i > 0""", "cand", "kv", "kindtab", "country")


@query("absorb_sites", _SITES)
def _(v):
    return resolve.absorb_sites(cut(attached(v))).log.select("country", "guest_id", "host_id", "decision", "km", "similarity")


_PROTECTED = ", ".join(f"'{t}'" for t in PROTECTED_TIERS)
_SAFE = ", ".join(f"'{s}'" for s in PROTECTED_SOURCES)
# candidates with their assets from the strongest on, per country
_STRONG = f""",
held AS (SELECT candidate_id, count(DISTINCT source) AS sources, count(DISTINCT source) FILTER (source IN ({_SAFE})) AS safe FROM (
  SELECT candidate_id, source FROM attr UNION ALL SELECT candidate_id, source FROM near UNION ALL SELECT candidate_id, source FROM fan) GROUP BY ALL),
tiers AS (SELECT candidate_id, sum(n) AS total, coalesce(sum(n) FILTER (tier IN ({_PROTECTED})), 0) AS safe FROM tn GROUP BY ALL),
seen AS (SELECT candidate_id, sum(1 << (ord - 1)::INT)::INT AS kmask, min_by(kind, (-w, ord)) AS kind FROM kv WHERE w > 0 GROUP BY ALL),
strong AS MATERIALIZED (SELECT country, area_km2, id, lat, lon, kmask, kind, extra, row_number() OVER (PARTITION BY country ORDER BY city DESC, listed DESC, population DESC, sources DESC, total DESC, length(name), id) AS rn FROM (
  SELECT c.country, c.area_km2, cand.candidate_id AS id, cand.lat, cand.lon, name, population, population >= 50000 AS city, coalesce(t.safe, 0) + held.safe > 0 AS listed, sources, coalesce(t.total, 0) AS total,
    coalesce(kmask, 0) AS kmask, kind, coalesce(t.safe, 0) + held.safe = 0 AND population < 50000 AND kind IS NOT NULL AS extra
  FROM cand JOIN held USING (candidate_id) LEFT JOIN tiers t USING (candidate_id) LEFT JOIN seen USING (candidate_id) JOIN country c USING (n)))"""


@query("absorb_near_duplicates", _walked(_STRONG + f""",
walk AS (SELECT DISTINCT country, 0::BIGINT AS i, []::STRUCT(rn BIGINT, id VARCHAR, lat DOUBLE, lon DOUBLE, kmask INT)[] AS got, NULL::STRUCT(km DOUBLE, rn BIGINT, id VARCHAR) AS host, ''::VARCHAR AS id FROM strong
  UNION ALL SELECT country, rn, CASE WHEN best IS NULL THEN list_append(got, {{'rn': rn, 'id': id, 'lat': lat, 'lon': lon, 'kmask': kmask}})
      ELSE list_transform(got, lambda q: {{'rn': q.rn, 'id': q.id, 'lat': q.lat, 'lon': q.lon, 'kmask': CASE WHEN q.id = best.id THEN q.kmask | kmask ELSE q.kmask END}}) END, best, id FROM (
    SELECT s.*, w.got, {_closest(f"list_filter(w.got, lambda q: (s.kmask = 0 OR q.kmask = 0 OR (s.kmask & q.kmask) <> 0) AND {km('s', 'q')} <= {PARAMS.close_pair_km})", 's')} AS best
    FROM walk w JOIN strong s ON s.country = w.country AND s.rn = w.i + 1))
SELECT country, id AS guest_id, host.id AS host_id, round_even(host.km, 2) AS km FROM walk WHERE host IS NOT NULL""", "cand", "attr", "kv", "tn", "near", "fan", "country"))
def _(v):
    return resolve.absorb_near_duplicates(cut(attached(v))).log.select("country", "guest_id", "host_id", "km")


# row by row; where a country stays crowded its kept rows go again at a wider spacing
@query("density_cap", _walked(_STRONG + f""",
fact AS (SELECT country, greatest(m, 1) * (8 + 4 * ln(1 + greatest(area_km2, 1) / 50000.0)) AS target, greatest(area_km2, 1) AS area_km2 FROM (
  SELECT s.country, any_value(area_km2) AS area_km2, count(DISTINCT kv.kind) AS m FROM strong s LEFT JOIN kv ON kv.candidate_id = s.id AND kv.w > 0 GROUP BY s.country)),
walk AS (SELECT country, 0 AS step, 1 AS i, target, greatest({PARAMS.harvest_min_spacing_km}, {PARAMS.harvest_spacing_coef} * sqrt(any_value(f.area_km2) / greatest(target, 1))) AS spacing,
    list({{'rn': rn, 'id': id, 'lat': lat, 'lon': lon, 'kind': kind, 'extra': extra}} ORDER BY rn) AS alive, []::STRUCT(rn BIGINT, id VARCHAR, lat DOUBLE, lon DOUBLE, kind VARCHAR, extra BOOLEAN)[] AS got,
    NULL::STRUCT(km DOUBLE, rn BIGINT, id VARCHAR) AS host, ''::VARCHAR AS id FROM strong JOIN fact f USING (country) GROUP BY country, target
  UNION ALL SELECT country, step + 1, CASE WHEN again THEN 1 ELSE i + 1 END, target, CASE WHEN again THEN least({PARAMS.harvest_max_spacing_km}, spacing * 1.25) ELSE spacing END,
    CASE WHEN again THEN got ELSE alive END, CASE WHEN again THEN [] WHEN best IS NULL THEN list_append(got, s) ELSE got END, CASE WHEN again THEN NULL ELSE best END, s.id FROM (
    SELECT *, CASE WHEN s.extra THEN {_closest(f"list_filter(got, lambda q: q.kind = s.kind AND {km('s', 'q')} <= spacing)", 's')} END AS best FROM (
      SELECT *, alive[i] AS s, i > len(alive) AS again FROM walk WHERE i <= len(alive) OR (len(got) > target * 1.5 AND spacing < {PARAMS.harvest_max_spacing_km}))))
SELECT country, id AS guest_id, host.id AS host_id, round_even(host.km, 1) AS km FROM walk WHERE host IS NOT NULL""", "cand", "attr", "kv", "tn", "near", "fan", "country"))
def _(v):
    return resolve.cap_density(cut(attached(v)), v.country).log.select("country", "guest_id", "host_id", "km")


@query("orphan_sites", sql("", "asset", "near", "tw", "country").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
heavy AS MATERIALIZED (SELECT asset_id AS id, n, lat, lon, row_number() OVER (ORDER BY weight DESC, asset_id) AS rn FROM asset JOIN tw USING (tier)
  WHERE radius_km = 0 AND weight >= 4 AND asset_id NOT IN (SELECT asset_id FROM near)),
walk AS (SELECT 0 AS i, []::STRUCT(id VARCHAR, n INTEGER, lat DOUBLE, lon DOUBLE)[] AS got
  UNION ALL SELECT h.rn, CASE WHEN len(list_filter(got, lambda q: {km('q', 'h')} <= {PARAMS.catchment_km})) = 0 THEN list_append(got, {{'id': h.id, 'n': h.n, 'lat': h.lat, 'lon': h.lon}}) ELSE got END
  FROM walk w JOIN heavy h ON h.rn = w.i + 1)
SELECT 'site:' || q.id AS candidate_id, country, q.lat AS lat, q.lon AS lon FROM (SELECT unnest(got) AS q FROM (SELECT max_by(got, i) AS got FROM walk)) JOIN country c ON c.n = q.n""")
def _(v):
    from placekit.operators import assets

    rows = cut(asset_rows(v))
    point, _ = assets.split_point_and_area(rows)
    sites, _ = resolve.orphan_sites(assets.orphans(point, assets.assign(candidates(v), point)))
    return sites.select("candidate_id", "country", "lat", "lon")


@query("resolve_all")
def _(v):
    _, log = jobs.resolve_stage(jobs.attach_stage(candidates(v), asset_rows(v)), v.country)
    return log.select("country", "guest_id", "host_id", "decision", "km")


@query("moved_ids", sql("""SELECT b.candidate_id AS old_id, a.candidate_id AS new_id FROM cand a JOIN attr x USING (candidate_id)
  JOIN cand b ON a.n = b.n AND a.k = b.k AND a.candidate_id <> b.candidate_id JOIN attr y ON y.candidate_id = b.candidate_id
  WHERE ((a.population >= 50000)::INT, (x.source = 'wdpa')::INT, a.population, -length(a.name)) > ((b.population >= 50000)::INT, (y.source = 'wdpa')::INT, b.population, -length(b.name))""", "cand", "attr"))
def _(v):
    got = resolve.merge_transliterations(candidates(v))
    return resolve.moved_ids(got.log, got.kept)


# the records of a rounded point from the strongest on; one that spells a kept one folds
_SPELT = _walked("""
, spelt AS (SELECT c.country, round_even(cand.lat, 3) AS y, round_even(cand.lon, 3) AS x, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS f, count(*) OVER (PARTITION BY c.country, round_even(cand.lat, 3), round_even(cand.lon, 3)) AS m,
    row_number() OVER (PARTITION BY c.country, round_even(cand.lat, 3), round_even(cand.lon, 3) ORDER BY population >= 50000 DESC, source = 'wdpa' DESC, population DESC, length(name), candidate_id) AS rn
  FROM cand JOIN attr USING (candidate_id) JOIN country c USING (n)),
walk AS (SELECT country, y, x, rn, [f] AS got, false AS folded FROM spelt WHERE rn = 1 AND m > 1
  UNION ALL SELECT country, y, x, rn, CASE WHEN met THEN got ELSE list_append(got, f) END, met FROM (
    SELECT s.*, w.got, len(list_filter(w.got, lambda q: least(length(q), length(s.f)) > 0 AND (q = s.f OR (abs(length(q) - length(s.f)) <= 2 AND (starts_with(q, s.f) OR starts_with(s.f, q)))
      OR levenshtein(q, s.f) <= CASE WHEN least(length(q), length(s.f)) < 8 THEN 1 ELSE 2 END))) > 0 AS met
    FROM walk w JOIN spelt s ON s.country = w.country AND s.y = w.y AND s.x = w.x AND s.rn = w.rn + 1))
SELECT country, 'transliteration' AS decision, count(*) AS n FROM walk WHERE folded GROUP BY ALL""".lstrip("\n"), "cand", "attr", "country")


@query("absorption_counts", _SPELT)
def _(v):
    return resolve.absorption_counts(resolve.merge_transliterations(candidates(v)).log)


# ------------------------------------------------------------------ selection
def _scored(v):
    scored = cut(scoring.score(attached(v)))
    return scored, cut(scoring.quotas(scoring.country_facts(scored, v.country)))


_POOL = sql("", "top100", "cand", "country", "quota", "kv", "knorm").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
pool AS MATERIALIZED (SELECT c.country, q.quota, greatest(60, 0.35 * sqrt(c.area_km2 / greatest(q.quota, 1))) AS d_min, t.candidate_id AS id, cand.lat, cand.lon, t.score,
    row_number() OVER (PARTITION BY c.country ORDER BY t.score DESC, t.candidate_id) AS nth
  FROM top100 t JOIN cand USING (candidate_id, n) JOIN country c ON c.n = t.n JOIN quota q ON q.country = c.country)
"""
# the best gain of each pick, with the kinds seen and the places taken so far carried along
_COVERAGE = _POOL.rstrip() + f""",
strong AS (SELECT candidate_id AS id, kind, u, max(u) OVER (PARTITION BY candidate_id) AS most FROM (SELECT candidate_id, kind, w / len AS u FROM kv JOIN knorm USING (candidate_id))),
vec AS (SELECT id, list(CASE WHEN most < {KIND_DOMINANT} OR u >= {KIND_DOMINANT} THEN u ELSE 0 END ORDER BY kind) AS weights, list(kind ORDER BY kind) AS codes,
  list(kind ORDER BY kind) FILTER (u >= {KIND_DOMINANT}) AS shown FROM strong GROUP BY id),
full_pool AS MATERIALIZED (SELECT pool.*, max(score) OVER (PARTITION BY country) AS top, coalesce(weights, []::DOUBLE[]) AS weights, coalesce(codes, []::VARCHAR[]) AS codes, coalesce(shown, []::VARCHAR[]) AS shown
  FROM pool LEFT JOIN vec USING (id)),
walk AS (SELECT DISTINCT country, 0 AS pick, ''::VARCHAR AS id, 0::DOUBLE AS gain, []::STRUCT(id VARCHAR, lat DOUBLE, lon DOUBLE)[] AS got, []::VARCHAR[] AS seen FROM pool
  UNION ALL SELECT country, pick + 1, id, gain, list_append(got, {{'id': id, 'lat': lat, 'lon': lon}}), list_concat(seen, shown) FROM (
    SELECT *, row_number() OVER (PARTITION BY country ORDER BY gain DESC, id) AS rn FROM (
      SELECT country, pick, id, lat, lon, got, seen, shown, score * ({PARAMS.lam_red} * (relief + (1 - relief) * fresh) + (1 - {PARAMS.lam_red})) * ramp AS gain FROM (
        SELECT p.*, w.pick, w.got, w.seen, {PARAMS.quality_relief} * (p.score / p.top) AS relief,
          CASE WHEN list_sum(weights) > 0 THEN list_sum(list_transform(codes, lambda c, i: weights[i] * pow({PARAMS.coverage_decay}, len(list_filter(w.seen, lambda x: x = c))))) / list_sum(weights) ELSE 1 END AS fresh,
          CASE WHEN w.pick = 0 THEN 1 ELSE (SELECT CASE WHEN min(d) < p.d_min THEN 0 ELSE least(1, (min(d) - p.d_min) / p.d_min) END FROM (SELECT unnest(list_transform(w.got, lambda q: {km('p', 'q')})) AS d)) END AS ramp
        FROM walk w JOIN full_pool p ON p.country = w.country WHERE w.pick < p.quota AND NOT list_contains(list_transform(w.got, lambda q: q.id), p.id)))
    WHERE gain > 0) WHERE rn = 1)
"""


@query("coverage_selection", _COVERAGE + "SELECT country, id AS candidate_id, pick, round(gain + 1e-9, 6) AS gain FROM walk WHERE pick > 0")
def _(v):
    scored, quotas = _scored(v)
    return selection.select_coverage(scoring.above_floor(scored), quotas).select("country", "candidate_id", "pick", r6("gain").alias("gain"))


_RANK = f""",
ranked AS (SELECT DISTINCT country, 0 AS i, []::STRUCT(id VARCHAR, lat DOUBLE, lon DOUBLE, score DOUBLE)[] AS got FROM pool
  UNION ALL SELECT p.country, p.nth, CASE WHEN len(got) < p.quota AND len(list_filter(got, lambda q: {km('q', 'p')} < p.d_min)) = 0
    THEN list_append(got, {{'id': p.id, 'lat': p.lat, 'lon': p.lon, 'score': p.score}}) ELSE got END FROM ranked w JOIN pool p ON p.country = w.country AND p.nth = w.i + 1),
done AS (SELECT country, unnest(got) AS q, generate_subscripts(got, 1) AS pick FROM (SELECT country, max_by(got, i) AS got FROM ranked GROUP BY country))
"""


@query("rank_selection", _POOL.rstrip() + _RANK + "SELECT country, q.id AS candidate_id, pick, round(q.score + 1e-9, 6) AS score FROM done")
def _(v):
    scored, quotas = _scored(v)
    return selection.select_by_rank(scoring.above_floor(scored), quotas).select("country", "candidate_id", "pick", r6("gain").alias("score"))


@query("selection_redundancy", _COVERAGE.rstrip() + _RANK.rstrip() + f""",
chosen AS (SELECT 'coverage' AS how, country, id FROM walk WHERE pick > 0 UNION ALL SELECT 'rank', country, q.id FROM done),
spot AS (SELECT how, country, id, lat, lon FROM chosen JOIN pool USING (country, id)),
alike AS (SELECT a.how, a.country, a.id, b.id AS other, {km('a', 'b')} AS km, coalesce(sum(x.w * y.w) / any_value(m.len * o.len), 0) AS cosine
  FROM spot a JOIN spot b ON a.how = b.how AND a.country = b.country AND a.id < b.id LEFT JOIN knorm m ON m.candidate_id = a.id LEFT JOIN knorm o ON o.candidate_id = b.id
    LEFT JOIN kv x ON x.candidate_id = a.id LEFT JOIN kv y ON y.candidate_id = b.id AND y.kind = x.kind GROUP BY ALL)
SELECT country, how, n, round(coalesce(redundancy, 0) + 1e-9, 6) AS redundancy, closest_km FROM (SELECT how, country, count(*) AS n FROM chosen GROUP BY ALL)
  LEFT JOIN (SELECT how, country, avg(cosine) AS redundancy, min(km) AS closest_km FROM alike GROUP BY ALL) USING (how, country)""")
def _(v):
    scored, quotas = _scored(v)
    kept = cut(scoring.above_floor(scored))
    out = None
    for how, picks in (("coverage", selection.select_coverage(kept, quotas)), ("rank", selection.select_by_rank(kept, quotas))):
        stats = selection.pair_stats(kept.join(picks.select("candidate_id"), "candidate_id", "left_semi")).withColumn("how", F.lit(how))
        out = stats if out is None else out.unionByName(stats)
    return out.select("country", "how", "n", r6("redundancy").alias("redundancy"), "closest_km")


@query("spacing_conflicts", sql(f"""SELECT country, count(*) AS pairs, min(km) AS closest_km, round(greatest(1, 4.5 * 40075.017 / (greatest(min(km), 1e-9) * 1000) / 3.0) + 1e-9, 6) AS inset FROM (
  SELECT a.country, round_even({km('a', 'b')}, 1) AS km FROM r a JOIN r b ON a.country = b.country AND a.nth < b.nth AND a.nth <= 3 * a.quota AND b.nth <= 3 * b.quota
  WHERE {km('a', 'b')} < greatest(60, 0.35 * sqrt(a.area_km2 / a.quota))) GROUP BY ALL""", "top100", "cand", "country", "quota").replace("\nSELECT country, count(*) AS pairs", """,
r AS (SELECT c.country, c.area_km2, q.quota, t.candidate_id, cand.lat, cand.lon, row_number() OVER (PARTITION BY c.country ORDER BY t.score DESC, t.candidate_id) AS nth
  FROM top100 t JOIN cand USING (candidate_id, n) JOIN country c ON c.n = t.n JOIN quota q ON q.country = c.country)
SELECT country, count(*) AS pairs""", 1))
def _(v):
    scored, quotas = _scored(v)
    out = selection.conflict_summary(selection.spacing_conflicts(scoring.above_floor(scored), quotas))
    return out.select("country", "pairs", "closest_km", r6("inset").alias("inset"))


# ------------------------------------------------------------------ identity and gates
@query("build_number", sql("""SELECT substr(sha256(string_agg(p || ':' || d, chr(10) ORDER BY p)), 1, 12) AS build FROM (
  SELECT substr(sha256(place_id), 1, 3) AS p, sha256(string_agg(place_id, chr(10) ORDER BY place_id)) AS d FROM pin GROUP BY 1)""", "pin"))
def _(v):
    return identity.build_number(v.pin)


def _old_snapshot(v):
    """A previous build drawn from the pins: some ids since gone, some since reused."""
    k = F.col("score")
    old = v.pin.select(F.when(k == 11, F.concat(F.lit("old-"), "place_id")).otherwise(F.col("place_id")).alias("place_id"),
                       F.when(k == 13, F.concat(F.lit("Other "), "name")).otherwise(F.col("name")).alias("name"), "country", "lat", "lon", "score")
    mapping = old.where((k == 11) & (F.col("lat") > 0)).select(F.col("place_id").alias("old_id"), F.regexp_replace("place_id", "^old-", "").alias("new_id"))
    dead = old.where((k == 11) & (F.col("lat") < -30)).select(F.col("place_id").alias("old_id"), F.lit("nowhere").alias("new_id"))
    return old.drop("score"), mapping.unionByName(dead)


@query("id_stability", sql("""SELECT 'vanished' AS problem, 'old-' || place_id AS place_id FROM pin WHERE score = 11 AND lat <= 0 AND lat >= -30
  UNION ALL SELECT 'missing_target', 'nowhere' WHERE EXISTS (SELECT 1 FROM pin WHERE score = 11 AND lat < -30)
  UNION ALL SELECT 'reused', place_id FROM pin WHERE score = 13""", "pin"))
def _(v):
    old, mapping = _old_snapshot(v)
    return identity.stability(old, v.pin, mapping)


@query("manifest_agreement", sql("""SELECT 'printed' AS item, count(*) FILTER (printed) + 1 AS claimed, count(*) FILTER (printed) AS actual FROM pin""", "pin"))
def _(v):
    tiles = v.admin_rect.withColumnRenamed("region_id", "territory_id")
    actual = identity.bundle_counts(v.pin, tiles)
    return identity.manifest_errors(actual.withColumn("printed", F.col("printed") + 1), actual)


@query("fingerprints", sql("""SELECT place_id, country || '|' || lower(trim(name)) AS said, round_even(lat, 3) AS lat, round_even(lon, 3) AS lon FROM pin""", "pin"))
def _(v):
    from placekit.functions import text

    mark = text.fingerprint(F.col("name"), F.col("country"), F.col("lat"), F.col("lon"))
    parts = F.split(mark, "\\|")
    return v.pin.select("place_id", F.concat_ws("|", parts[0], parts[1]).alias("said"), parts[2].cast("double").alias("lat"), parts[3].cast("double").alias("lon"))


@query("gate_results", sql("""SELECT gate, rule, bad = 0 AS ok, bad FROM (
  SELECT 'kind_audit' AS gate, 'every kind is present' AS rule, 12 - bit_count(bit_or(kmask)) AS bad FROM pin
  UNION ALL SELECT 'kind_audit', 'no place without a kind', count(*) FROM pin WHERE kmask = 0
  UNION ALL SELECT 'place_id_stability', 'ids are unique', 0
  UNION ALL SELECT 'place_id_stability', 'ids are stable', count(*) FILTER (score = 11 AND lat <= 0 AND lat >= -30) + count(*) FILTER (score = 13)
    + (count(*) FILTER (score = 11 AND lat < -30) > 0)::INT FROM pin
  UNION ALL SELECT 'dissolve_resolution', 'no dissolved polygon', 0
  UNION ALL SELECT 'dissolve_resolution', 'no dissolved place', 0
  UNION ALL SELECT 'manifest_agreement', 'totals equal the tables', 0
  UNION ALL SELECT 'manifest_agreement', 'build equals the ids', 0)""", "pin"))
def _(v):
    old, mapping = _old_snapshot(v)
    tiles = v.admin_rect.withColumnRenamed("region_id", "territory_id")
    manifest = identity.bundle_counts(v.pin, tiles).join(F.broadcast(identity.build_number(v.pin)))  # one row each
    out = gates.kind_audit(v.pin).unionByName(gates.id_stability(v.pin, old, mapping)).unionByName(
        gates.dissolve_resolution(v.pin, v.country)).unionByName(gates.manifest_agreement(v.pin, tiles, manifest))
    return out.select("gate", "rule", "ok", "bad")


@query("close_pair_checks", sql(f"""SELECT rule, n = 0 AS ok, n AS bad FROM (
  SELECT 'no same-kind pair under 2 km' AS rule, count(*) FILTER (same) AS n FROM p UNION ALL
  SELECT 'close different-kind pairs are listed', count(*) FILTER (NOT same AND a NOT LIKE '%7') FROM p)""", "pin").replace("\nSELECT rule, n = 0", f""",
p AS (SELECT a.place_id AS a, b.place_id AS b, a.kmask & b.kmask <> 0 AS same FROM pin a JOIN pin b ON a.country = b.country AND a.place_id < b.place_id
  AND b.lat BETWEEN a.lat - 0.1 AND a.lat + 0.1 AND b.lon BETWEEN a.lon - 0.1 AND a.lon + 0.1 WHERE {km('a', 'b')} <= 2)
SELECT rule, n = 0""", 1))
def _(v):
    vec = F.transform(kinds.codes(), lambda c: F.when(F.array_contains(kinds.decode(F.col("kmask")), c), 0.5).otherwise(0.0))
    rows = resolve.complete(v.pin.withColumnRenamed("place_id", "candidate_id").withColumn("kinds", vec))
    pairs = resolve.close_pairs(rows)
    allowed = pairs.where(F.col("id_a").endswith("7")).select("id_a", "id_b")
    places = rows.withColumnRenamed("candidate_id", "place_id")
    return gates.candidate_checks(places, allowed).select("rule", "ok", "bad")


@query("shape_checks", sql("""SELECT rule, n = 0 AS ok, n AS bad FROM (
  SELECT 'ids are unique' AS rule, 0 AS n UNION ALL SELECT 'coordinates in range, never null island', 0 UNION ALL SELECT 'every place has a name', 0
  UNION ALL SELECT 'every place carries provenance', 0 UNION ALL SELECT 'scores are 0-100', 0 UNION ALL SELECT 'hole budget respected', 0
  UNION ALL SELECT 'every printed place has a rank', 0 UNION ALL SELECT 'no two holes under the country''s spacing', 0
  UNION ALL SELECT 'no country exceeds its quota', 0)"""))
def _(v):
    built = _built(v)
    return gates.shape_checks(built.places, built.quotas).select("rule", "ok", "bad")


# ------------------------------------------------------------------ signals and jobs
def _layers(v) -> signals.Layers:
    """Signal layers drawn from the candidate and asset views."""
    forms = v.landform.groupBy("candidate_id").agg(F.collect_list("landform").alias("forms"))
    land = v.cand.join(forms, "candidate_id").select(F.concat(F.lit("p"), "k").alias("source_id"), "lat", "lon", "forms")
    point = v.asset.select(F.col("asset_id").alias("point_id"), "lat", "lon", "tier")
    return signals.Layers(
        landforms=land.where(F.col("lon") < 0), capitals=point.where(F.col("tier") == "whs_cultural"), volcanoes=point.where(F.col("tier") == "whs_natural"),
        geothermal=point.where(F.col("tier") == "festival"), forests=point.where(F.col("tier") == "ramsar_geopark"),
        protected=point.where(F.col("tier") == "wdpa_iucn_i_ii"),
        harvest=point.where(F.col("tier") == "market").withColumn("kind", F.lit("A7")).withColumn("weight", F.lit(0.6)),
        manual=v.cand.where(F.col("lat") > 30).select(F.col("candidate_id").alias("place_id"), F.lit("A12").alias("kind"), F.lit(0.6).alias("weight")))


def _signal_places(v):
    return candidates(v).withColumnRenamed("candidate_id", "place_id").withColumn("place_id", F.concat(F.lit("X-"), "place_id"))


# Ids of the fixture match no landform row and no manual one; what is cut to four kinds at one stage never returns later,
# so the last state is the best four of all stages.
_SIGNALS = sql("", "cand", "country", "attr", "landform", "lkind", "skind", "near", "kindtab").rstrip() + f""",
lfk AS (SELECT 'p' || k AS source_id, any_value(lat) AS lat, any_value(lon) AS lon, kind, max(w) AS w FROM cand JOIN landform USING (candidate_id) JOIN lkind USING (landform)
  WHERE lon < 0 AND w >= 0.30 GROUP BY k, kind),
spot AS (SELECT DISTINCT source_id, lat, lon FROM lfk),
lnear AS (SELECT candidate_id, source_id FROM (SELECT c.candidate_id, s.source_id, row_number() OVER (PARTITION BY c.candidate_id ORDER BY {km('c', 's')}, s.source_id) AS rn
  FROM cand c JOIN spot s ON s.lat BETWEEN c.lat - 0.6 AND c.lat + 0.6 AND s.lon BETWEEN c.lon - 1 AND c.lon + 1 WHERE {km('c', 's')} <= 60) WHERE rn = 1),
flag AS (SELECT DISTINCT candidate_id, stage, kind, w FROM near JOIN (VALUES ('whs_cultural', 'capital', 15, 'A1', 0.9::DOUBLE), ('whs_natural', 'volcano', 60, 'A8', 0.95::DOUBLE),
  ('festival', 'geothermal', 60, 'A8', 0.9::DOUBLE), ('ramsar_geopark', 'forest', 60, 'A6', 0.8::DOUBLE), ('wdpa_iucn_i_ii', 'protected', 60, 'A9', 0.4::DOUBLE)) AS t(tier, stage, most, kind, w)
  USING (tier) WHERE km <= most),
early AS (SELECT candidate_id, kind, w FROM lnear JOIN lfk USING (source_id) UNION ALL SELECT candidate_id, kind, w FROM flag),
crop AS (SELECT DISTINCT candidate_id, 'A7' AS kind, 0.6::DOUBLE AS w FROM near WHERE tier = 'market' AND candidate_id NOT IN (SELECT candidate_id FROM early)),
every AS (SELECT * FROM early UNION ALL SELECT * FROM crop UNION ALL SELECT candidate_id, kind, w FROM attr JOIN skind USING (source)),
held AS (SELECT * FROM (SELECT candidate_id, kind, w, row_number() OVER (PARTITION BY candidate_id ORDER BY w DESC, ord) AS rn FROM (
  SELECT candidate_id, kind, max(w) AS w FROM every GROUP BY ALL) JOIN kindtab USING (kind)) WHERE rn <= 4)
"""


@query("apply_signals", _SIGNALS + "SELECT 'X-' || candidate_id AS place_id, kind, round_even(w, 2) AS weight FROM held")
def _(v):
    out = signals.apply_signals(_signal_places(v), _layers(v))
    return long_kinds(out, "place_id")


@query("signal_stats", _SIGNALS + """SELECT count(*) FILTER (stage = 'capital') AS capital, count(*) FILTER (stage = 'volcano') AS volcano, count(*) FILTER (stage = 'geothermal') AS geothermal,
  count(*) FILTER (stage = 'forest') AS forest, count(*) FILTER (stage = 'protected') AS protected, 0 AS landform_id, (SELECT count(*) FROM lnear) AS landform_near,
  (SELECT count(*) FROM crop) AS harvest, 0 AS manual, (SELECT count(*) FROM cand WHERE candidate_id NOT IN (SELECT candidate_id FROM held)) AS still_empty FROM flag""")
def _(v):
    return signals.signal_stats(signals.apply_signals(_signal_places(v), _layers(v)))


@query("signal_fill_preview", _SIGNALS + """SELECT 'filled' AS what, kind AS name, count(*) AS places FROM held GROUP BY ALL
  UNION ALL SELECT 'still empty', country, count(*) FROM cand JOIN country USING (n) WHERE candidate_id NOT IN (SELECT candidate_id FROM held) GROUP BY ALL""")
def _(v):
    places = cut(_signal_places(v))
    filled, still = signals.fill_preview(places, cut(signals.apply_signals(places, _layers(v)).select("place_id", "country", "kinds")))
    return filled.select(F.lit("filled").alias("what"), F.col("kind").alias("name"), "places").unionByName(
        still.select(F.lit("still empty").alias("what"), F.col("country").alias("name"), "places"))


@query("livability", sql("""SELECT country, CASE WHEN n IN (SELECT n FROM cand JOIN attr USING (candidate_id) WHERE source = 'osm' AND lat > 0) THEN 'scored' ELSE 'unscored' END AS livability FROM country""", "country", "cand", "attr"))
def _(v):
    countries = v.country.withColumn("iso2", F.substring("iso3", 2, 2))
    reached = v.cand.join(v.attr.where(F.col("source") == "osm").select("candidate_id"), "candidate_id").where(F.col("lat") > 0).join(
        countries.select("n", "iso2"), "n").select(F.lower("iso2").alias("iso"))
    return signals.livability(countries, reached).select("country", "livability")


@query("full_build")
def _(v):
    return _built(v).places.select("place_id", "name", "country", "lat", "lon", "score", F.array_join("archetypes", "/").alias("kinds"),
                                   "whs", "on_printed_map", "printed_rank", "merged")


@query("build_stats")
def _(v):
    return reports.selection_evidence(_built(v).stats)


@query("repair_candidates")
def _(v):
    pins = v.pin.withColumn("sources", F.array("source")).withColumn("printed_rank", F.when(F.col("printed"), F.col("score") + 1))
    vec = F.transform(kinds.codes(), lambda c: F.when(F.array_contains(kinds.decode(F.col("kmask")), c), 0.5).otherwise(0.0))
    pop = v.cand.select(F.col("candidate_id").alias("place_id"), "population", "is_site")
    places, moved, _ = jobs.repair_candidates(cut(pins.withColumn("kinds", vec).join(pop, "place_id")), v.country)
    return places.join(moved.groupBy(F.col("new_id").alias("place_id")).count(), "place_id", "left").select(
        "place_id", "iso3", "printed", "whs", "kmask", F.coalesce("count", F.lit(0)).alias("folded"))
