"""Registered queries: filters, density, coverage, search, clusters, exports, entry rules, advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from placekit.functions import geo, kinds, text
from placekit.operators import serve
from placekit.plans.oracles import km, sql
from placekit.plans.queries import query, r6

_BITS = {c: 1 << i for i, c in enumerate(f"A{n}" for n in range(1, 13))}


def _user_pins(v, user: int = 7):
    """Pins with what one traveller has seen."""
    from placekit.operators.records import merge_visits

    return serve.with_seen(v.pin, merge_visits(v.visit.where(F.col("user_id") == user), tie="event_id"))


_LWW = """lww AS (SELECT user_id, place_id, visited, marked_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, place_id ORDER BY marked_at DESC, side DESC, event_id DESC) AS rn FROM visit) WHERE rn = 1)"""


def with_lww(final: str, *needs: str) -> str:
    return sql("", *needs, "visit").rstrip() + ",\n" + _LWW + "\n" + final.strip()


# ------------------------------------------------------------------ filter, cap, sort
_F1 = serve.Filters(visited="no", kinds=("A4", "A8"), months=(6, 7), density=8, search="customer#0000")


@query("filter_places", with_lww(f"""SELECT place_id, iso3, name, score FROM (
  SELECT *, row_number() OVER (PARTITION BY iso3 ORDER BY score DESC, name, place_id) AS rn FROM pin
  WHERE kmask & {_BITS['A4'] | _BITS['A8']} <> 0 AND months & {(1 << 5) | (1 << 6)} <> 0 AND contains(lower(name), 'customer#0000')
    AND place_id NOT IN (SELECT place_id FROM lww WHERE user_id = 7 AND visited)) WHERE rn <= 8""", "pin"))
def _(v):
    return serve.apply_filters(_user_pins(v), _F1).select("place_id", "iso3", "name", "score")


@query("filter_country_scope", sql("""SELECT place_id, name, score FROM pin WHERE iso3 = 'NAB' AND printed AND whs <> 0 AND score >= 40""", "pin"))
def _(v):
    f = serve.Filters(printed_only=True, whs_only=True, score_min=40)
    return serve.apply_filters(v.pin, f, serve.Scope("country", "NAB")).select("place_id", "name", "score")


_PASS = """ent AS (SELECT passport, destination, CASE requirement WHEN 'visa free' THEN 'vf' WHEN 'visa on arrival' THEN 'voa' WHEN 'e-visa' THEN 'ev' WHEN 'eta' THEN 'ev'
    WHEN 'visa required' THEN 'vr' WHEN 'no admission' THEN 'na' WHEN '-1' THEN 'home' ELSE 'vf' END AS r,
  CASE WHEN requirement IN ('90', '30') THEN requirement::INT END AS d, CASE WHEN requirement IN ('eta', 'e-visa') THEN requirement END AS v FROM passport)"""


def with_entry(final: str, *needs: str) -> str:
    return sql("", *needs, "passport").rstrip() + ",\n" + _PASS + "\n" + final.strip()


def entries(v):
    return v.passport.withColumn("e", text.entry_state(F.col("requirement"))).select("passport", "destination", "e.*")


@query("filter_by_entry", with_entry("""SELECT place_id, iso3 FROM pin JOIN ent ON destination = iso3 WHERE passport = 'NBC' AND r IN ('vf', 'voa')""", "pin"))
def _(v):
    f = serve.Filters(entry_states=("vf", "voa"))
    return serve.apply_filters(v.pin, f, entry=entries(v).where(F.col("passport") == "NBC")).select("place_id", "iso3")


@query("cap_per_country", sql("""SELECT place_id, iso3, score FROM (
  SELECT *, row_number() OVER (PARTITION BY iso3 ORDER BY score DESC, name, place_id) AS rn FROM pin) WHERE rn <= 6""", "pin"))
def _(v):
    return serve.cap_per_country(v.pin, serve.clamp_density(3)).select("place_id", "iso3", "score")


@query("distributed_take", sql("""SELECT place_id, iso3, turn::INT AS turn FROM (
  SELECT *, row_number() OVER (PARTITION BY iso3 ORDER BY score DESC, name, place_id) AS turn FROM pin) ORDER BY turn, iso3 LIMIT 110""", "pin"))
def _(v):
    return serve.take_distributed(v.pin, 110).select("place_id", "iso3", "turn")


@query("sorted_by_distance", sql(f"""SELECT place_id, km FROM (SELECT pin.place_id, {km('o', 'pin', '6371.0')} AS km
  FROM pin, (SELECT 10.0::DOUBLE AS lat, -20.0::DOUBLE AS lon) o)""", "pin"))
def _(v):
    return serve.sort_pins(v.pin, "distance", origin=(10.0, -20.0)).select("place_id", "km")


@query("sorted_world", sql("""SELECT place_id, country, score, row_number() OVER (ORDER BY country, score DESC, place_id) AS nth FROM pin""", "pin"))
def _(v):
    from placekit.plans.session import number_rows

    ranked = number_rows(v.pin, [F.col("country"), F.col("score").desc(), F.col("place_id")], "nth")
    return ranked.select("place_id", "country", "score", "nth")


@query("recent_marks", with_lww("""SELECT place_id, marked_at::VARCHAR AS marked_at FROM lww WHERE user_id = 7 AND visited""", "pin"))
def _(v):
    from placekit.operators.records import merge_visits

    rows = merge_visits(v.visit.where(F.col("user_id") == 7), tie="event_id").where("visited")
    return serve.sort_pins(rows, "recent").select("place_id", F.col("marked_at").cast("string").alias("marked_at"))


@query("country_top_places", sql("""SELECT country, place_id, nth::INT AS nth FROM (
  SELECT *, row_number() OVER (PARTITION BY country ORDER BY score DESC, name, place_id) AS nth FROM pin) WHERE nth <= 20""", "pin"))
def _(v):
    return serve.top_of(v.pin, "country", 20).select("country", "place_id", "nth")


@query("bulk_marking_list", sql("""SELECT place_id, source FROM (
  SELECT *, bool_or(printed) OVER (PARTITION BY iso3 || source) AS anyp, row_number() OVER (PARTITION BY iso3 || source ORDER BY score DESC, name, place_id) AS rn FROM pin)
  WHERE CASE WHEN anyp THEN printed ELSE rn <= 24 END""", "pin"))
def _(v):
    return serve.bulk_list(v.pin.withColumn("g", F.concat("iso3", "source")), "g").select("place_id", "source")


@query("search_hits", sql("""SELECT kind, id, name, country FROM (
  SELECT 'country' AS kind, 0 AS t, iso3 AS id, country AS name, country FROM country WHERE contains(lower(country), 'an')
  UNION ALL SELECT 'region', 1, region_id, 'Land ' || region_id, country FROM admin_rect JOIN country USING (n, iso3) WHERE contains(lower('Land ' || region_id), 'an')
  UNION ALL SELECT 'place', 2, place_id, name, country FROM pin WHERE contains(lower(name), 'an'))
  ORDER BY CASE WHEN lower(name) = 'an' THEN 0 WHEN starts_with(lower(name), 'an') THEN 1 ELSE 2 END, t, name, id LIMIT 8""", "pin", "admin_rect"))
def _(v):
    q = "an"
    places = serve.apply_filters(v.pin, serve.Filters(search=q))
    regions = v.admin_rect.join(v.country.select("n", "country"), "n").withColumn("name", F.concat(F.lit("Land "), "region_id"))
    return serve.search(q, places, regions, v.country).select("kind", "id", "name", "country")


@query("zoom_clusters", with_lww("""SELECT floor(lon / (360.0 / 32))::BIGINT AS cx, floor(lat / (360.0 / 32))::BIGINT AS cy, count(*) AS n,
  count(*) FILTER (place_id IN (SELECT place_id FROM lww WHERE user_id = 7 AND visited)) AS seen, count(*) FILTER (iso3 = 'NAB') AS in_scope,
  round(avg(lon) + 1e-9, 6) AS lon, round(avg(lat) + 1e-9, 6) AS lat FROM pin GROUP BY ALL""", "pin"))
def _(v):
    pins = _user_pins(v).withColumn("in_scope", F.col("iso3") == "NAB")
    return serve.clusters(pins, 2.0).select("cx", "cy", "n", "seen", "in_scope", r6("lon").alias("lon"), r6("lat").alias("lat"))


# ------------------------------------------------------------------ coverage
_COV = """covered AS (SELECT u.user_id, p.iso3, k.kind, k.ord, count(*) FILTER (p.kmask & (1 << (k.ord - 1)::INT) <> 0) AS available,
    count(*) FILTER (p.kmask & (1 << (k.ord - 1)::INT) <> 0 AND l.visited IS NOT NULL AND l.visited) AS seen,
    count(*) AS places, count(*) FILTER (l.visited IS NOT NULL AND l.visited) AS visited
  FROM (SELECT DISTINCT user_id FROM lww) u CROSS JOIN pin p LEFT JOIN lww l ON l.user_id = u.user_id AND l.place_id = p.place_id
  CROSS JOIN kindtab k GROUP BY ALL)"""


def _country_seen(v):
    """(user, country) pairs a traveller has any mark in, with per-kind counts.

    Available counts depend on the country only and seen counts only on marked places, so no
    user x place product is built: counts per country meet masks of marked places.
    """
    from placekit.operators.records import merge_visits

    marks = merge_visits(v.visit, tie="event_id").where("visited").select("user_id", "place_id")
    have = serve.coverage_rows(v.pin.withColumn("seen", F.lit(False)), ["iso3"])
    mine = serve.coverage_rows(v.pin.withColumn("seen", F.lit(True)).join(marks, "place_id"), ["user_id", "iso3"])
    return mine.select("user_id", "iso3", F.col("rows").alias("mine"), "visited").join(
        have.select("iso3", "places", F.col("rows").alias("have")), "iso3")


@query("coverage_by_user_country", sql("", "visit", "pin", "kindtab").rstrip() + ",\n" + _LWW + ",\n" + _COV + """
SELECT user_id, iso3, kind, available, seen, places, visited FROM covered WHERE visited > 0""")
def _(v):
    rows = F.zip_with("have", "mine", lambda h, m: F.struct(h["kind"].alias("kind"), h["available"].alias("available"), m["seen"].alias("seen")))
    return _country_seen(v).select("user_id", "iso3", F.explode(rows).alias("r"), "places", "visited").select("user_id", "iso3", "r.*", "places", "visited")


@query("coverage_world", with_lww("""SELECT kind, count(*) FILTER (kmask & (1 << (ord - 1)::INT) <> 0) AS available,
  count(*) FILTER (kmask & (1 << (ord - 1)::INT) <> 0 AND place_id IN (SELECT place_id FROM lww WHERE user_id = 7 AND visited)) AS seen
  FROM pin CROSS JOIN kindtab GROUP BY ALL""", "pin", "kindtab"))
def _(v):
    rows = serve.coverage_rows(_user_pins(v).withColumn("w", F.lit("world")), ["w"])
    return rows.select(F.explode("rows").alias("r")).select("r.kind", "r.available", "r.seen")


_GAP = """SELECT user_id, iso3, (seen_kinds || ' of ' || available_kinds) AS count, CASE
  WHEN len(names) = 0 THEN 'Every kind of place in ' || iso3 || ' has is on your record.'
  WHEN len(names) = 1 THEN 'Still unseen: ' || names[1] || '.' WHEN len(names) = 2 THEN 'Still unseen: ' || names[1] || ' and ' || names[2] || '.'
  ELSE 'Still unseen: ' || array_to_string(names[1:len(names) - 1], ', ') || ', and ' || names[len(names)] || '.' END AS gap FROM (
  SELECT user_id, iso3, count(*) FILTER (seen > 0) AS seen_kinds, count(*) FILTER (available > 0) AS available_kinds,
    coalesce(list(replace(lower(label), ' / ', ' or ') ORDER BY ord) FILTER (available > 0 AND seen = 0), []) AS names
  FROM covered JOIN kindtab USING (kind, ord) WHERE visited > 0 GROUP BY ALL)"""


@query("gap_sentence", sql("", "visit", "pin", "kindtab").rstrip() + ",\n" + _LWW + ",\n" + _COV + "\n" + _GAP)
def _(v):
    rows = F.zip_with("have", "mine", lambda h, m: F.struct(h["kind"].alias("kind"), h["available"].alias("available"), m["seen"].alias("seen")))
    out = _country_seen(v).withColumn("rows", rows)
    unseen = F.transform(F.filter("rows", lambda r: (r["available"] > 0) & (r["seen"] == 0)), lambda r: r["kind"])
    have = F.size(F.filter("rows", lambda r: r["available"] > 0))
    seen = F.size(F.filter("rows", lambda r: r["seen"] > 0))
    return out.select("user_id", "iso3", text.coverage_count(seen, have).alias("count"),
                      text.coverage_gap_voice(unseen, have, F.concat(F.lit("in "), "iso3")).alias("gap"))


@query("newly_seen", sql("", "visit", "pin", "kindtab").rstrip() + """,
b AS (SELECT user_id, iso3, bit_or(kmask) AS m FROM visit JOIN pin USING (place_id) WHERE visited AND event_id % 5 = 0 GROUP BY ALL),
a AS (SELECT user_id, iso3, bit_or(kmask) AS m FROM visit JOIN pin USING (place_id) WHERE visited GROUP BY ALL)
SELECT a.user_id, a.iso3, k.kind FROM a LEFT JOIN b ON b.user_id = a.user_id AND b.iso3 = a.iso3 CROSS JOIN kindtab k
WHERE a.m & (1 << (k.ord - 1)::INT) <> 0 AND coalesce(b.m, 0) & (1 << (k.ord - 1)::INT) = 0""")
def _(v):
    """Kinds that a traveller's marks add in a country to those of every fifth mark."""
    scope = ["user_id", "iso3"]
    seen = v.visit.where("visited").join(v.pin.select("place_id", "iso3", "kmask"), "place_id").withColumn("seen", F.lit(True))
    before, after = serve.seen_mask(seen.where(F.col("event_id") % 5 == 0), scope), serve.seen_mask(seen, scope)
    return serve.newly_seen(before, after, scope).select(*scope, F.explode("kinds").alias("kind"))


# ------------------------------------------------------------------ entry rules
@query("passport_summary", with_entry("""SELECT passport, count(*) FILTER (r = 'vf') AS vf, count(*) FILTER (r = 'voa') AS voa, count(*) FILTER (r = 'ev') AS ev,
  count(*) FILTER (r = 'vr') AS vr, count(*) FILTER (r = 'na') AS na, count(*) FILTER (r = 'home') AS home,
  count(*) FILTER (destination IN (SELECT iso3 FROM pin)) AS in_database FROM ent GROUP BY ALL""", "pin"))
def _(v):
    from placekit.sources.sinks import passport_summary

    return passport_summary(entries(v), v.pin.select("iso3").distinct()).select("passport", "vf", "voa", "ev", "vr", "na", "home", "in_database")


@query("uncovered_destinations", with_entry("SELECT iso3 FROM country WHERE iso3 NOT IN (SELECT destination FROM ent)", "country"))
def _(v):
    return serve.uncovered(v.country, entries(v))


@query("entry_lookup", with_entry("""SELECT place_id, ent.passport, r, d, v FROM pin LEFT JOIN ent ON destination = iso3 WHERE ent.passport = 'NAA' OR ent.passport IS NULL""", "pin"))
def _(v):
    out = serve.entry_lookup(v.pin, entries(v).where(F.col("passport") == "NAA"))
    return out.select("place_id", "passport", "r", "d", "v")


_SENT = """SELECT e.passport, c.iso3 AS destination, CASE WHEN r = 'home' THEN c.country || ' is your own passport''s country.'
  WHEN r = 'na' THEN c.country || ' allows no admission at present on a ' || e.passport || ' passport.'
  ELSE c.country || ' needs ' || CASE WHEN r = 'vf' THEN 'no visa' WHEN r = 'voa' THEN 'a visa on arrival'
    WHEN r = 'ev' AND v = 'eta' THEN 'a travel authorisation applied for online' WHEN r = 'ev' THEN 'an e-visa applied for online'
    ELSE 'a visa applied for before travelling' END || CASE WHEN r = 'vf' AND d IS NOT NULL THEN ' for up to ' || d || ' days' ELSE '' END
    || ' on a ' || e.passport || ' passport.' END AS said,
  CASE WHEN r = 'vf' AND d IS NOT NULL THEN 'No visa needed · ' || d || ' days' WHEN r = 'ev' AND v = 'eta' THEN 'Travel authorisation first'
    ELSE CASE r WHEN 'vf' THEN 'No visa needed' WHEN 'voa' THEN 'Visa on arrival' WHEN 'ev' THEN 'Apply online first' WHEN 'vr' THEN 'Apply in advance'
      WHEN 'na' THEN 'No admission' ELSE 'Your own country' END END AS short
  FROM ent e JOIN country c ON c.iso3 = e.destination"""


@query("entry_sentences", with_entry(_SENT, "country"))
def _(v):
    e = entries(v).join(v.country.select(F.col("iso3").alias("destination"), "country"), "destination")
    r, d, x = F.col("r"), F.col("d"), F.col("v")
    return e.select("passport", "destination", text.entry_sentence(r, d, x, F.col("country"), F.col("passport")).alias("said"),
                    text.entry_text(r, d, x).alias("short"))


# ------------------------------------------------------------------ words about places
@query("place_voice", sql("""SELECT place_id, CASE WHEN score >= 100 THEN 'Nothing in ' || country || ' scores higher.'
    ELSE 'It scores ' || score || ' of 100 against the top place in ' || country || '.' END ||
  CASE WHEN printed THEN ' It is number ' || (score + 1) || ' of the places in ' || country || ' that reach the printed map.'
    ELSE ' It does not reach the printed map, which is a question of hole spacing rather than of merit.' END AS standing,
  CASE WHEN months = 0 THEN 'We don’t know when to go.' WHEN bit_count(months) = 12 THEN 'Any month.' ELSE
    'Typically better in ' || CASE WHEN len(ms) = 1 THEN ms[1] ELSE array_to_string(ms[1:len(ms) - 1], ', ') || ' and ' || ms[len(ms)] END || '.' END AS season
  FROM (SELECT *, list_transform(list_filter(range(1, 13), lambda m: months & (1 << (m - 1)::INT) <> 0), lambda m:
    ['January','February','March','April','May','June','July','August','September','October','November','December'][m]) AS ms FROM pin)""", "pin"))
def _(v):
    p = v.pin.withColumn("m", F.expr("filter(sequence(1, 12), m -> (months & shiftleft(1, m - 1)) <> 0)"))
    return p.select("place_id", text.standing(F.col("score"), F.col("country"), F.col("printed"), F.col("score") + 1).alias("standing"),
                    text.when_to_go(F.col("m")).alias("season"))


@query("why_here", sql("""SELECT candidate_id, CASE WHEN is_site THEN 'This site' ELSE 'This place' END || ' is here for ' ||
  CASE source WHEN 'wdpa' THEN 'protected land around it' WHEN 'osm' THEN 'a mapped concentration of institutions, markets and workshops'
    ELSE 'a recognised urban centre' END || CASE WHEN k % 2 = 0 THEN ' and a living old town' ELSE '' END || '.' AS said,
  CASE reach WHEN 'mid' THEN 'A few hours from an international gateway.' WHEN 'far' THEN 'A day’s travel from an international gateway.'
    WHEN 'remote' THEN 'Remote from international gateways.' END AS effort FROM cand JOIN attr USING (candidate_id)""", "cand", "attr"))
def _(v):
    rows = v.cand.join(v.attr, "candidate_id")
    codes = F.when(F.col("k") % 2 == 0, F.array(F.lit("A2"))).otherwise(F.array(F.lit("A7")))
    return rows.select("candidate_id", text.why_here(F.array("source"), codes, F.lit(0), F.col("is_site")).alias("said"),
                       text.travel_effort(F.col("reach")).alias("effort"))


@query("months_of_trip", sql("""SELECT trip, string_agg(m, ',' ORDER BY i) AS months FROM (
  SELECT trip, month(d) AS m, min(i) AS i FROM (
    SELECT trip, b, i, CASE WHEN k IS NULL OR i < k THEN ms + to_months(i::INT) + to_days((day(a) - 1)::INT)
      ELSE date_trunc('month', over) + to_months((i - k)::INT) + to_days((day(over) - 1)::INT) END AS d FROM (
      SELECT *, ms + to_months(k::INT) + to_days((day(a) - 1)::INT) AS over, unnest(range(0, 24)) AS i FROM (
        SELECT *, list_filter(range(1, 13), lambda j: day(a) > day(last_day((ms + to_months(j::INT))::DATE)))[1] AS k FROM (
          SELECT o_orderkey AS trip, o_orderdate::DATE AS a, o_orderdate::DATE + (o_orderkey % 300)::INT AS b, date_trunc('month', o_orderdate::DATE) AS ms FROM orders))))
  WHERE d <= b GROUP BY ALL) GROUP BY ALL"""))
def _(v):
    a = F.col("o_orderdate").cast("date")
    b = F.date_add(a, (F.col("o_orderkey") % 300).cast("int"))
    return v.table("orders").select(F.col("o_orderkey").alias("trip"), F.array_join(text.months_in_range(a, b), ",").alias("months"))


# ------------------------------------------------------------------ exports and advice
@query("sheet_rows", with_lww("""SELECT p.name, p.country, coalesce(r.name, '') AS region, p.lat, p.lon,
  (SELECT string_agg(label, '; ' ORDER BY ord) FROM kindtab WHERE p.kmask & (1 << (ord - 1)::INT) <> 0) AS kinds,
  p.score || ' of 100 in ' || p.country AS score, CASE WHEN l.visited THEN 'yes' ELSE 'no' END AS visited, '' AS visited_on,
  coalesce(l.note, '') AS note, p.whs AS "WHS", p.source AS sources, p.place_id
FROM pin p LEFT JOIN (SELECT place_id, max_by(visited, (marked_at, side, event_id)) AS visited,
    max_by(note, (marked_at, side, event_id)) FILTER (note IS NOT NULL) AS note FROM visit WHERE user_id = 7 GROUP BY ALL) l USING (place_id)
LEFT JOIN (SELECT region_id, 'Land ' || region_id AS name FROM admin_rect) r ON r.region_id = p.iso3 || '-R' || lpad(((p.score % 20) + 1)::VARCHAR, 2, '0')
WHERE p.score >= 50""", "pin", "kindtab", "admin_rect"))
def _(v):
    from placekit.operators.records import merge_visits

    pins = serve.apply_filters(v.pin.where(F.col("score") >= 50), serve.Filters())
    pins = pins.withColumn("region_id", F.concat("iso3", F.lit("-R"), F.lpad((F.col("score") % 20 + 1).cast("string"), 2, "0")))
    regions = v.admin_rect.select("region_id", F.concat(F.lit("Land "), "region_id").alias("name"))
    visits = merge_visits(v.visit.where(F.col("user_id") == 7), tie="event_id").withColumn("visited_on", F.lit(None).cast("date"))
    return serve.sheet(pins.drop("country"), v.country, regions, visits, v.pin.select("place_id", F.array("source").alias("sources")))


@query("sheet_advisory", sql("SELECT count(*) AS n, count(*) > 10000 AS slow FROM pin", "pin"))
def _(v):
    return serve.row_advisory(v.pin)


def _requests(v):
    """Export requests drawn from orders: a sheet size, a scope and a pin count each."""
    k = F.col("o_orderkey")
    return v.table("orders").select(
        k.alias("request_id"), F.element_at(F.array(F.lit("world"), F.lit("country"), F.lit("region")), (k % 3 + 1).cast("int")).alias("scope"),
        (k * 13 % 3000 + 100).cast("double").alias("width_mm"), (k * 7 % 2000 + 100).cast("double").alias("height_mm"),
        (k * 31 % 4000 + 1).cast("int").alias("n"))


_REQ = """req AS (SELECT o_orderkey AS request_id, ['world', 'country', 'region'][(o_orderkey % 3 + 1)::INT] AS scope, (o_orderkey * 13 % 3000 + 100)::DOUBLE AS width_mm,
  (o_orderkey * 7 % 2000 + 100)::DOUBLE AS height_mm, (o_orderkey * 31 % 4000 + 1)::INT AS n FROM orders)"""


@query("poster_advice", "WITH " + _REQ + """ SELECT request_id, round(sqrt(width_mm * height_mm / n) + 1e-9, 6) AS spacing_mm, sqrt(width_mm * height_mm / n) < 4.5 AS pins_overlap,
  width_mm * height_mm < 62370 AS below_a4, CASE scope WHEN 'world' THEN 1400 WHEN 'country' THEN 500 ELSE 400 END AS suggest_width_mm,
  CASE scope WHEN 'world' THEN 700 WHEN 'country' THEN 620 ELSE 400 END AS suggest_height_mm, CASE scope WHEN 'world' THEN least(1200, n) ELSE n END AS suggest_cap FROM req""")
def _(v):
    return serve.poster_advice(_requests(v)).select("request_id", r6("spacing_mm").alias("spacing_mm"), "pins_overlap", "below_a4",
                                                    "suggest_width_mm", "suggest_height_mm", "suggest_cap")


_LEVELS = [("L0", None), ("w2000", 2000), ("w1400", 1400), ("w1000", 1000), ("w700", 700)]


@query("level_for_width", "WITH " + _REQ + """ SELECT request_id, CASE WHEN width_mm >= 2000 THEN 'w2000' WHEN width_mm >= 1400 THEN 'w1400' WHEN width_mm >= 1000 THEN 'w1000'
  ELSE 'w700' END AS level FROM req""")
def _(v):
    levels = v.spark.createDataFrame(_LEVELS, "level string, for_map_mm int")
    return serve.level_for_width(levels, _requests(v)).select("request_id", "level")


_TILES = """tiles AS (SELECT n, c_custkey AS tile, (c_custkey * 17 % 400 + 10) / 100.0 AS max_deg, (c_custkey * 17 % 400 + 10) / (100.0 * (c_custkey % 3 + 1)) AS min_deg,
  (c_custkey % 7)::BIGINT AS places FROM (SELECT c_nationkey AS n, c_custkey FROM customer))"""


@query("tile_size_report", "WITH " + _TILES + """ SELECT n, count(*) AS tiles, count(*) FILTER (small) AS too_small, coalesce(sum(places) FILTER (small), 0)::BIGINT AS places_lost,
  greatest(1400.0, coalesce(CASE WHEN pick > 0 THEN ceil((12 / pick) * 360 / 100) * 100 END, 1400.0))::DOUBLE AS suggest_width_mm FROM (
  SELECT *, (list(max_deg) FILTER (small) OVER (PARTITION BY n)) AS sides,
    list_sort(list(max_deg) FILTER (small) OVER (PARTITION BY n), 'DESC')[floor(count(*) FILTER (small) OVER (PARTITION BY n) * 0.35)::INT + 1] AS pick FROM (
    SELECT *, NOT (max_deg * 1400 / 360.0 >= 12 AND min_deg * 1400 / 360.0 >= 6) AS small FROM tiles)) GROUP BY n, pick""")
def _(v):
    k = F.col("c_custkey")
    tiles = v.table("customer").select(F.col("c_nationkey").alias("n"), ((k * 17 % 400 + 10) / 100.0).alias("max_deg"),
                                       ((k * 17 % 400 + 10) / (100.0 * (k % 3 + 1))).alias("min_deg"), (k % 7).alias("places"))
    return serve.tile_size_report(tiles, 1400.0, ["n"])


@query("map_scale", sql("""SELECT n, round(40075.017 / (w * 1000) + 1e-9, 6) AS km_per_mm, round(4.5 * 40075.017 / (w * 1000) + 1e-9, 6) AS separation_km,
  round(12 * 40075.017 / (w * 1000) + 1e-9, 6) AS tile_km, round(greatest(60, 0.35 * sqrt(area_km2 / (n % 12 + 1))) + 1e-9, 6) AS d_min FROM (SELECT *, n / 5.0 + 1 AS w FROM country)""", "country"))
def _(v):
    s = geo.map_scale(F.col("n") / 5.0 + 1)
    return v.country.select("n", r6(s["km_per_mm"]).alias("km_per_mm"), r6(s["min_place_separation_km"]).alias("separation_km"),
                            r6(s["min_tile_extent_km"]).alias("tile_km"), r6(geo.min_spacing(F.col("area_km2"), F.col("n") % 12 + 1)).alias("d_min"))


@query("tile_numbering", sql("""SELECT place_id, row_number() OVER (ORDER BY country, lon, lat DESC, place_id) AS number FROM pin""", "pin"))
def _(v):
    from placekit.operators.land import number_tiles

    return number_tiles(v.pin.withColumn("tile_id", F.col("place_id"))).select("place_id", "number")


@query("thin_rows", sql("""SELECT place_id, round_even(lat, 4) AS lat, round_even(lon, 4) AS lon, score FROM pin WHERE printed""", "pin"))
def _(v):
    from placekit.sources.sinks import thin

    return thin(v.pin.where("printed")).select("place_id", "lat", "lon", "score")


@query("pin_layer", sql("""SELECT place_id AS id, name AS n, score AS s, kmask AS a, iso3 AS c, CASE WHEN printed THEN 1 ELSE 0 END AS hole, whs FROM pin""", "pin"))
def _(v):
    from placekit.sources.sinks import pin_layer

    return pin_layer(v.pin).select("id", "n", "s", "a", "c", "hole", "whs")


@query("place_ids", sql("""SELECT candidate_id, iso3 || '-' || right(candidate_id, 8) AS place_id,
  CASE WHEN length(candidate_id) > 1 THEN substr(candidate_id, 2) ELSE candidate_id END AS source_id, iso3 || '-R' || lpad((k % 99 + 1)::VARCHAR, 2, '0') AS region_id
  FROM cand JOIN country USING (n)""", "cand", "country"))
def _(v):
    rows = v.cand.join(v.country, "n").withColumn("place_id", geo.place_id(F.col("iso3"), F.col("candidate_id")))
    return rows.select("candidate_id", "place_id", geo.geoname_tail(F.col("place_id")).alias("source_id"),
                       geo.iso3_id(F.col("iso3"), "R", F.col("k") % 99 + 1).alias("region_id"))


@query("compass_words", sql("""SELECT place_id, CASE WHEN a <= 22.5 THEN 'Northern' WHEN a <= 67.5 THEN 'North-eastern' WHEN a <= 112.5 THEN 'Eastern'
  WHEN a <= 157.5 THEN 'South-eastern' WHEN a <= 202.5 THEN 'Southern' WHEN a <= 247.5 THEN 'South-western' WHEN a <= 292.5 THEN 'Western'
  WHEN a <= 337.5 THEN 'North-western' ELSE 'Northern' END || ' ' || country AS said FROM (
  SELECT place_id, country, CASE WHEN d < 0 THEN d + 360 ELSE d END AS a FROM (SELECT p.place_id, p.country, degrees(atan2(lon - 15.003, lat - 2.001)) AS d FROM pin p))""", "pin"))
def _(v):
    return v.pin.select("place_id", geo.compass(F.col("lon") - 15.003, F.col("lat") - 2.001, F.col("country")).alias("said"))
