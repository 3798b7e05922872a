"""Registered queries: visits, trips, profiles, feedback, accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from placekit.operators import records, serve
from placekit.plans.oracles import sql
from placekit.plans.queries import query

_ORDER = "(marked_at, side, event_id)"


@query("lww_visits", sql(f"""SELECT user_id, place_id, max_by(visited, {_ORDER}) AS visited, max(marked_at)::VARCHAR AS marked_at,
  max_by(note, {_ORDER}) FILTER (note IS NOT NULL) AS note FROM visit GROUP BY ALL""", "visit"))
def lww_visits(v):
    out = records.merge_visits(v.visit, tie="event_id")
    return out.select("user_id", "place_id", "visited", F.col("marked_at").cast("string").alias("marked_at"), "note")


def _sides(v):
    """One row per key and side, as an account and a device would each hold."""
    rows = v.visit.withColumn("visited_on", F.lit(None).cast("date"))
    one = rows.groupBy("user_id", "place_id", "side").agg(
        F.max_by(F.struct("visited", "marked_at", "note", "visited_on"), F.struct("marked_at", "event_id")).alias("r"))
    one = one.select("user_id", "place_id", "side", "r.*")
    return one.where(F.col("side") == 0), one.where(F.col("side") == 1)


_ONE = """one AS (SELECT user_id, place_id, side, visited, marked_at, note FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, place_id, side ORDER BY marked_at DESC, event_id DESC) AS rn FROM visit) WHERE rn = 1),
r AS (SELECT * FROM one WHERE side = 0), l AS (SELECT * FROM one WHERE side = 1)"""


@query("sign_in_merge", sql("", "visit").rstrip() + ",\n" + _ONE + """
SELECT coalesce(r.user_id, l.user_id) AS user_id, coalesce(r.place_id, l.place_id) AS place_id,
  CASE WHEN w THEN l.visited ELSE r.visited END AS visited, CASE WHEN w THEN coalesce(l.note, r.note) ELSE r.note END AS note
FROM (SELECT r, l, l.user_id IS NOT NULL AND (r.user_id IS NULL OR l.marked_at >= r.marked_at) AS w FROM r FULL JOIN l ON r.user_id = l.user_id AND r.place_id = l.place_id)""")
def _(v):
    remote, local = _sides(v)
    return records.sign_in_merge(remote.drop("side"), local.drop("side")).select("user_id", "place_id", "visited", "note")


@query("import_counts", sql("", "visit").rstrip() + ",\n" + _ONE + """
SELECT coalesce(r.user_id, l.user_id) AS user_id, count(*) FILTER (r.user_id IS NULL) AS added, count(*) FILTER (l.marked_at > r.marked_at) AS updated,
  count(*) FILTER (r.user_id IS NOT NULL AND l.user_id IS NOT NULL AND l.marked_at <= r.marked_at) AS skipped
FROM r FULL JOIN l ON r.user_id = l.user_id AND r.place_id = l.place_id GROUP BY ALL""")
def _(v):
    mine, theirs = _sides(v)
    return records.import_visits(mine, theirs)[1]


@query("profile_merge", sql("""SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN c_name END AS display_name,
  CASE WHEN c_custkey % 2 = 0 THEN 'home' || c_nationkey END AS home FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 IN (0, 1)"""))
def _(v):
    c, k = v.table("customer"), F.col("c_custkey")
    remote = c.where(k % 2 == 0).select(k.alias("user_id"), F.col("c_name").alias("display_name"), F.concat(F.lit("home"), "c_nationkey").alias("home"))
    local = c.where((k % 3).isin(0, 1)).select(k.alias("user_id"), F.when(k % 3 == 0, F.col("c_mktsegment")).otherwise("").alias("display_name"),
                                               F.lit(None).cast("string").alias("home"))
    return records.merge_profiles(remote, local, ["display_name", "home"])


@query("trip_merge", sql("""SELECT trip_id, max_by(title, side) AS title, max(side) AS side FROM (
  SELECT o_custkey AS trip_id, 'trip ' || max(o_orderkey) AS title, o_orderkey % 2 AS side FROM orders GROUP BY o_custkey, o_orderkey % 2) GROUP BY ALL"""))
def _(v):
    o = v.table("orders").groupBy(F.col("o_custkey").alias("trip_id"), (F.col("o_orderkey") % 2).alias("side")).agg(
        F.concat(F.lit("trip "), F.max("o_orderkey").cast("string")).alias("title"))
    return records.merge_trips(o)


@query("trip_order", sql("""SELECT trip_id, day, stop_key, place_id, nth, CASE WHEN day > 0 THEN 'D' || day || ' · ' || nth END AS label, CASE WHEN day > 0 THEN nxt END AS next_place FROM (
  SELECT *, row_number() OVER w AS nth, lead(place_id) OVER w AS nxt FROM trip WINDOW w AS (PARTITION BY trip_id, day ORDER BY position, stop_key))""", "trip"))
def _(v):
    return records.trip_days(v.trip).select("trip_id", "day", "stop_key", "place_id", "nth", "label", "next_place")


@query("trip_reindex", sql("""SELECT trip_id, day, stop_key, row_number() OVER (PARTITION BY trip_id, day ORDER BY position, stop_key) - 1 AS position FROM trip""", "trip"))
def _(v):
    return records.reindex(v.trip).select("trip_id", "day", "stop_key", "position")


@query("trip_next_position", sql("SELECT trip_id, day, max(position) + 1 AS next_position FROM trip GROUP BY ALL", "trip"))
def _(v):
    return records.next_position(v.trip)


@query("trip_day_list", sql("""SELECT d.trip_id, d.day, count(t.stop_key) AS stops FROM (
  SELECT trip_id, unnest(range(1, greatest(max(day), 1) + 1)) AS day FROM trip GROUP BY trip_id) d LEFT JOIN trip t ON t.trip_id = d.trip_id AND t.day = d.day GROUP BY ALL""", "trip"))
def _(v):
    return records.day_list(v.trip)


@query("trip_owner_check", sql("""SELECT t.trip_id, count(*) AS rejected FROM trip t JOIN (SELECT trip_id, min(stop_key) % 5 AS owner FROM trip GROUP BY ALL) o USING (trip_id)
  WHERE t.stop_key % 5 <> o.owner GROUP BY ALL""", "trip"))
def _(v):
    owners = v.trip.groupBy("trip_id").agg((F.min("stop_key") % 5).alias("user_id"))
    incoming = v.trip.select("trip_id", (F.col("stop_key") % 5).alias("user_id"), "place_id")
    return records.upsert_trips(owners, incoming)[1].groupBy("trip_id").agg(F.count(F.lit(1)).alias("rejected"))


@query("dangling_visits", sql("SELECT place_id, count(*) AS visits FROM visit WHERE place_id NOT IN (SELECT place_id FROM pin) GROUP BY ALL", "visit", "pin"))
def _(v):
    return serve.dangling(v.visit, v.pin).groupBy("place_id").agg(F.count(F.lit(1)).alias("visits"))


@query("visits_with_places", sql("""SELECT event_id, visit.place_id, iso3, pin.place_id IS NULL AS dangling FROM visit LEFT JOIN pin USING (place_id)""", "visit", "pin"))
def _(v):
    return serve.visits_with_places(v.visit, v.pin).select("event_id", "place_id", "iso3", "dangling")


@query("bulk_diff", sql("", "visit", "pin").rstrip() + """,
cur AS (SELECT place_id, max_by(visited, (marked_at, side, event_id)) AS visited FROM visit WHERE user_id = 7 GROUP BY ALL)
SELECT p.place_id, coalesce(c.visited, false) AS was, p.score >= 50 AS want,
  CASE WHEN p.score >= 50 AND NOT coalesce(c.visited, false) THEN 'marked' WHEN coalesce(c.visited, false) AND p.score < 50 THEN 'unmarked' ELSE 'same' END AS change
FROM pin p LEFT JOIN cur c USING (place_id)""")
def _(v):
    current = records.merge_visits(v.visit.where(F.col("user_id") == 7), tie="event_id")
    return records.bulk_diff(current, v.pin.where(F.col("score") >= 50), v.pin)


@query("bulk_undo", sql("", "visit", "pin").rstrip() + """,
cur AS (SELECT place_id, max_by(visited, (marked_at, side, event_id)) AS visited FROM visit WHERE user_id = 7 GROUP BY ALL)
SELECT p.place_id, coalesce(c.visited, false) AS visited FROM pin p LEFT JOIN cur c USING (place_id) WHERE coalesce(c.visited, false) <> (p.score >= 50)""")
def _(v):
    current = records.merge_visits(v.visit.where(F.col("user_id") == 7), tie="event_id")
    return records.undo_bulk(records.bulk_diff(current, v.pin.where(F.col("score") >= 50), v.pin))


@query("upsert_visits", sql("", "visit").rstrip() + ",\n" + _ONE + """
SELECT coalesce(r.user_id, l.user_id) AS user_id, coalesce(r.place_id, l.place_id) AS place_id, coalesce(l.visited, r.visited) AS visited,
  coalesce(l.note, r.note) AS note FROM r FULL JOIN l ON r.user_id = l.user_id AND r.place_id = l.place_id""")
def _(v):
    current, patch = _sides(v)
    return records.upsert_visits(current, patch).select("user_id", "place_id", "visited", "note")


@query("delete_account", sql("SELECT user_id, count(*) AS n FROM visit WHERE user_id % 10 <> 3 GROUP BY ALL", "visit"))
def _(v):
    gone = v.visit.where(F.col("user_id") % 10 == 3).select("user_id").distinct()
    return records.delete_accounts(v.visit, gone).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("feedback_counts", sql("SELECT place_id, count(*) AS reports, count(DISTINCT user_id) AS people FROM visit WHERE note IS NOT NULL GROUP BY ALL", "visit"))
def _(v):
    return records.feedback_counts(v.visit.where(F.col("note").isNotNull()))


@query("owner_rows", sql("SELECT event_id, place_id FROM visit WHERE user_id = 7", "visit"))
def _(v):
    return records.owned_by(v.visit, 7).select("event_id", "place_id")


def _identities(v):
    """Sign-ins drawn from orders: an e-mail per customer, a subject per pair of orders."""
    k = F.col("o_orderkey")
    return v.table("orders").select(
        F.col("o_custkey").alias("user_id"), F.when(k % 2 == 0, "email").otherwise("other").alias("provider"),
        F.when(k % 2 == 0, F.concat(F.lit("U"), "o_custkey", F.lit("@x.test"))).otherwise(F.concat(F.lit("s"), (k / 50).cast("bigint"))).alias("subject"),
        F.when(k % 5 != 0, F.concat(F.lit("u"), "o_custkey", F.lit("@X.test"))).alias("email"))


@query("identity_links")
def _(v):
    linked, _ = records.link_identities(_identities(v))
    return linked.groupBy("person").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("identity").alias("identities"))
