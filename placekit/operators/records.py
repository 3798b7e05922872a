"""Travellers' records: visits, trips, profiles, feedback, identities.

Every owner query filters on ``user_id``; no row is ever deleted to unmark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.operators import graph
from placekit.plans.session import cut, number_within

VISIT_FIELDS = ("visited", "visited_on", "note")


def merge_visits(marks: DataFrame, keys=("user_id", "place_id"), tie: str | None = None) -> DataFrame:
    """Last write wins per (user, place) by ``marked_at``; local (side 1) wins ties.

    Fields the winner leaves null keep the newest earlier value, so unmarking keeps a note.
    ``tie`` orders marks of one side at one instant. Aggregated in partials: a user or place
    holding a third of all marks does not gather in one task before the map-side combine.
    """
    order = F.struct(F.col("marked_at"), F.col("side"), *([F.col(tie)] if tie else []))
    fields = [c for c in VISIT_FIELDS if c in marks.columns and c != "visited"]
    latest = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields]
    return marks.where(F.col("place_id").isNotNull()).groupBy(*keys).agg(
        F.max_by("visited", order).alias("visited"), F.max("marked_at").alias("marked_at"),
        F.max_by("side", order).alias("side"), *latest)


def import_visits(mine: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Import merges when strictly newer (T01): merged rows, and counts per user."""
    keys = ["user_id", "place_id"]
    other = theirs.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("marked_at", *VISIT_FIELDS)], F.lit(True).alias("_in"))
    valid, bad = other.where(F.col("place_id").isNotNull()), other.where(F.col("place_id").isNull())
    both = mine.withColumn("_mine", F.lit(True)).join(valid, keys, "full")
    added = F.col("_mine").isNull()
    newer = F.col("_in").isNotNull() & (added | (F.coalesce(F.col("_marked_at") > F.col("marked_at"), F.lit(False))))
    merged = both.select(*keys, *[F.when(newer, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) for c in ("marked_at", *VISIT_FIELDS)])
    verdict = F.when(added, "added").when(newer, "updated").when(F.col("_in").isNotNull(), "skipped")
    rows = both.select("user_id", verdict.alias("v")).unionByName(bad.select("user_id", F.lit("skipped").alias("v")))
    counts = rows.groupBy("user_id").agg(*[F.count(F.when(F.col("v") == v, 1)).alias(v) for v in ("added", "updated", "skipped")])
    return merged, counts


def upsert_visits(current: DataFrame, patches: DataFrame) -> DataFrame:
    """Idempotent upsert (T03): a patch sets what it carries and leaves the rest."""
    keys = ["user_id", "place_id"]
    patch = patches.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("marked_at", *VISIT_FIELDS)])
    out = current.join(patch, keys, "full")
    return out.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in ("marked_at", *VISIT_FIELDS)]).withColumn(
        "visited", F.coalesce("visited", F.lit(False)))


def once(events: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Replayed events count once."""
    return events.dropDuplicates([id_col])


def merge_trips(trips: DataFrame) -> DataFrame:
    """Union by id; local (side 1) wins a colliding id."""
    rest = [c for c in trips.columns if c not in ("trip_id", "side")]
    return trips.groupBy("trip_id").agg(F.max_by(F.struct("side", *rest), "side").alias("_t")).select("trip_id", "_t.*")


def merge_profiles(remote: DataFrame, local: DataFrame, fields: list[str]) -> DataFrame:
    """Non-empty local values overlay remote ones."""
    mine = local.select("user_id", *[F.col(c).alias(f"_{c}") for c in fields])
    out = remote.join(mine, "user_id", "full")
    return out.select("user_id", *[F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)).alias(c) for c in fields])


def upsert_trips(current: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Owner-checked trip upsert (T05): accepted table and rejected rows."""
    owners = current.select("trip_id", F.col("user_id").alias("_owner"))
    checked = incoming.join(owners, "trip_id", "left")
    foreign = F.col("_owner").isNotNull() & (F.col("_owner") != F.col("user_id"))
    ok, bad = checked.where(~foreign).drop("_owner"), checked.where(foreign).drop("_owner")
    kept = current.join(ok.select("trip_id"), "trip_id", "left_anti")
    return kept.unionByName(ok, allowMissingColumns=True), bad


def sign_in_merge(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Merge a device into an account (T01): the local row wins from an equal time on and lays
    its filled fields over the stored row; an older local row changes nothing."""
    keys = ["user_id", "place_id"]
    mine = local.where(F.col("place_id").isNotNull()).select(
        *keys, *[F.col(c).alias(f"_{c}") for c in ("marked_at", *VISIT_FIELDS)], F.lit(True).alias("_l"))
    both = remote.where(F.col("place_id").isNotNull()).withColumn("_r", F.lit(True)).join(mine, keys, "full")
    wins = F.col("_l").isNotNull() & (F.col("_r").isNull() | F.col("marked_at").isNull()
                                      | F.coalesce(F.col("_marked_at") >= F.col("marked_at"), F.lit(False)))
    return both.select(*keys, *[F.when(wins, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c)
                                for c in ("marked_at", *VISIT_FIELDS)])


# ------------------------------------------------------------------ trips
_DAY = ["trip_id", "day"]
_STOP_ORDER = ("position", "stop_key")


def trip_days(stops: DataFrame) -> DataFrame:
    """Stops in day order with labels and the next stop of the day; day 0 is the tray."""
    rows = cut(number_within(stops, _DAY, [F.col(c) for c in _STOP_ORDER]))
    after = rows.select(*_DAY, (F.col("_all") - 1).alias("_all"), F.col("place_id").alias("next_place"))
    out = rows.join(after, [*_DAY, "_all"], "left").drop("_all")
    tray = F.col("day") <= 0
    return (out.withColumn("label", F.when(~tray, F.concat(F.lit("D"), F.col("day").cast("string"), F.lit(" · "), F.col("nth").cast("string"))))
            .withColumn("next_place", F.when(~tray, F.col("next_place"))))


def reindex(stops: DataFrame) -> DataFrame:
    """Positions 0..n-1 within each day."""
    rows = number_within(stops, _DAY, [F.col(c) for c in _STOP_ORDER])
    return rows.withColumn("position", (F.col("nth") - 1).cast("bigint")).drop("nth", "_all")


def next_position(stops: DataFrame) -> DataFrame:
    """Where a stop added to a day goes."""
    return stops.groupBy(*_DAY).agg((F.max("position") + 1).alias("next_position"))


def move_stop(stops: DataFrame, moves: DataFrame) -> DataFrame:
    """Move stops to a day and index (null = end), then re-index that day.

    ``moves``: trip_id, place_id, to_day, to_index; one move per stop.
    """
    marked = stops.join(moves, ["trip_id", "place_id"], "left")
    moved = marked.where(F.col("to_day").isNotNull())
    stay = number_within(marked.where(F.col("to_day").isNull()), _DAY, [F.col(c) for c in _STOP_ORDER])
    # a moved stop sits just before the peer now holding its index
    stay = stay.withColumn("_slot", (F.col("nth") - 1).cast("double")).drop("nth", "_all")
    slot = F.coalesce(F.col("to_index").cast("double") - 0.5, F.lit(float("inf")))
    both = stay.unionByName(moved.withColumn("_slot", slot).withColumn("day", F.col("to_day").cast(stops.schema["day"].dataType)))
    touched = moves.select("trip_id", F.col("to_day").alias("day")).distinct().withColumn("_touch", F.lit(True))
    out = number_within(both, _DAY, [F.col("_slot"), F.col("stop_key")]).join(touched, _DAY, "left")
    return out.withColumn("position", F.when(F.col("_touch"), F.col("nth") - 1).otherwise(F.col("position")).cast("bigint")).select(*stops.columns)


def day_list(stops: DataFrame) -> DataFrame:
    """Every day of a trip with its stop count, empty days included; at least one day."""
    span = stops.groupBy("trip_id").agg(F.greatest(F.max("day"), F.lit(1)).alias("_last"))
    days = span.select("trip_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_last").cast("bigint"))).alias("day"))
    counts = stops.groupBy("trip_id", F.col("day").cast("bigint").alias("day")).agg(F.count(F.lit(1)).alias("stops"))
    return days.join(counts, ["trip_id", "day"], "left").withColumn("stops", F.coalesce("stops", F.lit(0).cast("bigint")))


# ------------------------------------------------------------------ bulk
def bulk_diff(current: DataFrame, ticked: DataFrame, universe: DataFrame) -> DataFrame:
    """What a bulk confirm changes, with the flag to restore on undo: place_id, was, want, change."""
    have = current.where("visited").select("place_id", F.lit(True).alias("_was"))
    want = ticked.select("place_id", F.lit(True).alias("_want"))
    out = universe.select("place_id").distinct().join(have.distinct(), "place_id", "left").join(want.distinct(), "place_id", "left")
    was, aim = F.coalesce("_was", F.lit(False)), F.coalesce("_want", F.lit(False))
    change = F.when(aim & ~was, "marked").when(was & ~aim, "unmarked").otherwise("same")
    return out.select("place_id", was.alias("was"), aim.alias("want"), change.alias("change"))


def undo_bulk(diff: DataFrame) -> DataFrame:
    """Rows to write back: the previous flag of everything the confirm changed."""
    return diff.where(F.col("change") != "same").select("place_id", F.col("was").alias("visited"))


# ------------------------------------------------------------------ accounts
def delete_accounts(table: DataFrame, gone: DataFrame) -> DataFrame:
    """A table without the rows of deleted users."""
    return table.join(gone.select("user_id"), "user_id", "left_anti")


def forget_feedback(feedback: DataFrame, gone: DataFrame) -> DataFrame:
    """Feedback outlives its author, without the author."""
    mark = gone.select("user_id").distinct().withColumn("_gone", F.lit(True))
    out = feedback.join(mark, "user_id", "left")
    return out.withColumn("user_id", F.when(F.col("_gone").isNull(), F.col("user_id"))).drop("_gone").select(*feedback.columns)


def owned_by(table: DataFrame, user_id, public_null: bool = False) -> DataFrame:
    """Only the owner's rows; feedback without an owner is public."""
    mine = F.col("user_id") == user_id
    return table.where(F.col("user_id").isNull() | mine if public_null else mine)


def feedback_counts(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("place_id").agg(F.count(F.lit(1)).alias("reports"), F.count_distinct("user_id").alias("people"))


def link_identities(identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provider subjects and e-mail addresses that belong together become one person.

    ``identities``: user_id, provider, subject, email. Returns (identity, person) and the
    people in conflict: one linked group holding more than one user_id.
    """
    email = F.lower(F.trim("email"))
    ident = F.concat_ws(":", "provider", F.when(F.col("provider") == "email", F.lower(F.trim("subject"))).otherwise(F.col("subject")))
    rows = identities.withColumn("identity", ident).withColumn("_mail", F.when(email != "", F.concat(F.lit("email:"), email)))
    edges = rows.select(F.col("identity").alias("a"), F.coalesce("_mail", "identity").alias("b"))
    labels = graph.components(edges).withColumnRenamed("node", "identity").withColumnRenamed("label", "person")
    linked = rows.join(labels, "identity")
    conflicts = linked.where(F.col("user_id").isNotNull()).groupBy("person").agg(
        F.min("user_id").alias("first_user"), F.max("user_id").alias("other_user"),
        F.count_distinct("user_id").alias("users")).where(F.col("users") > 1)
    return linked.select("identity", "provider", "subject", "user_id", "person"), conflicts


def export_record(visits: DataFrame, trips: DataFrame, profiles: DataFrame, build: str) -> DataFrame:
    """One portable document per traveller."""
    v = visits.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("place_id", "visited", "marked_at", "visited_on", "note"))).alias("visits"))
    t = trips.groupBy("user_id").agg(F.collect_list(F.struct(*[c for c in trips.columns if c != "user_id"])).alias("trips"))
    p = profiles.select("user_id", F.struct(*[c for c in profiles.columns if c != "user_id"]).alias("profile"))
    out = v.join(t, "user_id", "full").join(p, "user_id", "full")
    return out.select(F.lit("placekit/record").alias("format"), F.lit(1).alias("version"),
                      F.lit(build).alias("place_database_build"), "user_id", "visits", "trips", "profile")
