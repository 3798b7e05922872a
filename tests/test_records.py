from datetime import datetime

from pyspark.sql import functions as F

from placekit.operators import records
from placekit.streaming import visits

MARK = "user_id bigint, place_id string, visited boolean, marked_at timestamp, visited_on string, note string"
T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def marks(spark, *rows):
    return spark.createDataFrame(list(rows), MARK)


def test_sign_in_merge_local_wins_ties_and_keeps_remote_notes(spark):
    remote = marks(spark, (1, "p", False, T1, None, "kept"), (1, "q", True, T2, None, None))
    local = marks(spark, (1, "p", True, T1, None, None), (1, "q", False, T1, None, "old"), (1, "r", True, T1, None, None))
    got = {r.place_id: (r.visited, r.note) for r in records.sign_in_merge(remote, local).collect()}
    assert got == {"p": (True, "kept"), "q": (True, None), "r": (True, None)}
    _, counts = records.import_visits(remote, local)
    assert [(r.added, r.updated, r.skipped) for r in counts.collect()] == [(1, 0, 2)]


def test_unmarking_keeps_the_row_and_put_is_idempotent(spark):
    now = marks(spark, (1, "p", True, T1, "2020-05-01", "note"))
    patch = marks(spark, (1, "p", False, T2, None, None))
    once = records.upsert_visits(now, patch)
    twice = records.upsert_visits(once, patch)
    assert once.exceptAll(twice.select(once.columns)).count() == 0
    assert [(r.visited, r.note, r.visited_on) for r in once.collect()] == [(False, "note", "2020-05-01")]


def test_accounts_are_isolated_and_deletion_cascades(spark):
    rows = marks(spark, (1, "p", True, T1, None, None), (2, "p", True, T1, None, None))
    assert [r.user_id for r in records.owned_by(rows, 2).collect()] == [2]
    gone = spark.createDataFrame([(1,)], "user_id bigint")
    assert [r.user_id for r in records.delete_accounts(rows, gone).collect()] == [2]
    assert sorted([r.user_id for r in records.forget_feedback(rows, gone).collect()], key=str) == [2, None]


def test_moving_a_stop_reindexes_its_day(spark):
    stops = spark.createDataFrame([(1, "a", 1, 1, 0), (1, "b", 2, 1, 1), (1, "c", 3, 2, 0)], "trip_id bigint, place_id string, stop_key bigint, day bigint, position bigint")
    moves = spark.createDataFrame([(1, "c", 1, 1)], "trip_id bigint, place_id string, to_day bigint, to_index int")
    got = {r.place_id: (r.day, r.position) for r in records.move_stop(stops, moves).collect()}
    assert got == {"a": (1, 0), "c": (1, 1), "b": (1, 2)}


def test_linked_identities_and_their_conflict(spark):
    rows = spark.createDataFrame([(1, "email", "A@x.test", "a@x.test"), (1, "other", "s1", "a@x.test"), (2, "other", "s2", "b@x.test"), (3, "email", "b@x.test", None)],
                                 "user_id bigint, provider string, subject string, email string")
    linked, conflicts = records.link_identities(rows)
    assert len({r.person for r in linked.collect()}) == 2
    assert [(r.first_user, r.other_user) for r in conflicts.collect()] == [(2, 3)]


def test_the_stream_converges_to_the_batch_merge(spark, tmp_path):
    schema = "event_id bigint, user_id bigint, place_id string, visited boolean, marked_at timestamp, note string, side bigint"
    rows = [(i, i % 5, f"p{i * 7 % 11}", i % 3 != 0, datetime(2024, 1, 1 + (i * 13) % 9), f"n{i}" if i % 4 == 0 else None, i % 2) for i in range(120)]
    src = str(tmp_path / "in")
    for part in range(5):
        spark.createDataFrame(rows[part::5], schema).coalesce(1).write.mode("append").parquet(src)
    stream = visits.read_marks(spark, src, schema, files_per_batch=1)
    q = visits.write_merged(stream, str(tmp_path / "out"), str(tmp_path / "ck"), compact_every=2).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = visits.batch_equivalent(spark.createDataFrame(rows, schema))
    got = visits.merged_table(spark, str(tmp_path / "out"), 4, compact_every=2)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # three scopes, and a restart after the first half
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", visits.STATE_STORE)
    places = spark.createDataFrame([(f"p{i}", 1 << i % 3, f"C{i % 2}", f"T{i % 4}" if i else None) for i in range(11)], "place_id string, kmask int, iso3 string, territory_id string")
    half, df = str(tmp_path / "half"), spark.createDataFrame(rows, schema)
    df.where("event_id % 2 = 0").write.parquet(half)
    got = set()
    for _ in range(2):
        q = (visits.newly_seen(visits.read_marks(spark, half, schema, 2), places).writeStream.format("parquet").option("path", str(tmp_path / "fresh"))
             .option("checkpointLocation", str(tmp_path / "ck2")).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination(120)
        out = [(r.user_id, r.scope, r.kind) for r in spark.read.parquet(str(tmp_path / "fresh")).collect()]
        assert len(out) == len(set(out)) and got <= set(out)
        got = set(out)
        df.where("event_id % 2 = 1").write.mode("append").parquet(half)
    where = {f"p{i}": ["world", f"country:C{i % 2}", *([f"territory:T{i % 4}"] if i else [])] for i in range(11)}
    seen = {(r[1], s, f"A{int(r[2][1:]) % 3 + 1}") for r in rows if r[3] for s in where[r[2]]}
    assert got == seen and {s.split(":")[0] for _, s, _ in got} == {"world", "country", "territory"}
