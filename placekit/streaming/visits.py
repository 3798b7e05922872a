"""Mark events as a stream: last write wins, and kinds newly seen, both without a watermark.

Any lateness is legal, so state is keyed by (user, place) or user and never dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from placekit.functions.vocab import KIND_CODES
from placekit.operators.records import merge_visits

_SEEN = "user_id bigint, scope string, kind string"


def read_marks(spark, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _combine(rows: DataFrame) -> DataFrame:
    """Newest mark and newest note per (user, place). Applying it twice changes nothing."""
    order, note = F.struct("marked_at", "side", "event_id"), F.struct("note_at", "note_side", "note_event")
    last = rows.groupBy("user_id", "place_id").agg(
        F.max_by(F.struct("visited", "marked_at", "side", "event_id"), order).alias("w"),
        F.max_by(F.struct("note", "note_at", "note_side", "note_event"), F.when(F.col("note").isNotNull(), note)).alias("n"))
    return last.select("user_id", "place_id", "w.*", "n.*")


def _parts(spark, path: str, batch: int, every: int) -> DataFrame:
    """The last compacted table at or before ``batch`` and the deltas after it."""
    base = (batch + 1) // every * every - 1
    names = ([f"{path}/base/{base}"] if base >= 0 else []) + [f"{path}/delta/{n}" for n in range(base + 1, batch + 1)]
    return spark.read.parquet(*names)


def write_merged(marks: DataFrame, path: str, checkpoint: str, compact_every: int = 16):
    """Last write wins as a stream.

    A batch writes only its own combined delta, under its own number, so a replayed batch
    rewrites the same rows; every ``compact_every`` batches the deltas are folded into a new
    base. Work per batch follows the batch, not the table.
    """
    def merge(batch: DataFrame, number: int) -> None:
        new = batch.select("user_id", "place_id", "visited", "marked_at", "side", "event_id", "note", F.col("marked_at").alias("note_at"),
                           F.col("side").alias("note_side"), F.col("event_id").alias("note_event")).where(F.col("place_id").isNotNull())
        _combine(new).write.mode("overwrite").parquet(f"{path}/delta/{number}")
        if (number + 1) % compact_every == 0:
            spark = batch.sparkSession
            start = number - compact_every
            names = ([f"{path}/base/{start}"] if start >= 0 else []) + [f"{path}/delta/{n}" for n in range(start + 1, number + 1)]
            _combine(spark.read.parquet(*names)).write.mode("overwrite").parquet(f"{path}/base/{number}")

    return marks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")


def merged_table(spark, path: str, batch: int, compact_every: int = 16) -> DataFrame:
    """The merged record as of a batch."""
    return _combine(_parts(spark, path, batch, compact_every)).select("user_id", "place_id", "visited", "marked_at", "note")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _FirstSeen(StatefulProcessor):
    """Kinds seen so far of one traveller, a bitmask per scope."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.masks = handle.getMapState("masks", "scope string", "mask bigint", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, int] = {}
        for pdf in rows:
            pdf = pdf[pdf["visited"].astype(bool)]
            for scope, masks in pdf.groupby("scope")["kmask"]:
                new[scope] = new.get(scope, 0) | int(np.bitwise_or.reduce(masks.to_numpy(np.int64), initial=0))
        out = []
        for scope, mask in sorted(new.items()):
            seen = int(self.masks.getValue((scope,))[0]) if self.masks.containsKey((scope,)) else 0
            self.masks.updateValue((scope,), (seen | mask,))
            out += [(key[0], scope, c) for i, c in enumerate(KIND_CODES) if (mask & ~seen) >> i & 1]
        yield pd.DataFrame(out, columns=["user_id", "scope", "kind"])

    def close(self) -> None:
        pass


def scopes(places: DataFrame) -> DataFrame:
    """``place_id, kmask, scope``: a place once in the world, in its country and in its territory.

    ``places``: place_id, kmask, and iso3 and territory_id where they are known.
    """
    have = [F.concat(F.lit(f"{name}:"), F.col(c)) for name, c in (("country", "iso3"), ("territory", "territory_id")) if c in places.columns]
    return places.select("place_id", "kmask", F.explode(F.filter(F.array(F.lit("world"), *have), lambda s: s.isNotNull())).alias("scope"))


def newly_seen(marks: DataFrame, places: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """Each kind a traveller sees for the first time in a scope, emitted once: user_id, scope, kind.

    State is a map per user, one bitmask a scope, kept by RocksDB (``STATE_STORE`` must be the session's provider). With
    ``forget_ms`` a scope that saw no mark for so long is forgotten, and its kinds are new again.
    """
    rows = marks.join(scopes(places), "place_id").select("user_id", "visited", "scope", "kmask")
    return rows.groupBy("user_id").transformWithStateInPandas(
        _FirstSeen(forget_ms), _SEEN, "Append", "ProcessingTime" if forget_ms else "None")


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Running count of disputed-place reports."""
    return feedback.groupBy("place_id").agg(F.count(F.lit(1)).alias("reports"))


def batch_equivalent(marks: DataFrame) -> DataFrame:
    """What the stream must converge to."""
    return merge_visits(marks, tie="event_id").select("user_id", "place_id", "visited", "marked_at", "note")
