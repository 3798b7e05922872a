"""Small helpers the operators of this package share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placekit.plans.session import _folder, cut

WORD = r"[^\x20\x09-\x0D]+"
SEED = 0x9E3779B97F4A7C15


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``)."""
    return _folder(spark)


def row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A name per row of a stored table: a hash of the path of its file, and its place there.

    Two scans of one table name it alike, however it is split, so decisions made on a few columns can be joined back to
    whole rows even where rows repeat or keys are null. ``df`` must be a table read from Parquet, or columns of one.
    """
    place = df.metadataColumn("_metadata")
    return df.withColumn(name, F.concat_ws(":", F.hex(F.xxhash64(place["file_path"])), place["row_index"].cast("string")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the text of ``column`` stays near ``limit`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
        start, room = 0, 0
        for i, size in enumerate(sizes):
            if i > start and room + size > limit:
                yield batch.slice(start, i - start)
                start, room = i, 0
            room += size
        yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes or str) -> 64-bit hash, computed once per task for each word; forgets all when it grows too large."""

    ROOM = 1_000_000

    def __missing__(self, word):
        if len(self) >= self.ROOM:
            self.clear()
        raw = word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass")
        value = self[word] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
        return value


def concat_words(words_of: list[list], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of several documents in one array, and where each document starts (one more than documents)."""
    starts = np.zeros(len(words_of) + 1, np.int64)
    np.cumsum([len(w) for w in words_of], out=starts[1:])
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words_of)), np.uint64, int(starts[-1]))
    return flat, starts


BITMAP_BITS = 1 << 26


def may_be_in(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` may occur in ``keys``: all that do, and a few others.

    A bitmap of hashes, 8 MB at any size of the data, is broadcast, so a join that keeps few rows shuffles few.
    """
    bit = F.pmod(F.xxhash64(column), F.lit(BITMAP_BITS))
    maps = keys.select(F.bitmap_bucket_number(bit).alias("_bucket"), F.bitmap_bit_position(bit).alias("_at")).groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_map"))
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number(bit)).withColumn("_at", F.bitmap_bit_position(bit))
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.pow(F.lit(2), F.col("_at") % 8).cast("int")) != 0
    return marked.join(F.broadcast(maps), "_bucket").where(held).drop("_bucket", "_at", "_map")


def keep_rows(docs: DataFrame, column: str, decide: Callable[[list], list[bool]]) -> DataFrame:
    """The rows, all columns, of which ``decide`` says so from ``column``; it gets a bounded batch of values at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            yield batch.filter(pa.array(decide(batch.column(column).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
