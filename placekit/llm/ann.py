"""Approximate nearest neighbours by multi-index hashing.

Vectors are rotated by a matrix learned on a bounded sample (iterative quantisation) and become 64-bit codes of signs.
Codes are cut into eight substrings of eight bits, each with a table of its own. If two codes differ in at most ``r``
bits, then by the pigeonhole principle some substring differs in at most ``r // 8`` (and past ``r % 8`` of them, in one
less); probing every table that near finds every code within ``r``. Those are reranked by the exact cosine of the
original vectors. A query that finds too few widens its radius until it has them.

The index is a table of vectors spread over tasks by id, each with its part's substring tables. Queries come in blocks
of bounded size, each broadcast to all parts; parts return their nearest only.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placekit.llm.common import cut

BITS, PARTS, WIDTH = 64, 8, 8
SAMPLE = 4096
QUERY_BLOCK = 4096
PART_ROWS = 20_000
RECALL = 0.97
EVERY = 50
_U = np.uint64


@dataclass
class Codes:
    """What is learned: a projection to 64 signs, and the radius that holds ``RECALL`` of the sample's neighbours."""

    matrix: np.ndarray
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.matrix > 0, axis=1).view(_U).ravel() if len(x) else np.zeros(0, _U)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(x: np.ndarray, k: int, seed: int = 5, rounds: int = 20) -> Codes:
    """Rotations that bring unit vectors close to sign vectors, as many as make 64 bits of the given dimensions."""
    rng, x = np.random.default_rng(seed), unit(x)
    _, _, axes = np.linalg.svd(x, full_matrices=False) if len(x) else (0, 0, np.eye(x.shape[1]))
    axes = axes[:BITS].T
    blocks, have = [], 0
    while have < BITS:
        v = x @ axes
        r, _ = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        blocks.append(axes @ r)
        have += axes.shape[1]
    codes = Codes(np.concatenate(blocks, axis=1)[:, :BITS], BITS)
    if len(x) > k:
        c, asked = codes.encode(x), np.arange(0, len(x), max(1, len(x) // 256))
        near = x[asked] @ x.T
        near[np.arange(len(asked)), asked] = -2
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        codes.radius = int(np.quantile(np.bitwise_count(c[asked][:, None] ^ c[best]), RECALL, method="higher"))
    return codes


def probes(radius: int, part: int) -> np.ndarray:
    """All changes of a substring that a code within ``radius`` may have in substring ``part``, if no other has it nearer."""
    reach = radius // PARTS - (part > radius % PARTS)
    return np.array([sum(1 << i for i in c) for k in range(reach + 1) for c in itertools.combinations(range(WIDTH), k)], np.int64)


class SubstringTables:
    """The codes of one part of the index, by each of their substrings."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        values = codes.view(np.uint8).reshape(-1, PARTS)
        self.order = [np.argsort(values[:, p], kind="stable") for p in range(PARTS)]
        self.starts = [np.searchsorted(values[o, p], np.arange((1 << WIDTH) + 1)) for p, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every position whose code is within ``radius`` bits of ``code``."""
        seen = np.zeros(len(self.codes), bool)
        own = np.array([code], _U).view(np.uint8)
        for p in range(PARTS):
            starts, order = self.starts[p], self.order[p]
            for value in own[p] ^ probes(radius, p):
                seen[order[starts[value]:starts[value + 1]]] = True
        near = np.flatnonzero(seen)
        return near[np.bitwise_count(self.codes[near] ^ code) <= radius]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` (double), one row per id: without null, zero or non-finite vectors, of the usual dimension.

    Of rows that repeat an id the least vector counts; rows with a null id have no name and take no part.
    """
    e = F.col("embedding").cast("array<double>")
    ok = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select("vec_id", e.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok)
    rows = cut(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    usual = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (usual[0]["d"] if usual else 0))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search(vectors: DataFrame, k: int = 5, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest by cosine that were found for each query.

    ``vectors`` needs ``vec_id, embedding``; other columns are ignored. Queries are the rows whose id is divisible by
    ``every``; candidates all others. Equal scores go by the smaller id. Fewer than ``k`` others: all of them. Which
    rows take no part, ``usable`` says. No usable vector, or an empty table: no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    n = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE))) == 0).orderBy(F.xxhash64("vec_id")).limit(SAMPLE)
    learned = np.array([r["embedding"] for r in sample.collect()], float)  # SAMPLE vectors at most
    codes = learn(learned, k) if len(learned) else Codes(np.zeros((1, BITS)), BITS)
    parts = max(1, -(-n // PART_ROWS), min(n // 500, spark.sparkContext.defaultParallelism))
    index = cut(rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        # a block has about QUERY_BLOCK queries, whatever their number
        block = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)) == b).collect()
        radius, left = codes.radius, {r["vec_id"]: r["embedding"] for r in block}
        while left:
            got = cut(_probe(index, parts, codes, left, radius, k))
            missing = {}
            if radius < BITS:
                full = {r["query_id"] for r in got.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select("query_id").collect()}
                missing = {q: v for q, v in left.items() if q not in full}
            # what too small a radius found is found again by the wider one; what is done stays
            if len(missing) < len(left):
                done = got.where(~F.col("query_id").isin(list(missing))) if missing else got
                found = done if found is None else found.unionByName(done)
            left, radius = missing, min(BITS, radius + 8)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _probe(index: DataFrame, parts: int, codes: Codes, queries: dict, radius: int, k: int) -> DataFrame:
    """The nearest ``k`` of each part for each query, of all within ``radius`` bits."""
    ids = np.array(list(queries), np.int64)
    ask = np.array(list(queries.values()), float)
    shared = index.sparkSession.sparkContext.broadcast((ids, ask, codes.encode(ask), codes, radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ask, ask_codes, codes, radius = shared.value
        held = [(b.column("vec_id").to_numpy(zero_copy_only=False), _matrix(b.column("embedding"))) for b in batches if b.num_rows]  # a part of about PART_ROWS rows
        if not held:
            return
        own, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        size, tables = np.sqrt(np.einsum("ij,ij->i", x, x)), SubstringTables(codes.encode(x))
        out = ([], [], [])
        for q, v, c in zip(ids, ask, ask_codes, strict=True):
            near = tables.within(c, radius)
            near = near[own[near] != q]
            if not len(near):
                continue
            scores = (x[near] @ v) / (size[near] * np.sqrt(v @ v))
            if len(near) > 4 * k:  # all that may be among the best, ties too
                keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                near, scores = near[keep], scores[keep]
            top = _best(own[near], scores, k)
            out[0].append(np.full(len(top), q))
            out[1].append(own[near][top])
            out[2].append(scores[top])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    # every part is a whole task: the stored table's files are dealt out again by part
    dealt = index.repartition(parts, "part").select("vec_id", "embedding")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")
