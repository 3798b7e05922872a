"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

Windows of a few sizes slide over every document; each size serves the benchmark items a little longer than it. A
window's fingerprint has 64 bits, each the sign of its word pairs' hash bits. All fingerprints of an item's own
windows of that size are indexed. A document's windows are ``stride`` words apart, no more than an item has windows, so
one window of a whole copy equals one of the item's, wherever the copy begins.

Fingerprints within ``radius`` bits must agree within ``radius // 4`` bits in one of four blocks; tables of all block
values that near find every such pair. Each pair names an item and a place; there the item's words' worth of the
document is compared by the exact similarity of weighted five-word shingles (a shingle weighs as often as it occurs).
Where no such slice is similar enough, as when words were inserted or deleted, every span around the place that can be
is compared, and the best counts.

The benchmark is indexed in blocks of bounded size, one pass over the documents for each; a usual one needs one.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.llm.common import WordHashes, concat_words, keep_rows, mix, slices

SHINGLE = 5
PERCENT = 80
RADIUS = 11
BLOCK_ITEMS, BLOCK_WORDS = 2_000, 200_000
BITS, PARTS = 64, 4
PIECE = 1 << 17  # words fingerprinted at once
RUN = 32
_WORD = re.compile(r"\w+")
_U = np.uint64


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def window_size(n: int) -> int:
    """The window that serves items of ``n`` words: the longest of a fixed ladder not over five sixths of ``n``."""
    size, w = 4, 4
    while w <= max(4, n - n // 6):
        size, w = w, max(w + 1, w * 6 // 5)
    return size


def pair_hashes(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * _U(3) + mix(h[1:]))


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    if len(h) < SHINGLE:
        return np.zeros(0, _U)
    out = np.zeros(len(h) - SHINGLE + 1, _U)
    for i in range(SHINGLE):
        out = mix(out + h[i:len(h) - SHINGLE + 1 + i])
    return out


def bit_sums(pairs: np.ndarray, longest: int) -> np.ndarray:
    """Running sums of each hash bit, one row more than pairs: inside runs of ``RUN`` rows, then over the runs."""
    kind = np.int16 if longest < 30_000 else np.int32
    runs = -(-len(pairs) // RUN)
    bits = np.unpackbits(np.pad(pairs, (0, runs * RUN - len(pairs))).view(np.uint8).reshape(-1, 8), axis=1).reshape(runs, RUN, BITS)
    sums = np.zeros((runs * RUN + 1, BITS), kind)
    inner = sums[1:].reshape(runs, RUN, BITS)
    inner[:, 0] = bits[:, 0]
    for i in range(1, RUN):
        np.add(inner[:, i - 1], bits[:, i], out=inner[:, i])
    inner[1:] += np.cumsum(inner[:-1, -1], axis=0, dtype=kind)[:, None]
    return sums[:len(pairs) + 1]  # wraps around; differences don't


def fingerprints(sums: np.ndarray, first: int, stop: int, stride: int, w: int) -> np.ndarray:
    """Fingerprints of the windows of ``w`` words that begin at ``first``, ``first + stride``, ... before ``stop``."""
    ones = sums[first + w - 1:stop + w - 1:stride] - sums[first:stop:stride]
    return np.packbits(ones > (w - 1) // 2, axis=1).view(_U).ravel()


def similar(a: Counter, b: Counter) -> float:
    union = (a | b).total()
    return (a & b).total() / union if union else 0.0


def best_span(r: np.ndarray, starts: np.ndarray, want: Counter) -> tuple[float, int]:
    """The best similarity of a run of shingles of ``r`` that begins at one of ``starts``, and its begin; 0 if under ``PERCENT``.

    The best begins and ends with a shingle of the item: without another one at an end it would be better.
    """
    m, best = want.total(), (0.0, 0)
    fewest, most = -(-PERCENT * m // 100), 100 * m // PERCENT
    held = np.isin(r, np.fromiter(want, _U, len(want)))
    sums = np.concatenate([[0], np.cumsum(held)])
    starts = starts[(starts >= 0) & (starts < len(r))]
    starts = starts[held[starts] & (sums[np.minimum(starts + most, len(r))] - sums[starts] >= fewest)]
    for a in starts.tolist():
        left, common = dict(want), 0
        for k, x in enumerate(r[a:a + most].tolist(), 1):
            if left.get(x, 0):
                left[x] -= 1
                common += 1
                if 100 * common >= PERCENT * (m + k - common) and common / (m + k - common) > best[0]:
                    best = common / (m + k - common), a
    return best


@dataclass
class SizeIndex:
    """Fingerprints of the items that windows of one size serve, and their block tables."""

    window: int
    stride: int
    prints: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    starts: list[np.ndarray]
    owners: list[np.ndarray]

    def near(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """All (window, fingerprint) pairs within ``radius`` bits."""
        found = []
        for b in range(PARTS):
            value = ((prints >> _U(16 * b)) & _U(0xFFFF)).astype(np.int64)
            first, count = self.starts[b][value], self.starts[b][value + 1] - self.starts[b][value]
            hit = np.flatnonzero(count)
            count = count[hit]
            win = np.repeat(hit, count)
            within = np.arange(len(win)) - np.repeat(np.cumsum(count) - count, count)
            own = self.owners[b][np.repeat(first[hit], count) + within]
            ok = np.bitwise_count(prints[win] ^ self.prints[own]) <= radius
            found.append(win[ok] * np.int64(len(self.prints)) + own[ok])
        return np.divmod(np.unique(np.concatenate(found)), len(self.prints))


def block_tables(prints: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each block, which fingerprints have a value within ``radius // PARTS`` bits of each of the 65,536."""
    flips = np.array([sum(1 << i for i in c) for k in range(radius // PARTS + 1) for c in itertools.combinations(range(16), k)], np.int64)
    starts, owners = [], []
    for b in range(PARTS):
        value = ((prints >> _U(16 * b)) & _U(0xFFFF)).astype(np.int64)
        reach = (value[:, None] ^ flips).ravel()
        order = np.argsort(reach, kind="stable")
        starts.append(np.searchsorted(reach[order], np.arange(65_537)))
        owners.append(np.repeat(np.arange(len(prints)), len(flips))[order].astype(np.int32))
    return starts, owners


class BenchmarkIndex:
    """What is broadcast: a block of items, bounded by ``BLOCK_ITEMS`` and ``BLOCK_WORDS``."""

    def __init__(self, items: list[tuple[int, str | None]], radius: int = RADIUS):
        self.radius, self.ids, self.lengths, self.shingles = radius, [], [], []
        hashes, by_size = WordHashes(), defaultdict(list)
        for item_id, text in items:
            h, _ = concat_words([words(text)], hashes)
            if len(h) < SHINGLE:
                continue
            by_size[window_size(len(h))].append((len(self.ids), h))
            self.ids.append(item_id)
            self.lengths.append(len(h))
            self.shingles.append(Counter(shingle_hashes(h).tolist()))
        self.sizes = []
        for w, of in sorted(by_size.items()):
            prints, item, offset = [], [], []
            for i, h in of:
                at = np.arange(len(h) - w + 1)
                prints.append(fingerprints(bit_sums(pair_hashes(h), w), 0, len(at), 1, w))
                item.append(np.full(len(at), i))
                offset.append(at)
            prints = np.concatenate(prints)
            self.sizes.append(SizeIndex(w, min(len(h) - w + 1 for _, h in of), prints, np.concatenate(item), np.concatenate(offset), *block_tables(prints, radius)))

    def candidates(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of (item, word at which it would begin) for windows over the words ``h``."""
        longest = max((s.window for s in self.sizes), default=0)
        piece = max(PIECE, 4 * longest)
        for a in range(0, len(h), piece):
            part = h[a:a + piece + longest]
            sums = bit_sums(pair_hashes(part), longest) if len(part) > 1 else np.zeros((1, BITS), np.int16)
            for s in self.sizes:
                first, stop = -a % s.stride, min(piece, len(part) - s.window + 1)
                if first < stop:
                    win, own = s.near(fingerprints(sums, first, stop, s.stride, s.window), self.radius)
                    if len(win):
                        yield s.item[own], a + first + win * s.stride - s.offset[own]

    def span(self, h: np.ndarray, at: list[int], i: int) -> tuple[float, int]:
        """The best similarity of item ``i`` with a span of the words ``h`` near the places ``at``, and where it begins."""
        # a similar span has at most a quarter more or a fifth fewer shingles, so it begins no further away
        m, best = self.lengths[i] - SHINGLE + 1, (0.0, 0)
        near, k = -(-m // 4), 0
        while k < len(at):
            first = last = at[k]
            while k < len(at) and at[k] <= last + 2 * near:
                last, k = at[k], k + 1
            a = max(0, first - near)
            r = shingle_hashes(h[a:last + near + 100 * m // PERCENT + SHINGLE])
            found = best_span(r, np.arange(max(0, last + near + 1 - a)), self.shingles[i])
            if found[0] > best[0]:
                best = found[0], a + found[1]
        return best

    def search(self, texts: list[str | None], hashes: WordHashes) -> list[list[tuple[int, int, float]]]:
        """For each text, its items with the place and similarity of the best match."""
        h, starts = concat_words([words(t) for t in texts], hashes)
        out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
        if not self.sizes or not len(h):
            return out
        found = list(self.candidates(h))
        if not found:
            return out
        item = np.concatenate([f[0] for f in found])
        at = np.concatenate([f[1] for f in found])
        length = np.array(self.lengths)[item]
        # the item's place must be in the document that has the middle of it
        middle = np.clip(at + length // 2, 0, len(h) - 1)
        doc = np.searchsorted(starts, middle, side="right") - 1
        places: dict[tuple[int, int], list[int]] = defaultdict(list)
        for d, i, p in sorted(set(zip(doc.tolist(), item.tolist(), at.tolist(), strict=True))):
            places[d, i].append(p)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for (d, i), at in places.items():
            for p in at:
                a, b = max(p, int(starts[d])), min(p + self.lengths[i], int(starts[d + 1]))
                score = similar(Counter(shingle_hashes(h[a:b]).tolist()), self.shingles[i])
                if score * 100 >= PERCENT - 1e-9 and score > best.get((d, i), (0.0, 0))[0]:
                    best[d, i] = (score, a - int(starts[d]))
            if (d, i) not in best:
                score, p = self.span(h[starts[d]:starts[d + 1]], [p - int(starts[d]) for p in at], i)
                if score:
                    best[d, i] = (score, p)
        for (d, i), (score, p) in sorted(best.items()):
            out[d].append((self.ids[i], p, score))
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """Items in blocks that each fit the driver and every task."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0)).alias("w")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["w"] // BLOCK_WORDS))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, item_id, start_word, similarity``: each document that holds a benchmark item, with its best place.

    ``docs`` needs ``doc_id, text``, ``benchmark`` needs ``item_id, text``; other columns are ignored. Null and empty
    texts hold nothing. Items under five words have no shingle and are found nowhere. Rows that repeat are each
    reported; of equal places the first counts. ``similarity`` is that of as many words as the item has, or where those
    aren't similar enough, of the most similar span. Either table empty: no rows.
    """
    spark, out = docs.sparkSession, None
    kind = docs.schema["doc_id"].dataType.simpleString()
    for items in item_blocks(benchmark):
        index = spark.sparkContext.broadcast(BenchmarkIndex(items, radius))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in slices(batches, "text"):
                found = index.value.search(batch.column("text").to_pylist(), hashes)
                rows = [(i, *f) for i, fs in enumerate(found) for f in fs]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                     pa.array([r[3] for r in rows], pa.float64())], ["doc_id", "item_id", "start_word", "similarity"])

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, start_word long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents, all columns, that hold no benchmark item."""
    spark, out = docs.sparkSession, docs
    for items in item_blocks(benchmark):
        index = spark.sparkContext.broadcast(BenchmarkIndex(items, radius))

        def clean(texts: list[str | None], index=index) -> list[bool]:
            return [not f for f in index.value.search(texts, WordHashes())]

        out = keep_rows(out, "text", clean)
    return out
