"""N-gram Jaccard join with count vectors in R-trees.

Each document is its set of distinct word n-grams. N-grams are hashed into groups; how many fall into each group is
the document's point. Two sets share at most the summed minima of their coordinates, so a tree of such points, with
the largest and smallest coordinates of each node, finds the pairs that can still be similar enough; the sets
themselves decide.

A ``Law`` has the words of a shingle and the least similarity. Which points meet in one tree is settled exactly. Sets
with Jaccard similarity of at least ``t`` differ in at most ``smaller * (1 - t) / t`` elements; when the groups are more
than that, some group must hold the same elements in both. So sets meet that agree in a whole group (by a hash of its
elements). Below nine tenths such groups would hold so few elements that unrelated sets agree in them; there sets meet
that share one of their ``n - ceil(t * n) + 1`` first elements in one order of all shingles, which no similar pair can
avoid either. The order puts shingles that are common in a sample last; it decides the work, never the result.

The forest has a tree per such key; keys under which the same sets meet are one tree. A tree too large for one task is
packed into leaves by size, and every two leaves whose sizes can be similar are one task. Only points travel there. A
point names all its candidates if they are few; else some, and the others only where the links found so far leave them
apart. Texts are fetched for the pairs that survive, and their sets decide. So no pair is lost, and none is emitted in
a crowd but what connects it.

Equal sets are one point, so copies never meet in pairs. Shingles and sets are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placekit.llm.common import WordHashes, concat_words, cut, fresh, may_be_in, mix, row_id, slices
from placekit.operators.graph import components
from placekit.plans.session import is_empty

DIMENSIONS = 64        # coordinates of a tree, and the fewest of a set
MOST_DIMENSIONS = 8192
PER_DIMENSION = 6      # elements a coordinate, about: with more, unrelated sets look alike
FINE_PER_DIMENSION = 2  # where sets of one crowd must be told apart
FEW_POINTS = 8         # sets that are compared without a tree
LEAF_POINTS = 512
FEW = 8            # candidates a point names at first
HUB_PAIRS = 500    # pairs of one set that a task decides
RUN_ROOM = 2_000_000  # names of one key held to tell whether other keys have the same
NAMES_ROOM = 1_000_000
NODE = 16
GROUPS_FROM = 90
SAMPLE, COMMON = 4096, 100_000
_U = np.uint64


class Law(NamedTuple):
    """When two documents are near copies: words of a shingle, and the least similarity of their sets in percent."""

    shingle: int = 3
    percent: int = 90

    @property
    def least(self) -> int:
        """The first size that can differ from another."""
        return -(-self.percent // (100 - self.percent))


JOIN, CORPUS = Law(), Law(5, 80)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def linked(common, a, b, percent: int = JOIN.percent):
    """100 * intersection >= percent * union."""
    return (100 + percent) * common >= percent * (a + b)


def shingle_sets(texts: list[str | None], hashes: WordHashes, shingle: int = JOIN.shingle) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle make one, no words none."""
    flat, starts = concat_words([words(t) for t in texts], hashes)
    if len(flat) >= shingle:
        n = len(flat) - shingle + 1
        whole = flat[:n] * _U(0x9E3779B97F4A7C15)
        for i in range(1, shingle):
            whole += mix(flat[i:i + n] + _U(17 * (i - 1))) * _U(2 * i + 1)
        whole = mix(whole)
    else:
        whole = np.zeros(0, _U)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= shingle:
            out.append(np.unique(whole[a:b - shingle + 1]))
        elif b > a:
            few = mix(flat[a:b]) * np.arange(1, b - a + 1, dtype=_U)
            out.append(mix(np.array([few.sum() + _U(b - a)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def digest(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int((mix(s + _U(99)).sum() + _U(len(s))).astype(np.int64)) if len(s) else 0


def bands(top: int, law: Law = JOIN) -> list[int]:
    """Sizes at which bands begin, past ``top``."""
    out = [law.least]
    while out[-1] <= top:
        out.append(max(out[-1] + 2, out[-1] * 7 // 5))
    return out


def band_groups(begin: int, end: int, law: Law = JOIN) -> tuple[int, int]:
    """For a band of sizes of the smaller set: the elements in which a pair may differ, and the groups."""
    differ = (end - 1) * (100 - law.percent) // law.percent
    return differ, differ + 4 + -(-3 * differ // 20)


def group_keys(s: np.ndarray, law: Law = JOIN) -> np.ndarray:
    """Names of what the groups of a set hold, in each band in which it can be one of a pair.

    Groups of one element or none are left out when so many others remain that a similar set must agree
    in one of them; both sets of a pair then name it.
    """
    n, out = len(s), []
    edges = bands(n, law)
    spread = mix(s ^ _U(0xA5A5A5A5A5A5A5A5))
    for i in range(len(edges) - 1):
        begin, end = edges[i], edges[i + 1]
        if n < begin or law.percent * n > 100 * (end - 1):  # too small, or too large for any smaller partner here
            continue
        differ, groups = band_groups(begin, end, law)
        at = ((spread >> _U(32)) * _U(groups) >> _U(32)).astype(np.int64)
        count = np.bincount(at, minlength=groups)
        total = np.zeros(groups, _U)
        np.add.at(total, at, spread)
        strong = count > 1
        if groups - int(strong.sum()) >= groups - differ:
            strong = np.ones(groups, bool)
        names = mix(total + mix((np.arange(groups, dtype=_U) << _U(20)) + _U(i))) ^ count.astype(_U)
        out.append(names[strong])
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def first_keys(s: np.ndarray, law: Law, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first elements of a set, as many as hold one that any similar set has among its first.

    ``common`` has the shingles that come late, sorted, and how often each was seen.
    """
    n = len(s)
    if n < law.least:
        return np.zeros(0, np.int64)
    seen = np.zeros(n, np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
        seen = np.where(common[0][at] == s, common[1][at], 0)
    return s[np.lexsort((mix(s), seen))[:n + (-law.percent * n // 100) + 1]].astype(np.int64)


def common_shingles(docs: DataFrame, law: Law) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a bounded sample hold, sorted, and how many do; ``COMMON`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), hashes, law.shingle)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).astype(np.int64))], ["shingle"])

    every = max(1, docs.count() // SAMPLE)
    sample = row_id(docs.select("text")).where(F.pmod(F.xxhash64("_row"), F.lit(every)) == 0).select("text")
    counted = sample.mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(COMMON).toPandas()
    held = counted["shingle"].to_numpy(np.int64).astype(_U)
    order = np.argsort(held)
    return held[order], counted["count"].to_numpy(np.int64)[order]


def dimensions(n: int, per: int = PER_DIMENSION) -> int:
    """Coordinates of a set of ``n`` elements: a power of two, so that neighbours added up are those of a smaller set."""
    d = DIMENSIONS
    while d < MOST_DIMENSIONS and d * per < n:
        d *= 2
    return d


def points_of(sets: list[np.ndarray], per: int = PER_DIMENSION) -> list[bytes]:
    """Count vectors, with as few bytes a coordinate as hold all of one; that many bytes are told by the first."""
    out = []
    for s in sets:
        d = dimensions(len(s), per)
        counts = np.bincount((s >> _U(65 - d.bit_length())).astype(np.int64), minlength=d)
        wide = 1 if counts.max() < 256 else 2 if counts.max() < 65536 else 4
        out.append(bytes([wide]) + counts.astype(f"<u{wide}").tobytes())
    return out


def read_point(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int32)


def fold(point: np.ndarray, d: int) -> np.ndarray:
    """A point with ``d`` coordinates."""
    return point.reshape(d, -1).sum(axis=1) if len(point) > d else point


def most_common(a: np.ndarray, b: np.ndarray) -> int:
    """The most elements two sets can share, by their points."""
    d = min(len(a), len(b))
    return int(np.minimum(fold(a, d), fold(b, d)).sum())


def _describe(batches: Iterator[pa.RecordBatch], law: Law, common) -> Iterator[pa.RecordBatch]:
    hashes, told = WordHashes(), set()
    none = np.zeros(0, np.int64)
    for batch in slices(batches, "text"):
        sets = shingle_sets(batch.column("text").to_pylist(), hashes, law.shingle)
        names, keys = [digest(s) for s in sets], []
        for s, name in zip(sets, names, strict=True):
            # of sets that repeat in a task one brings the keys
            keys.append(none if name in told else group_keys(s, law) if common is None else first_keys(s, law, common.value))
            told.add(name)
        if len(told) > NAMES_ROOM:
            told.clear()
        offsets = np.zeros(len(keys) + 1, np.int32)
        np.cumsum([len(k) for k in keys], out=offsets[1:])
        yield pa.RecordBatch.from_arrays(
            [batch.column("_row"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), pa.array(points_of(sets), pa.binary()), pa.array(points_of(sets, FINE_PER_DIMENSION), pa.binary()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else none))],
            ["_row", "doc_id", "n_shingles", "name", "points", "fine", "keys"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, name) sorted by key: the sets of each key that has several, under a name that keys of the same sets share."""

    def trees(keys: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((names, keys))
        keys, names = keys[order], names[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])
        keys, names = keys[first], names[first]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(keys)))
        if not (counts > 1).any():
            return
        tree = mix(np.add.reduceat(mix(names.astype(_U) + _U(7)), starts) + counts.astype(_U)).astype(np.int64)
        _, kept = np.unique(np.where(counts > 1, tree, 0), return_index=True)
        kept = kept[counts[kept] > 1]
        take = np.zeros(len(starts), bool)
        take[kept] = True
        rows = np.repeat(take, counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(tree, counts)[rows]), pa.array(names[rows])], ["tree", "name"])

    keys, names, long_key = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        names = np.concatenate([names, batch.column("name").to_numpy()])
        if not len(keys):
            continue
        if long_key is not None:
            # a key of very many sets keeps its own name
            end = int(np.searchsorted(keys, long_key, "right")) if keys[0] == long_key else 0
            yield pa.RecordBatch.from_arrays([pa.array(keys[:end]), pa.array(names[:end])], ["tree", "name"])
            keys, names = keys[end:], names[end:]
            if not len(keys):
                continue
            long_key = None
        last = int(np.searchsorted(keys, keys[-1]))
        yield from trees(keys[:last], names[:last])
        keys, names = keys[last:], names[last:]
        if len(keys) > RUN_ROOM:
            long_key = keys[0]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(names)], ["tree", "name"])
            keys, names = keys[:0], names[:0]
    if long_key is None:
        yield from trees(keys, names)


class CountTree:
    """A packed R-tree over count vectors, searched by the summed minima of coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int = JOIN.percent):
        self.percent = percent
        # sort-tile packing: slabs by size, inside a slab by the coordinate that varies most
        order = np.argsort(sizes, kind="stable")
        slab = NODE * NODE
        wide = int(np.argmax(points.var(axis=0))) if len(points) else 0
        self.order = np.concatenate([order[i:i + slab][np.argsort(points[order[i:i + slab], wide], kind="stable")] for i in range(0, len(order), slab)]) if len(order) else order
        self.points, self.sizes = points[self.order], sizes[self.order]
        starts = np.arange(0, len(points), NODE)
        # level 0 holds nodes of points, each next level nodes of nodes: largest coordinates, smallest and largest size
        self.levels = []
        hi, lo_n, hi_n = self.points, self.sizes, self.sizes
        while len(starts):
            hi, lo_n, hi_n = np.maximum.reduceat(hi, starts, axis=0), np.minimum.reduceat(lo_n, starts), np.maximum.reduceat(hi_n, starts)
            self.levels.append((hi, lo_n, hi_n))
            if len(hi) == 1:
                break
            starts = np.arange(0, len(hi), NODE)

    def _open(self, q, n, hi, lo_n, hi_n):
        fits = (100 * hi_n >= self.percent * n) & (self.percent * lo_n <= 100 * n)
        return fits & linked(np.minimum(hi, q).sum(axis=1), n, np.maximum(lo_n, -(-self.percent * n // 100)), self.percent)

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        """Positions of all points that can be linked with one of ``n`` elements."""
        if not self.levels:
            return np.zeros(0, np.int64)
        nodes = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            hi, lo_n, hi_n = (x[nodes] for x in self.levels[level])
            nodes = nodes[self._open(q, n, hi, lo_n, hi_n)]
            below = len(self.levels[level - 1][0]) if level else len(self.points)
            nodes = (nodes[:, None] * NODE + np.arange(NODE)).ravel()
            nodes = nodes[nodes < below]
        ok = self._open(q, n, self.points[nodes], self.sizes[nodes], self.sizes[nodes])
        return self.order[nodes[ok]]


class Shared:
    """The most elements a set can share with others, by their points, many at a time."""

    def __init__(self, points: list[np.ndarray]):
        self.points, self.length, self.levels = points, np.array([len(p) for p in points], np.int64), {}

    def _level(self, d: int) -> np.ndarray:
        """All points that have ``d`` coordinates or more, with ``d``."""
        if d not in self.levels:
            self.levels[d] = np.array([fold(p, d) if len(p) >= d else np.zeros(d, np.int32) for p in self.points], np.int32)
        return self.levels[d]

    def most(self, i: int, others: np.ndarray) -> np.ndarray:
        out, d = np.zeros(len(others), np.int64), np.minimum(self.length[others], self.length[i])
        for k in np.unique(d):
            at = d == k
            out[at] = np.minimum(self._level(int(k))[others[at]], fold(self.points[i], int(k))).sum(axis=1)
        return out


def candidates(points: list[np.ndarray], sizes: np.ndarray, names: np.ndarray, left: np.ndarray, right: np.ndarray, apart: np.ndarray | None, percent: int) -> tuple[list, list]:
    """Pairs of ``left`` and ``right`` that their points allow, and the sets of ``left`` that have more.

    Without ``apart`` a set names its ``FEW`` candidates of smallest name and the one it may share most with. With it, the
    labels of what links connect already, all candidates that are labelled otherwise.
    """
    held = Shared(points)
    coarse = held._level(DIMENSIONS)
    tree, pairs, more = CountTree(coarse[right], sizes[right], percent), [], []
    for i in left:
        near = right[tree.search(coarse[i], int(sizes[i]))]
        near = near[near != i] if apart is None else near[apart[near] != apart[i]]
        if not len(near):
            continue
        shared = held.most(i, near)
        fits = linked(shared, int(sizes[i]), sizes[near], percent)
        near, shared = near[fits], shared[fits]
        if apart is None and len(near) > FEW + 1:
            more.append(int(names[i]))
            near = np.append(near[np.argsort(names[near])[:FEW]], near[np.argmax(2 * shared - sizes[near])])
        pairs += [(int(min(names[i], n)), int(max(names[i], n))) for n in names[near]]
    return pairs, more


def few_candidates(points: list[np.ndarray], sizes: np.ndarray, names: np.ndarray, apart: np.ndarray | None, percent: int) -> list:
    """All pairs of a handful of sets that their points allow."""
    out = []
    for i in range(len(points)):
        for j in range(i):
            small, large = sorted((int(sizes[i]), int(sizes[j])))
            if 100 * small >= percent * large and (apart is None or apart[i] != apart[j]) and linked(most_common(points[i], points[j]), small, large, percent):
                out.append((int(min(names[i], names[j])), int(max(names[i], names[j]))))
    return out


def _candidates(batches: Iterator[pa.RecordBatch], percent: int, across: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tree, leaf_a, leaf_b): candidates of each task's pairs of leaves; a row without b names a set that has more."""

    def solve(key, parts: list[tuple]) -> tuple[list, list]:
        names, leaf, sizes, label, raw = (np.concatenate([p[k] for p in parts]) if k < 4 else [x for p in parts for x in p[4]] for k in range(5))
        if len(names) < 2:
            return [], []
        points = [read_point(r) for r in raw]
        apart = label if across else None
        if key[1] == key[2] and len(names) <= FEW_POINTS:
            return few_candidates(points, sizes, names, apart, percent), []
        left, right = np.flatnonzero(leaf == key[1]), np.flatnonzero(leaf == key[2])
        pairs, more = candidates(points, sizes, names, left, right, apart, percent)
        if key[1] != key[2]:
            others = candidates(points, sizes, names, right, left, apart, percent)
            pairs, more = pairs + others[0], more + others[1]
        return sorted(set(pairs)), more

    def rows(found: list[tuple]) -> pa.RecordBatch:
        tree = [key[0] for key, pairs, more in found for _ in range(len(pairs) + len(more))]
        a = [x for _, pairs, more in found for x in (*(p[0] for p in pairs), *more)]
        b = [x for _, pairs, more in found for x in (*(p[1] for p in pairs), *(None for _ in more))]
        return pa.RecordBatch.from_arrays([pa.array(tree, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["tree", "a", "b"])

    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, one, two, names, leaf, sizes = (batch.column(c).to_numpy() for c in ("tree", "leaf_a", "leaf_b", "name", "leaf", "n"))
        label = batch.column("label").to_numpy() if across else names
        raw, found = batch.column("points").to_pylist(), []
        starts = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            here = (int(tree[start]), int(one[start]), int(two[start]))
            if here != key:
                if parts:
                    found.append((key, *solve(key, parts)))
                key, parts = here, []
            parts.append((names[start:end], leaf[start:end], sizes[start:end], label[start:end], raw[start:end]))
        yield rows(found)
    if parts:
        yield rows([(key, *solve(key, parts))])


def _decided(batches: Iterator[pa.RecordBatch], law: Law) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, salt, role), the hub's own text first: the members whose sets are similar enough."""
    hashes, key, own = WordHashes(), None, None
    for batch in slices(batches, "text"):
        sets = shingle_sets(batch.column("text").to_pylist(), hashes, law.shingle)
        a, b = [], []
        for hub, salt, role, member, s in zip(*(batch.column(c).to_pylist() for c in ("hub", "salt", "role", "member")), sets, strict=True):
            if role == 0:
                key, own = (hub, salt), s
            elif (hub, salt) == key and linked(len(np.intersect1d(own, s, assume_unique=True)), len(own), len(s), law.percent):
                a.append(hub)
                b.append(member)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def describe(docs: DataFrame, law: Law = JOIN) -> DataFrame:
    """Stored table with one row per document: ``_row, doc_id, n_shingles, name`` of its set, ``points`` and ``fine`` ones, ``keys`` that similar sets share."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    common = None if law.percent >= GROUPS_FROM else docs.sparkSession.sparkContext.broadcast(common_shingles(docs, law))
    return cut(row_id(docs.select("doc_id", "text")).mapInArrow(
        lambda batches: _describe(batches, law, common), f"_row string, doc_id {kind}, n_shingles long, name long, points binary, fine binary, keys array<long>"))


def decide(docs: DataFrame, stand: DataFrame, pairs: DataFrame, law: Law) -> DataFrame:
    """The pairs ``(a, b)`` of set names whose sets are similar enough; a set with many pairs is split over tasks."""
    split = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).alias("parts"))
    rows = pairs.join(split, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    sides = rows.select(F.col("a").alias("hub"), "salt", F.lit(0).alias("role"), F.col("a").alias("member")).distinct().unionByName(
        rows.select(F.col("a").alias("hub"), "salt", F.lit(1).alias("role"), F.col("b").alias("member")))
    sides = cut(sides.join(stand.select(F.col("name").alias("member"), "_row"), "member"))
    texts = may_be_in(row_id(docs.select("text")), sides, "_row").join(sides, "_row").select("hub", "salt", "role", "member", "text")
    met = texts.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return cut(met.mapInArrow(lambda batches: _decided(batches, law), "a long, b long"))


def leaf_pairs(forest: DataFrame, law: Law) -> DataFrame:
    """Rows of ``forest`` (tree, name, n, ...) once per pair of leaves that they are looked at in: leaf, leaf_a, leaf_b."""
    banded = forest.withColumn("size_band", F.floor(F.log("n") / F.log(F.lit(1.05))))
    packs = banded.groupBy("tree", "size_band").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    whole = packs.groupBy("tree").agg(F.sum("m").alias("all_m"))
    big = cut(packs.join(whole.where(F.col("all_m") > LEAF_POINTS), "tree").withColumn("leaves", F.ceil(F.col("m") / LEAF_POINTS)))
    # leaf 0 is a whole small tree; others are (size band, number) as one number
    leaf = F.when(F.col("leaves").isNull(), F.lit(0)).otherwise((F.col("size_band") + 1) * (1 << 32) + F.pmod(F.xxhash64("name"), F.greatest("leaves", F.lit(1)))).cast("long")
    placed = banded.join(big.select("tree", "size_band", "leaves"), ["tree", "size_band"], "left").withColumn("leaf", leaf).drop("size_band")
    ranges = big.select("tree", "lo", "hi", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("leaves") - 1), lambda i: (F.col("size_band") + 1) * (1 << 32) + i)).alias("leaf"))
    x, y = ranges.alias("x"), ranges.alias("y")
    pairs = x.join(y, (F.col("x.tree") == F.col("y.tree")) & (F.col("x.leaf") <= F.col("y.leaf")) & (law.percent * F.col("y.lo") <= 100 * F.col("x.hi")) & (law.percent * F.col("x.lo") <= 100 * F.col("y.hi"))).select(
        F.col("x.tree").alias("tree"), F.col("x.leaf").alias("leaf_a"), F.col("y.leaf").alias("leaf_b"))
    # a leaf goes to each pair it is in, as one of them or both
    sides = pairs.select("*", F.explode(F.array_distinct(F.array("leaf_a", "leaf_b"))).alias("leaf"))
    small = placed.where(F.col("leaves").isNull()).withColumns({"leaf_a": F.col("leaf"), "leaf_b": F.col("leaf")})
    return small.drop("leaves").unionByName(placed.where(F.col("leaves").isNotNull()).drop("leaves").join(sides, ["tree", "leaf"]))


def find_links(docs: DataFrame, described: DataFrame, law: Law = JOIN) -> DataFrame:
    """Links ``(a, b)`` between names of different sets that connect every component of linked sets."""
    keyed = described.where(F.size("keys") > 0).select("name", F.explode("keys").alias("key"))
    forest = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_trees, "tree long, name long").distinct())
    # one row stands for each set
    rows = described.select("name", "_row", F.col("n_shingles").alias("n"), "points").join(forest.select("name").distinct(), "name", "left_semi")
    stand = cut(rows.groupBy("name").agg(F.min(F.struct("_row", "n", "points")).alias("s")).select("name", "s.*"))
    placed = forest.join(stand.select("name", "n", "points"), "name")

    def proposed(trees: DataFrame, across: bool) -> DataFrame:
        work = leaf_pairs(trees, law).repartition("tree", "leaf_a", "leaf_b").sortWithinPartitions("tree", "leaf_a", "leaf_b")
        return cut(work.mapInArrow(lambda batches: _candidates(batches, law.percent, across), "tree long, a long, b long"))

    named = proposed(placed, False)
    pairs = cut(named.where(F.col("b").isNotNull()).select("a", "b").distinct())
    links = decide(docs, stand, pairs, law)
    more = named.where(F.col("b").isNull()).select("tree", F.col("a").alias("name")).distinct()
    if is_empty(more):
        return links
    # a pair of sets of which one named all its candidates is settled; the others are told apart by finer points
    finer = cut(stand.select("name", "_row", "n").join(more.select("name").distinct(), "name", "left_semi"))
    crowd = more.join(may_be_in(described.select("_row", F.col("fine").alias("points")), finer, "_row").join(finer, "_row").drop("_row"), "name")
    label = components(links).select(F.col("node").alias("name"), "label")
    open_ = crowd.join(label, "name", "left").withColumn("label", F.coalesce("label", "name"))
    rest = proposed(open_, True).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    return links.unionByName(decide(docs, stand, cut(rest), law))


def near_copies(docs: DataFrame, law: Law = JOIN) -> DataFrame:
    """``_row, doc_id, n_shingles, component_id`` of each document of a stored table; ``law`` says which are linked.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A null text, an empty one or one of white
    space has no shingle and is its own component. Equal texts, and rows that repeat, are one component. A null
    doc_id is never a component's name unless nothing else is in it. An empty table gives an empty result.
    """
    described = describe(docs, law)
    roots = cut(components(find_links(docs, described, law))).select(F.col("node").alias("name"), F.col("label").alias("root"))
    rows = described.select("_row", "doc_id", "n_shingles", "name").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    least = rows.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select(
        "_row", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, law: Law = JOIN) -> DataFrame:
    """One document of each component stays, with all columns: the one with the smallest doc_id, then the first row."""
    found = near_copies(docs, law)
    # a null id is after all others; documents without a shingle are alone
    lone = found.where("n_shingles = 0").select("_row")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    first = found.where("n_shingles > 0").groupBy("component_id").agg(best.alias("best")).select("best._row")
    row = fresh(docs, "_row")
    return row_id(docs, row).join(lone.unionByName(first).withColumnRenamed("_row", row), row, "left_semi").select(*docs.columns)
