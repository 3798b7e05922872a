import random
from itertools import combinations

import numpy as np
import pytest

from placekit.llm import jaccard

SCHEMA = "doc_id long, text string"


def brute(rows, k=3, percent=90):
    """Set size and component of each (doc_id, text), by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = jaccard.words(t)
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * len(sets[i] | sets[j]):
            parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near(text, rng, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
    return " ".join(w)


def corpus(rng):
    """Chains and stars of near copies of many lengths, unrelated texts, and odd ones."""
    texts = [None, "", " \t\n", "one", "One", "one two", "a b c", "A b\tC", "a b c d"]
    for n in (8, 9, 10, 11, 12, 14, 19, 20, 21, 30, 33, 60, 100, 240, 700):
        base = " ".join(f"w{rng.randrange(300)}" for _ in range(n))
        texts += [base, base.upper(), base + " tail", "head " + base]
        step = base
        for _ in range(4):
            step = near(step, rng, 1)
            texts.append(step)
            texts.append(near(base, rng, max(1, n // 60)))
    texts += [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))) for _ in range(60)]
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(stored, seed):
    rng = random.Random(seed)
    rows = corpus(rng)
    rng.shuffle(rows)
    got = jaccard.near_copies(stored(rows, SCHEMA, extra=True))
    assert got.columns == ["_row", "doc_id", "n_shingles", "component_id"]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("few", [0, 2, 8])
def test_small_leaves_lose_no_link(stored, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    rows = [(i, near(base, rng, rng.randrange(1, 4))) for i in range(60)]
    monkeypatch.setattr(jaccard, "LEAF_POINTS", 7)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_copies(stored(rows, SCHEMA)).collect()) == brute(rows)


def test_repeated_rows_null_ids_and_empty_table(stored):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "x y z"), (2, None), (2, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.near_copies(stored(rows, SCHEMA)).collect())
    assert got == [(False, 2, 0, 2), (False, 2, 0, 2), (False, 5, 3, 5), (False, 5, 3, 5), (True, 0, 1, None), (True, 0, 3, 5)]
    assert jaccard.near_copies(stored([], SCHEMA)).collect() == []


def test_one_of_each_stays_with_its_columns(stored):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (3, "a b c d e"), (None, "x y z"), (2, None), (2, None)]
    docs = stored(rows, SCHEMA, extra=True)
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 2), (False, 2), (False, 3), (True, 0)]


def test_similar_sets_agree_in_a_named_group():
    rng = np.random.default_rng(4)
    for n in (9, 10, 13, 17, 18, 19, 25, 40, 90, 500, 3000):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for _ in range(20):
            drop = int(rng.integers(0, n // 9 + 1))
            add = int(rng.integers(0, n // 9 - drop + 1))
            t = np.unique(np.concatenate([rng.permutation(s)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            if jaccard.linked(len(np.intersect1d(s, t)), len(s), len(t)):
                assert np.intersect1d(jaccard.group_keys(s), jaccard.group_keys(t)).size


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(5)
    points = rng.poisson(3, (400, jaccard.DIMENSIONS))
    points[200:] = np.maximum(points[:200] + rng.integers(-1, 2, (200, jaccard.DIMENSIONS)) * (rng.random((200, jaccard.DIMENSIONS)) < 0.05), 0)
    sizes = points.sum(axis=1)
    tree = jaccard.CountTree(points, sizes)
    for q in range(0, 400, 7):
        bound = jaccard.linked(np.minimum(points, points[q]).sum(axis=1), sizes, sizes[q])
        assert sorted(tree.search(points[q], int(sizes[q]))) == list(np.flatnonzero(bound))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_the_corpus_law_equal_all_pairs(stored, monkeypatch, seed):
    rng = random.Random(seed)
    line = " ".join(f"line{k}" for k in range(9))
    rows = corpus(rng) + [(10_000 + i, f"{line} " + " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 60)))) for i in range(40)]
    monkeypatch.setattr(jaccard, "LEAF_POINTS", 7 if seed == 2 else jaccard.LEAF_POINTS)
    got = jaccard.near_copies(stored(rows, SCHEMA, extra=True), jaccard.CORPUS)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 5, 80)


def test_similar_sets_share_a_first_element():
    rng = np.random.default_rng(6)
    for n in (4, 5, 6, 9, 10, 17, 40, 90, 500):
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        common = (np.sort(rng.permutation(s)[:n // 2]), rng.integers(3, 6, n // 2))
        for _ in range(20):
            drop = int(rng.integers(0, n // 4 + 1))
            add = int(rng.integers(0, n // 4 - drop + 1))
            t = np.unique(np.concatenate([rng.permutation(s)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            if jaccard.linked(len(np.intersect1d(s, t)), len(s), len(t), 80):
                assert np.intersect1d(*(jaccard.first_keys(x, jaccard.CORPUS, common) for x in (s, t))).size


def test_pipeline_stage_drops_a_copy_between_the_laws(spark, stored):
    import corpus_pipeline

    base = [f"w{i}" for i in range(50)]
    copy = [*base[:25], "changed", *base[26:]]
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(reversed(base)))]
    docs = stored(rows, SCHEMA)
    assert jaccard.drop_near_copies(docs).count() == 3
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == [1, 3]


def test_keys_of_the_same_sets_are_one_tree(monkeypatch):
    import pyarrow as pa

    rng = random.Random(8)
    rows = sorted([(k, n) for k in range(40) for n in ([1, 2, 3] if k < 20 else [k] if k < 25 else [5, k])] + [(7, 1), (9, 2)])
    for room in (10**6, 4):
        monkeypatch.setattr(jaccard, "RUN_ROOM", room)
        batches, at = [], 0
        while at < len(rows):
            step = rng.randrange(1, 6)
            part = rows[at:at + step]
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())], ["key", "name"]))
            at += step
        got = {}
        for b in jaccard._trees(iter(batches)):
            for t, n in zip(b.column("tree").to_pylist(), b.column("name").to_pylist()):
                got.setdefault(t, set()).add(n)
        sets = sorted(map(sorted, got.values()))
        assert [1, 2, 3] in sets and all([5, k] in sets for k in range(25, 40)) and all(len(x) > 1 for x in sets)
        if room > 10:
            assert len({tuple(x) for x in sets}) == 16


def test_row_names_are_the_same_however_a_table_is_split(spark, stored):
    from placekit.llm.common import row_id

    docs = stored([(i % 50, f"text {i % 70} " * 30) for i in range(5000)], SCHEMA, extra=True, files=2)
    named = []
    for cores in ("3", "11"):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(10_000 * int(cores)))
        try:
            named.append(sorted((r.name_, r.doc_id, r.text) for r in row_id(docs.select("doc_id", "text"), "name_").collect()))
        finally:
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert named[0] == named[1] and len({n for n, _, _ in named[0]}) == 5000


def test_points_bound_what_sets_share():
    rng = np.random.default_rng(7)
    for n in (5, 60, 400, 1000, 5000, 40_000):
        s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        t = np.unique(np.concatenate([s[: n // 2], rng.integers(0, 2**64, n, dtype=np.uint64)]))
        a, b = (jaccard.read_point(jaccard.points_of([x])[0]) for x in (s, t))
        assert a.sum() == len(s) and b.sum() == len(t) and len(a) == jaccard.dimensions(len(s))
        assert jaccard.most_common(a, b) >= len(np.intersect1d(s, t))


@pytest.mark.parametrize("few_points", [0, 8])
def test_long_texts_meet_by_finer_points(stored, monkeypatch, few_points):
    monkeypatch.setattr(jaccard, "FEW_POINTS", few_points)
    rng = random.Random(11)
    passage = " ".join(f"shared{k}" for k in range(60))
    rows = []
    for i in range(12):
        base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(2500))
        rows += [(10 * i, base + " " + passage), (10 * i + 1, near(base, rng, 40) + " " + passage)]
    got = jaccard.near_copies(stored(rows, SCHEMA), jaccard.CORPUS)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 5, 80)


def test_fine_points_are_stored_once(stored, monkeypatch):
    """Only the sets of a crowd need them again, so no other step carries them along."""
    monkeypatch.setattr(jaccard, "FEW", 2)
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(120))
    rows = [(i, near(base, rng, rng.randrange(1, 4))) for i in range(40)]
    tables, plain = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df: tables.append(df.columns) or plain(df))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_copies(stored(rows, SCHEMA)).collect()) == brute(rows)
    assert sum("fine" in c for c in tables) == 1 and len(tables) > 4
