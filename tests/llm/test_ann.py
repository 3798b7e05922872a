import numpy as np
import pytest

from placekit.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q, i in enumerate(ids):
        if i % 50 == 0:
            s = x @ x[q]
            s[q] = -9
            out[int(i)] = [int(ids[j]) for j in np.lexsort((ids, -s))[:min(k, len(ids) - 1)]]
    return out


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_recall_and_form(stored, dim):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(20, dim))
    rows = [(i, (centres[i % 20] + 0.7 * rng.normal(size=dim)).astype(np.float32).tolist(), 0) for i in range(2000)]
    got = ann.search(stored(rows, SCHEMA, extra=True)).collect()
    want, found = brute(rows, 5), {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
        a, b = (np.array(rows[i][1], np.float32).astype(float) for i in (r.query_id, r.vec_id))
        assert abs(r.score - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12
    assert set(found) == set(want) and all(len(v) == 5 for v in found.values())
    assert sum(len(set(found[q]) & set(want[q])) for q in want) / (5 * len(want)) >= 0.9


def test_odd_vectors_ties_and_few_candidates(stored):
    rows = [(0, [1.0, 0.0], 0), (50, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (4, None, 0), (5, [0.0, 0.0], 0), (6, [float("nan"), 1.0], 0), (7, [float("inf"), 1.0], 0),
            (8, [None, 1.0], 0), (None, [1.0, 1.0], 0), (100, None, 0), (9, [1.0], 0), (3, [1.0, 0.0], 0)]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(stored(rows, SCHEMA)).collect())
    assert got == [(0, 1, 2), (0, 2, 3), (0, 3, 50), (50, 1, 0), (50, 2, 2), (50, 3, 3)]
    assert ann.search(stored([], SCHEMA)).collect() == []
    assert ann.search(stored([(50, [1.0, 2.0], 0)], SCHEMA)).collect() == []


@pytest.mark.parametrize("radius", [0, 3, 7, 8, 15, 22, 40])
def test_probing_retrieves_every_code_in_the_radius(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.permutation(64)[:k]) for k in rng.integers(0, 45, 2000)], np.uint64)
    codes = base[rng.integers(0, 40, 2000)] ^ flips
    tables = ann.SubstringTables(codes)
    for q in base:
        assert sorted(tables.within(q, radius)) == list(np.flatnonzero(np.bitwise_count(codes ^ q) <= radius))


@pytest.mark.parametrize("block", [4096, 4])
def test_tight_clusters_and_far_outliers_keep_every_query(stored, monkeypatch, block):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 64))
    rows = [(i, (centres[i % 20] + 0.01 * rng.normal(size=64)).astype(np.float32).tolist(), 0) for i in range(2000)]
    rows += [(i, rng.normal(size=64).astype(np.float32).tolist(), 0) for i in (2000, 2200, 2400)]
    monkeypatch.setattr(ann, "QUERY_BLOCK", block)
    found = {}
    for r in ann.search(stored(rows, SCHEMA), every=200).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(range(0, 2401, 200)) and all(len(set(v)) == 5 == len(v) for v in found.values())
    want = brute(rows, 5)
    assert all(set(found[q]) == set(want[q]) for q in found if q < 2000)
