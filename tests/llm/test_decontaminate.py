import random
from collections import Counter

import numpy as np
import pytest

from placekit.llm import decontaminate as dc

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def counter(w):
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(docs, items):
    """Every window of an item's length in every document, by exact similarity."""
    out = set()
    for d, t in docs:
        w = dc.words(t)
        for i, u in items:
            v = dc.words(u)
            if len(v) >= 5 and any(dc.similar(counter(w[p:p + len(v)]), counter(v)) >= 0.8 for p in range(-2, len(w)) if p >= 0):
                out.add((d, i))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([5, 6, 9, 15, 16, 18, 22, 30, 41, 59, 120, 300])]
    docs = []
    for i, w in items:
        for k in range(4):
            docs.append((len(docs), " ".join(text(rng.randrange(0, 90)) + w + text(rng.randrange(0, 90)))))  # whole, anywhere
        if len(w) >= 60:
            near = list(w)
            near[len(w) // 2] = "changed"
            docs.append((len(docs), " ".join(text(30) + near + text(30))))
            docs.append((len(docs), " ".join(text(30) + w[:len(w) // 2] + text(3) + w[len(w) // 2:] + text(30))))
        docs.append((len(docs), " ".join(text(40) + w[:max(1, len(w) // 2)] + text(40))))  # half isn't enough
    docs += [(len(docs) + k, " ".join(text(200))) for k in range(10)]
    return docs, [(i, " ".join(w)) for i, w in items]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_finds_what_brute_force_finds(stored, seed):
    docs, items = corpus(seed)
    got = dc.leaks(stored(docs, DOCS, extra=True), stored(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    text = dict(docs)
    for r in got:
        n = len(dc.words(items[r.item_id][1]))
        window = dc.words(text[r.doc_id])[r.start_word:r.start_word + n]
        assert r.similarity >= 0.8 and abs(dc.similar(counter(window), counter(dc.words(items[r.item_id][1]))) - r.similarity) < 1e-12 or r.start_word == 0


def test_several_blocks_and_long_texts(stored, monkeypatch):
    docs, items = corpus(5)
    docs.append((999, " ".join(f"z{k}" for k in range(300_000)) + " " + items[6][1]))
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(dc, "PIECE", 1 << 12)
    got = {(r.doc_id, r.item_id) for r in dc.leaks(stored(docs, DOCS), stored(items, ITEMS)).collect()}
    assert got == brute(docs[:-1], items) | {(999, 6)}
    kept = {r.doc_id for r in dc.drop_leaks(stored(docs, DOCS, extra=True), stored(items, ITEMS)).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_nulls_case_repeats_and_empty_tables(stored):
    items = [(1, "The quick, brown fox: jumps over the lazy dog!"), (2, None), (3, ""), (4, "four words only here")]
    docs = [(1, "So: THE QUICK BROWN FOX jumps over the lazy dog"), (1, "So: THE QUICK BROWN FOX jumps over the lazy dog"), (2, None), (3, ""), (None, items[0][1]), (5, "four words only here")]
    got = dc.leaks(stored(docs, DOCS, extra=True), stored(items, ITEMS, extra=True)).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.start_word) for r in got) == [(0, 1, 0), (1, 1, 1), (1, 1, 1)]
    docs, none = stored(docs, DOCS, extra=True), stored([], ITEMS)
    assert dc.leaks(docs, none).collect() == [] and dc.leaks(stored([], DOCS), stored(items, ITEMS)).collect() == []
    assert dc.drop_leaks(docs, none).count() == 6 and dc.drop_leaks(docs, stored(items, ITEMS)).columns == docs.columns


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 30).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.permutation(64)[:k]) for k in rng.integers(0, 20, 3000)], np.uint64)
    windows = prints[rng.integers(0, 30, 3000)] ^ flips
    index = dc.SizeIndex(9, 1, prints, np.arange(30), np.zeros(30, int), *dc.block_tables(prints, 11))
    got = set(zip(*(x.tolist() for x in index.near(windows, 11)), strict=True))
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.bitwise_count(windows[:, None] ^ prints) <= 11), strict=True)}
    assert got == want


def edited(rng, n, inserted, deleted):
    """An item of ``n`` words, and a copy of it with words inserted or deleted at even distances."""
    w = [f"w{rng.randrange(5000)}" for _ in range(n)]
    v, k = list(w), inserted + deleted
    for j in range(k, 0, -1):
        at = j * n // (k + 1)
        v[at:at + deleted // k] = [f"new{j}"] * (inserted // k)
    return w, v


@pytest.mark.parametrize("n, inserted, deleted", [(44, 1, 0), (46, 1, 0), (48, 1, 0), (45, 0, 1), (46, 0, 1), (84, 2, 0), (92, 2, 0)])
def test_inserted_and_deleted_words_near_the_threshold(n, inserted, deleted):
    rng = random.Random(n + inserted)
    pairs = [edited(rng, n, inserted, deleted) for _ in range(20)]
    index = dc.BenchmarkIndex([(i, " ".join(w)) for i, (w, _) in enumerate(pairs)])
    hit = 0
    for i, (w, v) in enumerate(pairs):
        before = [f"x{rng.randrange(5000)}" for _ in range(rng.randrange(60))]
        want = dc.similar(counter(v), counter(w))
        assert want >= 0.8 > max(dc.similar(counter((before + v + ["y"] * 9)[p:p + n]), counter(w)) for p in range(len(before) + 5))
        got = index.search([" ".join(before + v + [f"y{k}" for k in range(40)])], dc.WordHashes())[0]
        hit += len(got)
        for item, at, score in got:
            assert (item, at) == (i, len(before)) and abs(score - want) < 1e-12
    assert hit >= 18  # SimHash finds candidates with high probability


def test_best_span_equals_all_spans():
    rng = random.Random(4)
    for _ in range(60):
        item = [rng.randrange(12) for _ in range(rng.randrange(1, 25))]
        r = [rng.randrange(14) for _ in range(5)] + [x for x in item if rng.random() > 0.06] + [rng.randrange(14) for _ in range(5)]
        want = max(dc.similar(Counter(r[a:b]), Counter(item)) for a in range(len(r)) for b in range(a + 1, len(r) + 1))
        got = dc.best_span(np.array(r, np.uint64), np.arange(len(r)), Counter(item))
        assert abs(got[0] - (want if want >= 0.8 else 0)) < 1e-12
