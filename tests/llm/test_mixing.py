import random
from collections import defaultdict

import duckdb

from placekit.llm import mixing

SCHEMA = "doc_id long, source string, text string"


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["big"] * 12 + ["a", "b", "ü", None])
        rows.append((i, source, " ".join("w" * rng.randrange(1, 5) for _ in range(int(rng.paretovariate(1.1) * 8)))))
    return rows + [(n, "tiny", "x"), (n + 1, "none", ""), (n + 2, "none", None), (n + 3, None, " \t\n"), (3, "a", "same id"), (3, "a", "same id"), (None, "a", "no id at all")]


def targets(sizes, weights=(5, 2, 1)):
    """Shares by weight; what is above three times a source's size is given to the others again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, open_, full = sum(sizes.values()), set(order), {}
    while open_:
        left = total - sum(full.values())
        share = left / sum(w[s] for s in open_)
        over = {s for s in open_ if share * w[s] > 3 * sizes[s]}
        if not over:
            return full | {s: share * w[s] for s in open_}
        full |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return full


def test_targets_are_met(stored):
    rows = corpus(2000)
    got = mixing.mix_sources(stored(rows, SCHEMA, extra=True)).collect()
    assert len(got) == len(rows)
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
        assert r.taken == r.copies * r.size <= 3 * r.size
    want = targets(dict(sizes))
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.03 * want[s], 5), s


def test_the_sample_is_the_first_in_pareto_order(stored):
    rows = corpus(500, 2)
    got = [r for r in mixing.mix_sources(stored(rows, SCHEMA)).collect() if r.source == "big"]
    longer = [r.copies / 3 for r in got if r.size >= 64]
    shorter = [r.copies / 3 for r in got if 0 < r.size < 16]
    assert sum(longer) / len(longer) > sum(shorter) / len(shorter)


def test_sql_and_small_buckets_agree(stored, monkeypatch):
    rows = corpus()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    cur = con.execute(mixing.oracle())
    names = [c[0] for c in cur.description]
    key = lambda r: tuple(str(round(r[n], 6) if isinstance(r[n], float) else r[n]) for n in sorted(names))
    want = sorted(key(dict(zip(names, r, strict=True))) for r in cur.fetchall())
    docs = stored(rows, SCHEMA)
    assert sorted(key(r) for r in mixing.mix_sources(docs).collect()) == want
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert sorted(key(r) for r in mixing.mix_sources(stored(rows, SCHEMA, files=5)).collect()) == want


def test_documents_are_repeated_and_left_out(stored):
    docs = stored(corpus(), SCHEMA, extra=True)
    want = defaultdict(int)
    for r in mixing.mix_sources(docs).collect():
        want[r.doc_id] += r.copies if r.size else 0
    mix = mixing.repeat_documents(docs)
    assert mix.columns == docs.columns
    got = defaultdict(int)
    for r in mix.collect():
        got[r.doc_id] += 1
    assert dict(got) == {k: v for k, v in want.items() if v}


def test_empty_tables(stored):
    assert mixing.mix_sources(stored([], SCHEMA)).collect() == []
    got = mixing.mix_sources(stored([(1, "a", None), (2, None, "")], SCHEMA)).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2
