import random
import re
from collections import defaultdict

import pytest

from placekit.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = ["The", "the", "É", "é", "a1b", "x-y", "日本", "K", "ZED"] + [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([9, 30, 69])]) for _ in range(rng.randrange(30))), rng.choice(["en"] * 4 + ["de", None]),
             rng.choice(["big"] * 6 + [f"s{k}" for k in range(7)] + [None, "é", "Z"])) for i in range(n)]
    return rows + [(n, None, "en", "only null"), (n, "", "xx", "p"), (n + 1, "1 2 3", "xx", "q"), (None, "rare", "xx", None), (5, "word " * 100_000, "en", "long"), (5, "word " * 100_000, "en", "long")]


def brute(rows, min_docs, top):
    docs, counts, groups = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int)), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        for t in terms:
            counts[lang, source][t] += 1
        for t in set(terms):
            docs[lang][t] += 1
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(count):
            total = sum(count(t) for t in kept)
            return {t: 1 + 10**9 * (count(t) + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(lambda t, s=s: counts[lang, s].get(t, 0)) for s in sources}
        q = shares(lambda t: sum(counts[lang, s].get(t, 0) for s in sources))
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s].get(t, 0) and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(items[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("group_block,term_block", [(64, 4096), (2, 5)])
def test_equals_brute_force(stored, group_block, term_block):
    rows = corpus()
    got = divergence.audit(stored(rows, SCHEMA, extra=True), group_block=group_block, term_block=term_block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, divergence.MIN_DOCS, divergence.TOP_TERMS)


def test_ties_and_other_bounds(stored):
    rows = [(i, f"{a} {b}", "en", f"s{i % 4}") for i, (a, b) in enumerate([("x", "y"), ("u", "v"), ("x", "v"), ("é", "y")] * 3)]
    got = divergence.audit(stored(rows, SCHEMA), min_docs=2, top=2).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 2, 2)


def test_counts_past_a_long(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(divergence._share(F.lit(9 * 10**15), F.lit(10**16), F.lit(3)).alias("p")).first().p
    assert got == 1 + 10**9 * (9 * 10**15 + 2) // (10**16 + 6)


def test_counting_tasks_send_on_when_full(stored, monkeypatch):
    monkeypatch.setattr(divergence, "TABLE_ROOM", 20)
    rows = corpus(100, seed=4)
    assert sorted(tuple(r) for r in divergence.audit(stored(rows, SCHEMA)).collect()) == brute(rows, divergence.MIN_DOCS, divergence.TOP_TERMS)


def test_no_kept_terms_and_empty_table(stored):
    got = divergence.audit(stored([(1, "a", "en", "p"), (2, "b", "en", "q"), (3, "c", "en", None)], SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == [("en", "", "pair", "p", 0, 1), ("en", "", "pair", "q", 0, 2), ("en", "p", "pair", "", 0, 1),
                                             ("en", "p", "pair", "q", 0, 2), ("en", "q", "pair", "", 0, 1), ("en", "q", "pair", "p", 0, 2)]
    assert divergence.audit(stored([], SCHEMA)).collect() == []
