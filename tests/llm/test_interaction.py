import random
import re
from itertools import permutations

import pytest

from placekit.llm import interaction

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


def corpus(n=500, seed=2):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "délta", "e|f", "g", "h#", "日本"] + [f"w{i}" for i in range(200)]
    base = [" ".join(rng.choice(words[rng.choice([0, 8]):]) for _ in range(rng.choice([5, 99, 100, 130]))) for _ in range(60)]
    preamble = "the same opening of very many texts " * 40
    rows = []
    for i in range(n):
        kind = rng.random()
        text = "hot text" if kind < 0.3 else preamble + rng.choice(base) if kind < 0.6 else rng.choice(base) + rng.choice(["", "", " x", " \n"])
        rows.append((rng.randrange(10 * n), text, rng.choice(["en", "en", "de", None, ""])))
    return rows + [(None, "hot text", "en"), (None, None, "en"), (5, "", "fr"), (4, None, "fr"), (3, " \t", "fr"), (77, "same", "en"), (77, "same", "en"), (78, "same", "en"), (1, "X" * 300_000, "en"), (2, "X" * 300_000, "en"), (0, "X" * 299_999 + "Y", "en")]


def bits(rows):
    smallest = {}
    for d, t, _ in rows:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    out = []
    for d, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)),
                 d is not None and smallest[t] < d]
        out.append((d, lang or "", fails))
    return out


def brute(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    out, sums = {}, {}
    for order in map("".join, permutations("ABCDE")):
        for d, part, fails in bits(rows):
            dead = False
            for step, letter in enumerate(order, 1):
                cell = out.setdefault((part, order, step), [0] * 6)
                fail = fails["ABCDE".index(letter)]
                removed = fail and not dead
                cell[0] += not fail and not dead
                cell[1] += removed
                cell[2] += fail and dead
                cell[3] += fail and sum(fails) == 1
                cell[4] += removed and d in good
                cell[5] += removed and d in toxic
                sums[part, letter] = sums.get((part, letter), 0) + removed
                dead |= fail
    return sorted((*k, *v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items())


@pytest.mark.parametrize("task_bytes", [2_000, 32_000_000])
def test_failures(stored, task_bytes):
    rows = corpus()
    got = interaction.failures(stored(rows, DOCS, extra=True), task_bytes).collect()
    want = sorted((d if d is not None else -1, part, sum(f << i for i, f in enumerate(fails))) for d, part, fails in bits(rows))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.lang, r.fails) for r in got) == want


def test_every_step_of_every_order(stored):
    rows = corpus(150, seed=3)
    rng = random.Random(1)
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d, _, _ in rows if rng.random() < 0.6] + [(None, 1, 1), (77, 1, 0), (77, 0, 1)]
    got = interaction.audit(stored(rows, DOCS, extra=True), stored(labels, LABELS)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, labels)
    assert len(got) == 600 * 4


def test_prefixes_lengthen_where_texts_share_them(stored):
    opening = "an opening that all texts share " * 30
    docs = stored([(i, opening + f"{i:04d}") for i in range(200)] + [(i, "one text") for i in range(200, 400)], "doc_id long, text string")
    heavy = interaction.shared_prefixes(docs, 20_000)
    assert len(heavy) == 3 and all(len(h) == 1 for h in heavy)  # copies of one text are never lengthened
    keys = docs.select(interaction.prefix_key(heavy).alias("k")).distinct().count()
    assert keys == 201


def test_trie_holds_texts_and_smallest_ids():
    rng = random.Random(9)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(400)]
    trie, want = interaction.TextTrie(), {}
    for i, t in enumerate(texts):
        n = rng.choice([None, 1000 - i])
        trie.insert(t, n)
        want[t] = min((x for x in (want.get(t), n) if x is not None), default=None)
    assert list(trie.ends()) == sorted(want.items())


def test_empty_tables(stored):
    assert interaction.audit(stored([], DOCS), stored([], LABELS)).collect() == []
    rows = [(1, "a", "en"), (2, "a", None)]
    assert len(interaction.audit(stored(rows, DOCS), stored([], LABELS)).collect()) == 1200
