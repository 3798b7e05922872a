import random

import numpy as np

from placekit.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string"
WORDS = {"aa": "kalo mita sorun pelka taru", "bb": "xyz qwrt vvcx zzpq wrx", "cc": "ääö öüß ßäu üöä äuö"}


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(3, 200))), lang, "s"))
    return out


def test_held_out_texts_are_told_apart(stored):
    data = rows(300)
    docs = stored(data, SCHEMA, extra=True)
    net = langid.train(docs)
    assert net.classes == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    truth = {i: lang for i, _, lang, _ in data}
    out = [i for i in truth if langid.crc_mod4(i) == 2]
    assert all(got[i].held_out == (langid.crc_mod4(i) == 2) for i in truth)
    assert np.mean([got[i].lang_pred == truth[i] for i in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_learned(stored):
    data = [(i, t, "zz" if langid.crc_mod4(i) == 2 else lang, s) for i, t, lang, s in rows(60)]
    assert "zz" not in langid.train(stored(data, SCHEMA)).classes


def test_odd_texts(stored):
    data = rows(60)
    net = langid.train(stored(data, SCHEMA))
    odd = [(1, None, None, None), (2, "", "aa", None), (3, "12 34 !?", "aa", "s"), (4, "kalo", None, "s"), (4, "kalo", None, "s"), (None, "kalo mita", "aa", "s"), (5, "kalo mita " * 200_000, "aa", "s")]
    got = langid.identify(stored(odd, SCHEMA, extra=True), net).collect()
    assert len(got) == len(odd)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {1, 2, 3} and all(r.score == 0 for r in got if r.doc_id in und)
    kept = langid.keep_known(stored(odd, SCHEMA, extra=True), net)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 4, 4, 5]


def test_nothing_to_learn_and_one_language(stored):
    none = stored([], SCHEMA)
    net = langid.train(none)
    assert net.classes == [] and langid.identify(none, net).collect() == []
    one = stored([(0, "kalo mita", "aa", "s")], SCHEMA)
    r = langid.identify(one, langid.train(one)).collect()[0]
    assert (r.lang_pred, r.score) == ("aa", 1.0)
    assert [r.lang_pred for r in langid.identify(one, net).collect()] == ["und"]


def test_gradients():
    net = langid.Network(["a", "b"], langid.Settings(window=12, depth=3, filters=2, seed=3))
    for p in net.params():
        p += np.random.default_rng(0).normal(0, 0.3, p.shape).astype(np.float32)
    net.embed[0] = 0
    x, y = np.random.default_rng(1).integers(1, 9, (4, 12)).astype(np.uint8), np.array([0, 1, 1, 0])
    grads = net.step(x, y)

    def loss():
        return -net.log_probs(x)[np.arange(4), y].mean()

    for p, g in zip(net.params(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, e = p[at], 1e-2
        p[at] = keep + e
        up = loss()
        p[at] = keep - e
        down = loss()
        p[at] = keep
        assert abs((up - down) / (2 * e) - g[at]) < 0.02 + 0.05 * abs(g[at])


def test_windows_hold_the_whole_text():
    for n in (1, 255, 256, 257, 5000):
        raw = bytes((i % 250) + 1 for i in range(n))
        assert langid.windows_of(raw, 256).tobytes().rstrip(b"\0") == raw


def test_signs_that_are_no_letters():
    assert not any(langid.has_letter(t) for t in (None, "", "12 %", "½ Ⅷ ²", "_-_", "\u0301"))
    assert all(langid.has_letter(t) for t in ("a", "1 é", "ª", "日"))
