import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from placekit.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(PATH)


def texts(n=3000):
    rng = random.Random(5)
    parts = [" ", "  ", "    ", "\n", "▁", "the", "ing", "é", "日", "\t", "<s>", "</s>", "<0x0A>", ".", "ab", "Z", "🙂", "́", "ations", "00", "==", "\x00", "ﬀ", "힣", "�"]
    odd = [None, "", " ", "▁", "a" * 5000, "=" * 333, "🙂" * 200, "ab日" * 4000, *[" " * k for k in range(1, 70)], *["\n" * k for k in range(1, 5)]]
    return (odd + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]
            + ["".join(rng.choice("adeinrst") for _ in range(rng.randrange(50))) for _ in range(n)])


def test_ids_and_texts_are_the_librarys(model, own):
    table = pieces.TokenIds(own)
    for t in texts():
        got = pieces._unpacked(pieces._packed(table, t, True, True))
        want = model.encode(t or "", add_bos=True, add_eos=True)
        assert got == want
        assert own.decode(got) == model.decode(want)


def test_table_holds_the_last_piece_of_every_prefix(model, own):
    for word in ["▁internationalisation", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁word", "aaaaaaaaaaaaaaaaaaaaaaa"]:
        last = own.table(word)
        assert [own.texts[p] for p in last[1:]] == [own.merge(word[:n])[-1] for n in range(1, len(word) + 1)]


def test_compatible_is_what_merging_the_two_alone_says(own):
    rng = random.Random(3)
    ids = sorted(own.left)
    for _ in range(20_000):
        a, b = rng.choice(ids[:3000]), rng.choice(ids[:3000])
        assert own.compatible(a, b) == (own.merge(own.texts[a] + own.texts[b]) == [own.texts[a], own.texts[b]])


def test_any_ids_decode_as_in_the_library(model, own):
    rng = random.Random(4)
    for _ in range(20_000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(130, 259), rng.randrange(32000), 259, 29871]) for _ in range(rng.randrange(8))]
        assert own.decode(ids) == model.decode(ids)


def test_round_trip_of_a_table(stored, model):
    rows = list(enumerate(texts(200))) + [(7, "twice"), (7, "twice"), (None, "no id"), (9, "long word " * 60_000 + "x" * 60_000)]
    docs = stored(rows, "doc_id long, text string", extra=True)
    want = []
    for d, t in rows:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want.append((d or -1, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    got = pieces.round_trip(docs, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r[0] or -1, *r[1:]) for r in got.collect()) == sorted(want)
    encoded = pieces.encode(docs, PATH, begin=False, end=False)
    assert sorted((r.doc_id or -1, r.ids) for r in encoded.collect()) == sorted((d or -1, model.encode(t or "")) for d, t in rows)
    assert sorted((r.doc_id or -1, r.text) for r in pieces.decode(encoded, PATH).collect()) == sorted((d or -1, model.decode(model.encode(t or ""))) for d, t in rows)


def test_empty_table(stored):
    docs = stored([], "doc_id long, text string")
    assert pieces.round_trip(docs, PATH).collect() == [] and pieces.encode(docs, PATH).collect() == []
