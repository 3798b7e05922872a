import random

import public_tokenizers
import pytest
import sentencepiece

from placekit.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(1)
    odd = [None, "", " ", "  ", "\n", "\n\n ", "a", " a", "a ", "  a  b ", "▁", "a▁b", "▁ ▁a", "<s> </s> <unk> <0x0A>", "\t\r\n", "é ñ ß 日本語 🙂", "\x00", "a b　c", "﻿x", "x" * 3000]
    parts = [" ", "  ", "\n", "▁", "the", "ing", "é", "日", "\t", "<s>", ".", "ab", "Z", "🙂", "́"]
    return odd + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("size", [0, 50, 100_000])
def test_counts_equal_whole_texts(stored, size):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = list(enumerate(texts())) + [(7, "twice"), (7, "twice"), (None, "no id")]
    got = tokens.count_tokens(stored(rows, "doc_id long, text string", extra=True), PATH, limit=10, dictionary_size=size)
    want = [(d is None, d or 0, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 10) for d, t in rows]
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == sorted(want)


def test_empty_table(stored):
    assert tokens.count_tokens(stored([], "doc_id long, text string"), PATH).collect() == []


def test_pre_tokens_make_up_the_text():
    for t in texts():
        assert "".join(tokens.pre_tokens(t)) == (" " + t if t else "")
