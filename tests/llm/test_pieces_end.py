"""Texts that end in spaces, against the library."""

import random

import numpy as np
import public_tokenizers
import pytest

from edulens.llm import pieces


@pytest.mark.parametrize("text", ["a ", "a b ", "a  ", "a b   ", " a ", "ü ", "日 ", " ", "  ", "a\n ", "word " * 3])
def test_final_space_is_a_piece(text):
    import sentencepiece

    path = public_tokenizers.path(pieces.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = pieces.encoder(path)
    (ids, spans), = own.encode_all([text])
    assert ids.tolist() == sp.encode(text)
    assert own.sp.decode(ids.tolist()) == sp.decode(sp.encode(text))
    assert spans[0][0] == 0 and spans[-1][1] == len(text.encode())


def test_own_merges_equal_the_library():
    """Ties, long runs without a space, marks in the text and odd characters."""
    import sentencepiece

    path = public_tokenizers.path(pieces.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = pieces.encoder(path)
    assert own.own and own.apart
    rng = random.Random(9)
    texts = ["a" * 5000, "abc" * 3000, "▁a▁▁b▁", "<s></s><unk>", "日本語" * 500, "\t\n x \r\n", "0" * 999, "ééé😀" * 50]
    chars = "etaoin shrdlu▁  ,.éß日\n0123"
    texts += ["".join(rng.choice(chars) for _ in range(rng.randint(1, 400))) for _ in range(300)]
    for t, (ids, _) in zip(texts, own.encode_all(texts)):
        assert ids.tolist() == sp.encode(t), t[:80]
    short = ["".join(rng.choice("▁anthe.,1é😀") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    for t, raw in zip(short, own.merger.many(short)):  # both ways to merge
        assert np.frombuffer(raw, "<i4").tolist() == own.merger.ids(t)
