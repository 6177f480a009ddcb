"""Pieces by tables of characters, and ids of pieces that a task has seen."""

import random

import numpy as np
import pytest

from plenogrid.llm import bpe, tokenfile


def test_tables_give_the_pieces_of_the_classes():
    """Classes by category took half of the time that cutting a text takes."""
    other, quick = bpe._compiled()
    r = random.Random(7)
    texts = ["".join(chr(r.choice((32, 39, 95, 10, 97, 115, r.randrange(128), r.randrange(0x300), r.randrange(0xD800)))) for _ in range(30)) for _ in range(3000)]
    plain = [t for t in texts if not other.search(t)]
    assert len(plain) > 1000
    for t in plain:
        assert bpe._ODD.isdisjoint(t) and quick.findall(t) == bpe._QUICK.findall(t) == bpe.pieces(t)
    assert all(other.search(c) for c in ("\x1c", "²", "Ⅳ", "\U0001f600"))


def test_a_piece_is_looked_up_once_and_numbered_there():
    memo = tokenfile._encoder(bpe.read_vocabulary())
    vocab, ours = bpe._loaded(bpe.read_vocabulary())
    texts = ["one two two three", "", "two <|endoftext|> one", "é è 12 ½ xⅣ"]
    for _ in range(2):
        for a, b in zip(memo.texts(texts), ours.texts(texts), strict=True):
            assert np.array_equal(a, b)
    assert list(ours.index.values()) == list(range(len(ours.size)))


def test_a_failed_encoding_leaves_no_piece_without_ids():
    vocab, good = bpe._loaded(bpe.read_vocabulary())
    calls = []

    def encode(words):
        calls.append(words)
        if len(calls) == 1:
            raise MemoryError
        return good.encode(words)

    memo = bpe.Memo(encode, vocab.special, vocab.cut)
    with pytest.raises(MemoryError):
        memo.texts(["some words"])
    assert np.array_equal(memo.texts(["some words"])[0], good.texts(["some words"])[0])
