import random

import numpy as np

from faultline.llm import _bytes
from faultline.llm._bytes import BY_LETTERS, BY_SPACE, gram_hashes, pieces, span_hashes, words
from faultline.llm.toxicity import _runs, _runs_of


def texts(rng):
    made = [" ".join(f"w{rng.randrange(3000)}" for _ in range(n)).encode() for n in (0, 1, 10, 300_000, 5)]
    return made + ["Ünï\tcode\x0bÄB\r\n".encode(), b"\x00 a\x00b", b"x" * 1_500_000, b" " * 1_200_000, b""]


def test_words_are_splits(rng):
    given = texts(rng)
    found = words(given, BY_SPACE)
    assert np.diff(found.first).tolist() == [len(t.split()) for t in given]
    hashes = found.hashes()
    seen = {}
    flat = [w for t in given for w in t.split()]
    for w, h in zip(flat, hashes.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert words([b"Ab-C1"], BY_LETTERS).hashes().tolist() == words([b"aB c1"], BY_LETTERS).hashes().tolist()


def test_blocks_and_pieces_change_nothing(rng, monkeypatch):
    given = texts(rng)
    whole = words(given).hashes()
    monkeypatch.setattr(_bytes, "BLOCK", 1000)
    assert np.array_equal(words(given).hashes(), whole)
    back = [b""] * len(given)
    for some, of in pieces(given, 5000):
        for text, i in zip(some, of):
            back[i] += text
    assert back == given
    one, two = _runs(given), _runs_of(given)
    assert sorted(zip(*map(np.ndarray.tolist, one))) == sorted(zip(*map(np.ndarray.tolist, two)))


def test_grams_depend_on_their_words_alone():
    rng = random.Random(1)
    values = np.array([rng.randrange(1 << 63) for _ in range(50)] * 2, np.uint64)
    grams = gram_hashes(values, 7)
    assert np.array_equal(grams[:44], grams[50:]) and len(set(grams.tolist())) == 50
    at = np.arange(10)
    assert not np.array_equal(span_hashes(values, at, at + 3), span_hashes(values, at, at + 3, seed=1))


def test_runs_do_not_depend_on_the_batch():
    rng = random.Random(2)
    given = [bytes(rng.choice(b"abcdefg hij") for _ in range(rng.randrange(40))) for _ in range(300)]
    codes, owner = _runs(given)
    for i, text in enumerate(given):
        assert sorted(codes[owner == i].tolist()) == sorted(_runs([text])[0].tolist())
