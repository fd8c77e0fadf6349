import pytest

from faultline.llm import substrings
from tests.llm.conftest import frame, prose


def by_hand(rows, window):
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            key = tuple(words[i: i + window])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i: i + window])] < doc:
                gone[i: i + window] = [True] * window
        out.append((doc, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out)


def result(spark, rows, window=50):
    return sorted((r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), r.kept_text) for r in substrings.remove_repeats(frame(spark, rows), window).collect())


def corpus(rng):
    passages = [prose(rng, n) for n in (49, 50, 51, 70, 200)]
    texts = [prose(rng, rng.randrange(5, 200)) for _ in range(40)]
    for i in range(60):
        texts.append(" ".join([prose(rng, rng.randrange(30)), rng.choice(passages), prose(rng, rng.randrange(30)), rng.choice(passages)]))
    texts += texts[40:60] + [("same line " * 300).strip()] * 4 + ["", None, " ", "a\tb\x0bc\xa0d é"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return list(zip(order, texts))


@pytest.mark.parametrize("often", [substrings.OFTEN, 6, 1, 0])
def test_matches_plain_python(spark, rng, monkeypatch, often):
    monkeypatch.setattr(substrings, "OFTEN", often)
    monkeypatch.setattr(substrings, "GROUP", 500)
    rows = corpus(rng)
    assert result(spark, rows) == by_hand(rows, 50)


def test_other_window_and_long_text(spark, rng):
    rows = [(i, prose(rng, 60)) for i in range(6)]
    rows += [(10, rows[2][1] + " " + prose(rng, 100_000)), (11, prose(rng, 5) + " " + rows[2][1])]
    assert result(spark, rows, 20) == by_hand(rows, 20)


def test_nulls_repeats_and_empty(spark, rng):
    text, other = prose(rng, 60), prose(rng, 60)
    rows = [(None, text), (1, text), (1, text), (2, text + " " + other), (2, other)]
    got = sorted(((r.doc_id, r.n_words, len(r.kept_text.split())) for r in substrings.remove_repeats(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 60, 60), (1, 60, 0), (1, 60, 0), (2, 120, 60), (2, 60, 60)], key=str)
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(frame(spark, rows), window=10)


def test_spans_are_maximal(spark, rng):
    passage = prose(rng, 120)
    rows = [(1, passage), (2, "x " + passage + " y")]
    spans = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in substrings.remove_repeats(frame(spark, rows)).collect()}
    assert spans == {1: [], 2: [(1, 121)]}


def test_words_that_share_a_polynomial_hash_are_different(spark, rng):
    from faultline.llm import _bytes
    # Two letters in Thue-Morse order: hashes by powers of an odd base modulo 2**64 can't tell a word from its opposite.
    for n in (1024, 2048):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
        found = _bytes.words([one.encode(), two.encode()])
        assert len(set(found.hashes().tolist())) == 1 and len(set(found.mixed_hashes().tolist())) == 2
        rest = prose(rng, 49)
        rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{two} {rest} x")]
        assert result(spark, rows) == by_hand(rows, 50)


def test_mixed_hashes_tell_words_apart(rng):
    from faultline.llm import _bytes
    texts = [" ".join("".join(rng.choice("ab\0é") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))) for _ in range(300)) for _ in range(20)]
    found = _bytes.words([t.encode() for t in texts])
    want = [w.encode() for t in texts for w in t.split(" ")]
    for seed in (0, 1, 2):
        of = {}
        for w, h in zip(want, found.mixed_hashes(seed).tolist(), strict=True):
            assert of.setdefault(w, h) == h
        assert len(set(of.values())) == len(of)
    assert not set(found.mixed_hashes(1).tolist()) & set(found.mixed_hashes(2).tolist())
