import hashlib
import random

import pytest

from faultline.llm import fingerprints
from tests.llm.conftest import frame, prose


def rows_by_hand(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for (doc, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        text, following = text or "", following or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        a, b, c = fingerprints.simhashes([x.encode() for x in (text, edited, following)])
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [fingerprints.RANGE, 7])
def test_neighbours_match_plain_python(spark, rng, monkeypatch, size):
    monkeypatch.setattr(fingerprints, "RANGE", size)
    rows = [(i * i - 50, prose(rng, rng.randrange(0, 80)) + "é🙂" * (i % 3)) for i in range(120)] + [(10**12, None), (-10**12, ""), (10**12 + 1, prose(rng, 50_000)), (None, "null id first")]
    rng.shuffle(rows)
    got = sorted((tuple(r) for r in fingerprints.compared(frame(spark, rows)).collect()), key=str)
    assert got == rows_by_hand(rows)


def test_one_row_repeats_and_empty(spark):
    assert [tuple(r) for r in fingerprints.compared(frame(spark, [(5, "abcd efgh")])).collect()] == rows_by_hand([(5, "abcd efgh")])
    got = fingerprints.compared(frame(spark, [(1, "a b"), (1, "a b"), (2, "c d"), (2, "c d")])).collect()
    assert len(got) == 4 and all(r.fingerprint == got[0].fingerprint for r in got if r.doc_id == got[0].doc_id)
    assert fingerprints.fingerprint_report(frame(spark, [])).count() == 0


def test_equal_texts_are_equal_and_near_ones_near(rng):
    texts = [prose(rng, 300) for _ in range(30)]
    one = fingerprints.simhashes([t.encode() for t in texts])
    assert one == [fingerprints.simhashes([t.upper().encode()])[0] for t in texts]
    for text, fp in zip(texts, one):
        words = text.split()
        words[7] = "other"
        assert fingerprints.likeness(fp, fingerprints.simhashes([" ".join(words).encode()])[0]) > 0.9
    assert max(fingerprints.likeness(a, b) for a in one for b in one if a != b) < 0.6


@pytest.mark.parametrize("radius,blocks,chunk", [(0, None, 512), (3, None, 512), (3, 5, 4), (5, 6, 3)])
def test_near_counts_match_all_pairs(spark, monkeypatch, radius, blocks, chunk):
    monkeypatch.setattr(fingerprints, "CHUNK", chunk)
    rng = random.Random(radius)
    values = set()
    for _ in range(6):
        base = rng.getrandbits(128)
        for _ in range(20):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(128)
            values.add(x)
    want = {f"{a:032x}": n for a in values if (n := sum((a ^ b).bit_count() <= radius for b in values) - 1)}
    rows = spark.createDataFrame([(f"{x:032x}",) for x in sorted(values)] * 2, "fingerprint string")
    assert {r.fingerprint: r.near for r in fingerprints.near_counts(rows, radius, blocks).collect()} == want
    pairs = [tuple(r) for r in fingerprints.near_pairs(rows, radius, blocks).collect()]
    assert sorted(pairs) == sorted((f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in values for b in values if a < b and (a ^ b).bit_count() <= radius)
