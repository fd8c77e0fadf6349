import random

import pytest
from xxhash import xxh64_intdigest

from faultline.llm import near_dedup
from tests.llm.conftest import frame, prose


def by_hand(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i: i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, radius):
    """Smallest id that links reach, by plain search over all pairs."""
    ids = list(range(len(fps)))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids[:i]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in ids]


def corpus(rng, n=60):
    texts = [prose(rng, 120) for _ in range(n)]
    for base in texts[:6]:
        for _ in range(12):
            words = base.split()
            words[rng.randrange(len(words))] = "edited"
            texts.append(" ".join(words))
    return texts + texts[:5] + ["", None, " \t\n", "one", "two words", "Ünïcode   ÄB"]


def test_fingerprints_match_plain_python(spark, rng):
    texts = corpus(rng) + ["x " * 300_000]
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in near_dedup.fingerprints(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("dense", [near_dedup.DENSE, 1])
def test_components_match_all_pairs(spark, rng, dense):
    texts = corpus(rng)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, list(enumerate(texts))), dense=dense).collect()}
    assert got == dict(enumerate(classes([by_hand(t) for t in texts], 3)))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
@pytest.mark.parametrize("dense", [512, 1])
def test_links_join_what_all_pairs_join(spark, radius, dense):
    rng = random.Random(radius)
    fps = {0, (1 << 64) - 1}
    for _ in range(8):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    from faultline.llm.components import components
    found = near_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, dense)
    for r in found.collect():
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= radius
    roots = {r.node: r.root for r in components(found).collect()}
    want = classes(fps, radius)
    groups = lambda labels: sorted(sorted(i for i, y in enumerate(labels) if y == x) for x in set(labels))
    assert groups([roots.get(x, x) for x in signed]) == groups(want)


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(7, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "q r s t"), (9, None), (8, "")]
    got = sorted(((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(7, 3), (3, 3), (3, 3), (None, 3), (None, None), (9, 8), (8, 8)], key=str)
    kept = near_dedup.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 8, None, None], key=str)
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    assert near_dedup.keep_one(frame(spark, [])).count() == 0


def test_repeated_and_null_ids_are_decided_by_row(spark, rng):
    one, two, three = (prose(rng, 120) for _ in range(3))
    rows = [(1, one), (5, one), (5, two), (5, two), (6, two), (None, three), (None, three), (None, three), (2, "lone"), (2, None), (7, one, "de")]
    want = sorted([(1, one), (5, two), (None, three), (2, "lone"), (2, None)], key=str)
    for given in (rows, rows[::-1]):
        kept = near_dedup.keep_one(frame(spark, given).repartition(3)).collect()
        assert sorted(((r.doc_id, r.text) for r in kept), key=str) == want


def test_equal_rows_but_for_a_column_choose_alike(spark):
    rows = [(4, "a b c d", lang) for lang in ("en", "de", "fr", "it")]
    kept = [near_dedup.keep_one(frame(spark, x).repartition(n)).collect() for x, n in ((rows, 4), (rows[::-1], 3))]
    assert len(kept[0]) == 1 and kept[0] == kept[1]
