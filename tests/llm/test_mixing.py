from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from faultline.llm import mixing
from tests.llm.conftest import frame, prose


@given(st.integers(1, 5000), st.integers(0, 2**40))
@settings(max_examples=60, deadline=None)
def test_permutation(n, key):
    assert np.array_equal(np.sort(mixing.permuted(np.arange(n), n, key)), np.arange(n))


@given(st.lists(st.integers(0, 10**6), max_size=12))
@settings(max_examples=200, deadline=None)
def test_targets_fill_up(sizes):
    got = mixing.targets(sizes)
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    low, high = 0.0, 1e9  # the level at which min(level * weight, bound) adds up
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * a, 2 * s) for a, s in zip(w, sizes)) < 1.5 * sum(sizes) else (low, mid)
    assert got == pytest.approx([min(high * a, 2 * s) for a, s in zip(w, sizes)], rel=1e-6, abs=1e-3)


def corpus(rng):
    rows = [(i, prose(rng, rng.randrange(1, 120)), "en", rng.choice(["a", "a", "a", "b", "c", "Ω"])) for i in range(400)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "b"), (1002, "w1 w2 w3", "en", None), (1003, "lone", "en", "tiny"), (1004, None, "en", "void"),
             (1005, prose(rng, 20_000), "en", "c")]
    return rows


def test_mix(spark, rng):
    rows = corpus(rng)
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    sizes = defaultdict(int)
    for doc, text, _, source in rows:
        assert by[doc]["size"] == len((text or "").split())
        sizes[source] += by[doc]["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.targets([sizes[s] for s in order])))
    taken = defaultdict(int)
    for doc, _, _, source in rows:
        r = by[doc]
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source]) and 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(1, sizes[s] // 100)


def test_reruns_agree_and_documents_hold_the_words(spark, rng):
    rows = corpus(rng)
    one = sorted((r.doc_id, r.taken) for r in mixing.mix(frame(spark, rows)).collect())
    two = sorted((r.doc_id, r.taken) for r in mixing.mix(frame(spark, rows[::-1]).repartition(5)).collect())
    assert one == two
    words = defaultdict(int)
    texts = {r[0]: r[1] for r in rows}
    docs = mixing.mixed_documents(frame(spark, rows))
    assert docs.columns == frame(spark, rows).columns
    for r in docs.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.text == texts[r.doc_id] or len(r.text.split()) < len(texts[r.doc_id].split())
    assert words == {d: n for d, n in one if n}


def test_slots_take_blocks_evenly(spark):
    sources = spark.createDataFrame([("a", 0, 1000, 2000.0, 10, 100), ("b", 1, 1000, 300.0, 10, 100)], "source string, code int, source_size long, target double, width int, blocks long")
    counts = defaultdict(lambda: defaultdict(int))
    for r in mixing.slots(sources).collect():
        counts[r.code][r.block] += 1
    assert set(counts[0].values()) == {2} and len(counts[0]) == 100
    assert set(counts[1].values()) == {1} and len(counts[1]) == 30


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (None, "d e", "en", None), (1, "f", "en", "t")]
    assert sorted((r["size"] for r in mixing.mix(frame(spark, rows)).collect())) == [1, 2, 3, 3]
    words = sum(len(r.text.split()) for r in mixing.mixed_documents(frame(spark, rows)).collect())
    assert words == sum(r.taken for r in mixing.mix(frame(spark, rows)).collect()) > 0
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mixed_documents(frame(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix(frame(spark, [(1, None), (2, "")])).collect()} == {0}


def test_documents_of_one_id_keep_their_own_words(spark, rng):
    # every word names its row, so a word in another row's output shows
    rows = [(None if i % 2 else 7, " ".join(f"r{i}w{k}" for k in range(n)), "en", "ab"[i % 4 // 2]) for i, n in enumerate(rng.choices(range(1, 90), k=60))]
    rows += [rows[3], rows[3], rows[4]]
    own = {t: t.split() for _, t, _, _ in rows}
    got = [r.text.split() for r in mixing.mixed_documents(frame(spark, rows)).collect()]
    assert all(words and len({w.split("w")[0] for w in words}) == 1 for words in got)
    by_row = defaultdict(int)
    for words in got:
        by_row[words[0].split("w")[0]] += len(words)
    copies = defaultdict(int)
    for _, t, _, _ in rows:
        copies[t.split("w")[0]] += 1
    assert all(by_row[t.split("w")[0]] <= 2 * len(w) * copies[t.split("w")[0]] for t, w in own.items())
    assert sum(map(len, got)) == sum(r.taken for r in mixing.mix(frame(spark, rows)).collect())
