import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from faultline.llm import packing
from tests.llm.conftest import frame, prose

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@given(st.sampled_from([2, 4, 16, 64]), st.data())
@settings(max_examples=150, deadline=None)
def test_plan_tiles_and_fills(window, data):
    h = np.zeros(window, np.int64)
    h[1:] = data.draw(st.lists(st.one_of(st.just(0), st.integers(0, 40)), min_size=window - 1, max_size=window - 1))
    ranges, n = packing.plan(h, window)
    sequences, remainders = defaultdict(list), defaultdict(list)
    for length, f, t, start, part, first, offset in ranges:
        for k in range(t - f):
            sequences[first + k].append((offset, part))
            remainders[length, f + k].append((start, part))
    assert len(sequences) == n and len(remainders) == h.sum()
    for (length, _), own in remainders.items():
        assert tiles(own) == length
    for own in sequences.values():
        full = tiles(own)
        assert full == window or full & (full - 1) == 0


def tiles(parts):
    at = 0
    for start, size in sorted(parts):
        assert start == at and size > 0
        at += size
    return at


def test_least_squares_uses_what_is_there():
    h = np.zeros(64, np.int64)
    h[[10, 54, 20, 24, 44]] = [100, 80, 200, 100, 5]
    used = np.zeros(64, np.int64)
    for combo, n in packing.repeats(h, 64):
        assert sum(combo) == 64
        for a in combo:
            used[a] += n
    assert (used <= h).all() and used.sum() > 0.85 * h.sum()


def test_ranks_give_the_same_ids(rng):
    texts = [prose(rng, 50), "Ünï çödé — “quotes” … 漢字 한글 ünd 123,456.78\n\n\t  end ", "x" * 9000, " " * 9000, "<|endoftext|> a", "🙂 ok", "", "don't we'll I'M", "​\x00\x85\xa0"]
    texts += ["".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(400)) for _ in range(200)]
    fast, slow = packing.encoder(JSON, RANKS), packing.encoder(JSON, None)
    for a, b in zip(fast(texts), slow(texts)):
        assert a.tolist() == b.tolist()


def pieces_by_hand(spark, rows, window):
    encode = packing.encoder(JSON, None)
    ids = defaultdict(list)
    for doc, text in rows:
        ids[doc].append(np.append(encode([text or ""])[0], 1).astype("<u4"))
    got = packing.pack(frame(spark, rows), JSON, RANKS, window=window).collect()
    sequences, by = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(by) == set(ids)
    for doc, own in by.items():
        assert sum(r.length for r in own) == sum(map(len, ids[doc]))
        for r in own:
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start: r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[doc])
        if len(ids[doc]) == 1:
            assert tiles([(r.start, r.length) for r in own]) == len(ids[doc][0])
    short = 0
    for own in sequences.values():
        full = tiles(own)
        assert full == window or full & (full - 1) == 0
        short += full < window
    assert short <= window.bit_length()
    return got


@pytest.mark.parametrize("window", [64, 2048])
def test_round_trip(spark, rng, window):
    rows = [(i, prose(rng, rng.randrange(1, 300))) for i in range(80)] + [(200 + i, "the same words again") for i in range(40)]
    rows += [(500, None), (501, ""), (502, prose(rng, 6000)), (503, "é🙂")]
    pieces_by_hand(spark, rows, window)


def test_repeats_nulls_and_empty(spark):
    pieces_by_hand(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other"), (None, "no id"), (None, None)], 8)
    assert packing.pack(frame(spark, []), JSON, RANKS).count() == 0
