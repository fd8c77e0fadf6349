import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st

from faultline.llm import alignment as A
from tests.llm.conftest import frame, prose

FILES = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]


def by_hand(texts):
    """Plain lists and all pairs of tokens, by the tokenizers themselves."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    one.encode_special_tokens = True
    spelled = A.byte_letters()
    assert len(spelled) == 256 and spelled["Ġ"] == 32 and spelled["Ċ"] == 10
    rows, counts = [], Counter()
    for text in texts:
        row = [[], [], [], []]
        if text:
            want = (" " + text).encode()
            a, b = one.encode(" " + text, add_special_tokens=False), two.encode(text)
            bytes_a = [bytes(spelled[c] for c in t) for t in a.tokens]
            bytes_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(two.id_to_piece, b)]
            if b"".join(bytes_a) == want == b"".join(bytes_b):
                def ends(parts):
                    total, out = 0, []
                    for p in parts:
                        total += len(p)
                        out.append(total)
                    return out

                ea, eb = ends(bytes_a), ends(bytes_b)
                links = [(x, y) for x, i in zip(a.ids, ea) for y, j in zip(b, eb) if i == j]
                pieces, low = [], 0
                for cut in sorted(set(ea) & set(eb)):
                    pieces.append(",".join(str(x) for x, i in zip(a.ids, ea) if low < i <= cut) + "|" + ",".join(str(y) for y, j in zip(b, eb) if low < j <= cut))
                    low = cut
                row = [a.ids, b, links, pieces]
                counts.update(links)
        rows.append(row)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(len(a), len(b), len(p), len(k), sum(counts[x] == most[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(p).encode()).hexdigest() if a else "")
            for a, b, k, p in rows]


def test_report_against_plain_python(spark, rng):
    texts = [None, "", " ", "a", "a", "x▁y", "▁", "<|endoftext|> and <s> </s>", "\0nul", "Ünï 漢字 🙂 ok\n\n\t  end ", "don't  stop", prose(rng, 300), prose(rng, 300).upper(), "x" * 300, "<0x41> A",
             "a퟿b", "  two", "﻿bom"] + [prose(rng, 20) for _ in range(10)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000)])) for _ in range(60)) for _ in range(20)]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    found = A.report(frame(spark, rows), *FILES).collect()
    want = by_hand(texts)
    assert len(found) == len(rows) and sum(r.doc_id is None for r in found) == 1
    for r in found:
        i = 3 if r.doc_id is None else r.doc_id
        assert tuple(r)[1:] == want[i], texts[i]


def test_groups_cover_both_sides(spark, rng):
    texts = [prose(rng, 40), "Straße 漢字", None]
    pair = A.Pair(*FILES)
    for r in A.align(frame(spark, list(enumerate(texts))), *FILES).collect():
        a, b = pair.encode(texts[r.doc_id])
        assert [x for g in r.groups for x in g.a] == a.tolist() and [x for g in r.groups for x in g.b] == b
        for g in r.groups:
            assert b"".join(pair.a[x] for x in g.a) == b"".join(pair.b[x] for x in g.b)


def test_linked_pairs_are_bounded():
    pair = A.Pair(*FILES)
    assert 100_000 < pair.most_links() <= 8 * (sum(map(len, pair.a)) + sum(map(len, pair.b)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=40), st.lists(st.integers(1, 5), max_size=40), st.sampled_from([1, 3, 7, 100]))
def test_blocks_of_ends(a, b, block):
    short = min(sum(a), sum(b))
    ends = []
    for x in (a, b):
        e = [int(n) for n in np.cumsum(x) if n < short] + ([short] if short else [])
        ends.append(np.array(e, np.int64))
    at_a, at_b = A.cuts(*ends, block=block)
    common = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
    assert [int(ends[0][i]) for i in at_a] == [int(ends[1][i]) for i in at_b] == common


def test_held_counts_are_sent_on(spark, rng, monkeypatch):
    rows = list(enumerate(prose(rng, 30) for _ in range(30)))
    whole = {(r.a, r.b): (r.n, r.best) for r in A.link_counts(A.linked(frame(spark, rows), *FILES)).collect()}
    monkeypatch.setattr(A, "HELD", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert whole == {(r.a, r.b): (r.n, r.best) for r in A.link_counts(A.linked(frame(spark, rows), *FILES)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    assert A.report(frame(spark, [(1, "x")]).filter("doc_id = 0"), *FILES).count() == 0
