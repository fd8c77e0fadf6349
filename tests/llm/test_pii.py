import re

import numpy as np
from hypothesis import given, settings, strategies as st

from faultline.llm import pii
from tests.llm.conftest import frame

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def by_hand(text):
    found = [(m.start(), i, m.end()) for i, k in enumerate(pii.KINDS) for m in re.finditer(BASE[k], text) if passes(k, m[0])]
    return [(pii.KINDS[i], a, b) for a, i, b in sorted(found)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1290+-@._%() é:\n", max_size=60))
def test_base_spans_are_the_plain_patterns(text):
    assert [(pii.KINDS[k], a, b) for k, a, b, base in pii.spans(text) if base] == by_hand(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["1.2.3.4", "0000000300.1.1.1", "256.1.1.1", "4539578763621486", "4539 5787 6362 1486", "+1 (212) 555-0147", "212-555-0147",
                                 "a.b@c.org", "a@b@c.de", "jo at host dot org", "x", "version", ".", " ", "@", "1:2:3:4:5:6:7:8"]), max_size=12), st.sampled_from(["", " "]))
def test_base_spans_in_mixtures(parts, sep):
    text = sep.join(parts)
    spans = pii.spans(text)
    assert [(pii.KINDS[k], a, b) for k, a, b, base in spans if base] == by_hand(text)
    for k, a, b, base in spans:  # an added span lies apart from the base spans of its kind
        assert base or all(b <= c or d <= a for j, c, d, other in spans if other and j == k)


def test_expectation_maximisation_ranks_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.6
    right = np.array([0.95, 0.9, 0.6, 0.55, 0.8])
    votes = np.where(rng.random((4000, 5)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None]) * (rng.random((4000, 5)) < 0.9)
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    p, rates = pii.reliabilities(patterns, n.astype(float))
    order = np.argsort(-(rates[:, 1, 1] - rates[:, 0, 1]))
    assert order.tolist() == np.argsort(-right).tolist()
    key = {tuple(x): q for x, q in zip(patterns, p)}
    assert np.mean([(key[tuple(v)] >= 0.5) == t for v, t in zip(votes, truth)]) > 0.95


def corpus():
    rows = []
    for i in range(60):
        rows.append((i, f"please call tel +1 (212) 555-{1000 + i} or mail to jo{i}@host{i}.org from ip 10.0.{i}.7 now. Card 4539578763621486."))
    rows += [(100, "call the phone 212-555-0147 today"), (101, None), (102, ""), (103, "no data here é"), (104, "sha 9f4539578763621487aa9")]
    return rows


def test_adds_spans_and_keeps_base_ones(spark):
    rows = corpus() + [(100, corpus()[60][1]), (None, "mail a@b.org")]
    found = pii.find(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in found}
    for doc, text in rows:
        assert [(k, a, b) for k, a, b, base in by[doc] if base] == by_hand(text or "")
    assert by[100] == [("phone", 15, 27, False)]
    assert by[104] == []
    digests = {r.doc_id: r for r in pii.digests(pii.find(frame(spark, rows))).collect()}
    assert (digests[0].n_email, digests[0].n_ip, digests[0].n_card, digests[0].n_phone) == (1, 1, 1, 1)
    assert digests[100].spans == "phone:15:27" and digests[100].base_sha256 == digests[101].base_sha256


def test_redacts(spark):
    out = {r.doc_id: r.text for r in pii.redact(frame(spark, corpus())).collect()}
    assert out[3] == "please call tel [PHONE] or mail to [EMAIL] from ip [IP] now. Card [CARD]."
    assert out[101] is None and out[102] == "" and out[103] == "no data here é"


def test_long_text_and_empty_table(spark):
    text = "a" * 300_000 + " " + "1" * 300_000 + "@" + "." * 1000 + " +" + "(" * 100_000 + " a@b.org"
    assert [(pii.KINDS[k], b - a) for k, a, b, base in pii.spans(text) if base] == [("email", 7)]
    assert pii.find(frame(spark, [])).count() == 0 and pii.redact(frame(spark, [])).count() == 0
