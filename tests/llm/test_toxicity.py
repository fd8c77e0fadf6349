import math
import zlib
from collections import Counter, defaultdict

from faultline.llm import toxicity
from tests.llm.conftest import frame, prose


def corpus(rng, n=700):
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 1
        text = prose(rng, rng.randrange(20, 150)).split()
        for _ in range(4 if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["grotzel", "grotzelen", "Wunsk!", "wunsker"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark, rng):
    rows, labels = corpus(rng)
    rows += [(10_000, None), (10_001, ""), (10_002, "!!! ..."), (10_003, "wunskel grotzelig " * 3), (None, "plain"), (5, rows[5][1])]
    got = toxicity.score(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    held = [(by[i] >= 0.5) == (t == 1) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100 and sum(held) / len(held) > 0.97
    assert by[10_003] >= 0.5  # of these words only the stems were labelled
    assert by[10_000] == by[10_001] == by[10_002] < 0.5


def test_held_out_labels_are_not_read(spark, rng):
    rows, labels = corpus(rng, 300)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.score(frame(spark, rows), spark.createDataFrame(x, LABELS)).collect()) for x in (labels, turned))
    assert one == two


def test_odd_labels_and_empty_tables(spark, rng):
    rows, labels = corpus(rng, 40)
    odd = [(None, 1, 1), (1, 1, None), (2, 1, 7), (3, 1, 0), (3, 1, 1), (999_999, 1, 1)]
    for given in ([], odd, [(i, q, 0) for i, q, _ in labels]):
        assert {r.score for r in toxicity.score(frame(spark, rows), spark.createDataFrame(given, LABELS)).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def test_keeps_rows_as_they_are(spark, rng):
    rows, labels = corpus(rng)
    docs = frame(spark, rows + [(20_000, None), (None, "plain")])
    kept = toxicity.keep_ordinary(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    ids = {r.doc_id for r in kept.collect()}
    wrong = [i for i, _, t in labels if (i in ids) == (t == 1)]
    assert len(wrong) < 0.03 * len(labels) and {20_000, None} <= ids


def test_reruns_agree(spark, rng):
    rows, labels = corpus(rng, 400)
    labelled = spark.createDataFrame(labels, LABELS)
    one = sorted(tuple(r) for r in toxicity.score(frame(spark, rows), labelled).collect())
    two = sorted(tuple(r) for r in toxicity.score(frame(spark, rows[::-1]).repartition(9), labelled.repartition(3)).collect())
    assert one == two


def test_runs_keep_their_own_ratios(spark, rng):
    # a hashed slot gave the runs that share it one mean; each run has its own row now
    rows, labels = corpus(rng)
    voted = {i: t for i, _, t in labels}
    found = toxicity.log_ratios(spark.createDataFrame([(x, voted[i]) for i, x in rows], "text string, toxic int"))
    assert found.groupBy("run").count().filter("count > 1").isEmpty()
    ratios = {r.run: r.ratio / toxicity.UNIT for r in found.collect()}
    codes, _ = toxicity._runs([b"grotzel"])
    hit = [ratios[int(c)] for c in codes if int(c) in ratios]
    assert hit and toxicity._evidence(frame(spark, [(1, "grotzel")]), found, (6.0,), ["doc_id"]).first().e0 * len(codes) ** 0.5 == sum(hit)


def test_what_is_not_sent_is_joined(spark, rng):
    rows, labels = corpus(rng)
    rows += [(10_000, None), (10_001, ""), (5, rows[5][1]), (None, rows[6][1]), (10_002, rows[6][1])]
    labelled = spark.createDataFrame(labels, LABELS)
    want = sorted((tuple(r) for r in toxicity.score(frame(spark, rows), labelled).collect()), key=str)
    for sent in (1, 40):
        assert sorted((tuple(r) for r in toxicity.score(frame(spark, rows), labelled, sent).collect()), key=str) == want


def runs_of(text):
    """(five symbols before, symbol) of each symbol of each word, and of the border behind it."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return [[((("\0" * 5) + w)[i: i + 5], (w + "\0")[i]) for i in range(len(w) + 1)] for w in words]


def test_every_run_has_its_kneser_ney_ratio(spark, rng):
    # runs whose classes may be alike were left out, and so were runs that no labelled text has
    rows, labels = corpus(rng, 60)
    rows.append((60, "zyqxo vuka zyqxo"))
    voted = {i: t for i, _, t in labels} | {60: 1}
    counts = {c: Counter(r for i, x in rows if voted[i] == c for r in {r for w in runs_of(x) for r in w}) for c in (0, 1)}
    both = counts[0] + counts[1]
    sides = {c: defaultdict(list) for c in (0, 1, 2)}
    for c, found in ((0, counts[0]), (1, counts[1]), (2, both)):
        for (before, _), n in found.items():
            sides[c][before].append(n)
    tails = Counter((before[-2:], last) for before, last in both)
    heads = defaultdict(list)
    for (head, _), n in tails.items():
        heads[head].append(n)

    def of(c, before, last):
        if c == 2:  # the shared estimate
            low = (tails[before[-2:], last] - 0.75 + 0.75 * len(heads[before[-2:]]) / 256) / sum(heads[before[-2:]])
            return (both[before, last] - 0.75 + 0.75 * len(sides[2][before]) * low) / sum(sides[2][before])
        n, total = counts[c][before, last], sum(sides[c][before]) + toxicity.STRENGTH
        return max(n - 0.75, 0) / total + left(c, before) * of(2, before, last)

    left = lambda c, before: (0.75 * len(sides[c][before]) + toxicity.STRENGTH) / (sum(sides[c][before]) + toxicity.STRENGTH)
    code = lambda symbols: sum(ord(x) << 8 * i for i, x in enumerate(reversed(symbols)))
    want = {code(before + last): math.log(of(1, before, last) / of(0, before, last)) for before, last in both}
    want |= {toxicity.BEFORE + code(before): math.log(left(1, before) / left(0, before)) for before in sides[2]}
    table = toxicity.log_ratios(spark.createDataFrame([(x, voted[i]) for i, x in rows], "text string, toxic int"))
    got = {r.run: r.ratio / toxicity.UNIT for r in table.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    # the evidence of texts with seen and unseen runs, an expression that one text had among them
    texts = ["vuka zyqxo", "zyqxoka GROTZELIG vukaloup", "ka kageno 77", "vuka zyqxo zyqxo"]

    def evidence(text, share):
        words = {tuple(w) for w in runs_of(text)}
        ratio = lambda w: sum(want.get(code(b + x), want.get(toxicity.BEFORE + code(b), 0.0)) for b, x in w)
        return sum(math.log(1 - share + share * math.exp(ratio(w))) for w in words) / sum(map(len, words)) ** 0.5

    for sent in (None, 30):
        found = {r.text: r for r in toxicity._evidence(frame(spark, list(enumerate(texts))), table, (0.1, 0.003), ["text"], sent).collect()}
        for x in texts:
            assert abs(found[x].e0 - evidence(x, 0.1)) < 1e-7 and abs(found[x].e1 - evidence(x, 0.003)) < 1e-7
    assert found[texts[0]].e0 == found[texts[3]].e0 != 0
