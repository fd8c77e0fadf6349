import random

import pytest

from faultline.llm import quality
from tests.llm.conftest import frame, prose

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("k", [1, 2, 57, 499, 500])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-9), 5.0, -1e12]) for _ in range(500)]
    assert quality.kth_largest(spark.createDataFrame([(x,) for x in values], "x double"), "x", k) == sorted(values)[-k]


def corpus(rng):
    rows = [(i, prose(rng, rng.randrange(5, 80))) for i in range(400)]
    for i in range(0, 400, 4):
        rows[i] = (i, " ".join(w + "###" for w in rows[i][1].split()))
    return rows, [(i, int(i % 4 > 0), 0) for i in range(400) if i % 3]


def test_prefers_the_target(spark, rng):
    rows, labels = corpus(rng)
    rows += [(1000, None), (1001, ""), (None, "x y")]
    got = quality.resample(frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    good, bad = [kept[i] for i in range(400) if i % 4], [kept[i] for i in range(0, 400, 4)]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.1
    weights = {r.doc_id: r.log_weight for r in got}
    assert weights[1000] == weights[1001] == 0
    again = quality.resample(frame(spark, rows[::-1]), spark.createDataFrame(labels, LABELS)).collect()
    assert sorted((str(r.doc_id), r.kept) for r in again) == sorted((str(r.doc_id), r.kept) for r in got)


def test_sample_size_labels_and_empty(spark, rng):
    rows, labels = corpus(rng)
    assert quality.resample(frame(spark, rows), spark.createDataFrame(labels, LABELS), k=37).filter("kept").count() == 37
    assert quality.resample(frame(spark, rows), spark.createDataFrame([], LABELS)).filter("kept").count() == len(rows)
    assert quality.resample(frame(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0
    twice = quality.resample(frame(spark, [(1, "a b")] * 3 + [(2, "c")]), spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 5, 0)], LABELS))
    assert twice.count() == 4
