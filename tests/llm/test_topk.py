import math
import random

import numpy as np
from pyspark.sql import functions as F

from faultline.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, id int, `rank` int"


def by_hand(rows, k):
    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def result(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 100 == 0, k).collect())


def test_matches_plain_python(spark, monkeypatch):
    monkeypatch.setattr(topk, "SMALL", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(24)]) for i in range(900)]
    rows[310:500] = [(i, rows[7][1]) for i in range(310, 500)]  # many equal vectors: ties
    assert result(spark, rows) == by_hand(rows, 10)


def test_odd_vectors(spark):
    rows = [(0, [0.5, 0.25]), (100, [1.0]), (200, []), (300, None), (400, [1.0, None]), (500, [float("nan"), 1.0]), (600, [float("inf")]), (None, [1.0, 1.0]),
            (1, [-0.3, 0.7, 0.9]), (2, [0.0, 0.0]), (3, [1.0, float("-inf")])]
    assert result(spark, rows) == by_hand(rows, 10)


def test_few_repeated_and_empty(spark):
    assert result(spark, []) == [] and result(spark, [(1, [1.0])]) == [] and result(spark, [(0, [1.0])]) == []
    assert result(spark, [(0, [1.0]), (0, [1.0]), (1, [0.5]), (1, [0.5])]) == [(0, 1, 1, 524288), (0, 2, 1, 524288)]
    assert result(spark, [(0, [1.0]), (-100, [2.0]), (5, [3.0])], 1) == [(-100, 1, 5, 6291456), (0, 1, 5, 3145728)]


def test_bounds_never_lose(spark):
    rng = np.random.default_rng(3)
    for scale in (1, 1000, 10**6):
        v = rng.integers(-scale, scale + 1, (300, 17))
        ids = rng.permutation(300).astype(np.int64)
        query, found, score = topk.best(ids[:20], v[:20], ids, v, 7)
        for i in range(20):
            s = v @ v[i]
            want = sorted((-int(s[j]), int(ids[j])) for j in range(300) if j != i)[:7]
            own = query == ids[i]
            assert list(zip((-score[own]).tolist(), found[own].tolist())) == want
