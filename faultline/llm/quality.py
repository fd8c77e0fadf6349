"""Quality by importance resampling.

Two bag models over hashed n-grams (words and word pairs at white space, in
``BUCKETS`` buckets): one of the target text, the rows labelled as good, and one
of the raw text, all rows. A document's log importance weight is the sum over
its n-grams of the log ratio of the two, in nats per n-gram times ``SHARPNESS``;
with a Gumbel variate added the k largest are a sample without replacement in
proportion to the weights. The variates come from a hash of id and text, so
reruns agree. k is the labelled share of good rows times the number of rows,
unless given.

The counts cover all rows; two numbers per bucket reach the driver. The k-th
key is found by counting keys in ever narrower bins, never by sorting in one
place.

Defined results: a null or empty text has the weight 0; without labels, or with
good ones only, all rows are kept; labels other than 0 and 1, null ones and those of
held-out rows (crc32 of the id as text divisible by 5) are not learnt from;
several labels of one id count as their mean; rows with equal keys at the
border are kept together; repeated rows each give a row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm._bytes import gram_hashes, words
from faultline.llm._shared import slices, stored, utf8

BUCKETS = 1 << 16
SHARPNESS = 20.0
SEED = 7


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word and each pair of neighbouring words, and its text."""
    found = words(texts)
    h, owner = found.hashes(), found.owner()
    pairs = gram_hashes(h, 2, seed=1)
    inside = np.flatnonzero(owner[:-1] == owner[1:]) if len(h) > 1 else np.zeros(0, np.int64)
    return (np.concatenate([h, pairs[inside]]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([owner, owner[inside]])


def log_ratios(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float | None]:
    """For each bucket ln P(target) - ln P(raw), and the labelled share of good rows."""
    good = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("good")).filter(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    share = good.agg(F.avg("good")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            for part in slices(batch, "text"):
                at, owner = _grams(utf8(part.column("text")))
                raw += np.bincount(at, minlength=BUCKETS)
                target += np.bincount(at, part.column("good").to_numpy(zero_copy_only=False)[owner], BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    # Labels grow with the input: at any size they meet the texts by a shuffle, not a broadcast.
    joined = docs.select("doc_id", "text").join(good.hint("shuffle_hash"), "doc_id", "left").select("text", F.coalesce("good", F.lit(0.0)).alias("good"))
    sums = joined.mapInArrow(run, "bucket int, raw double, target double").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    at = sums.column("bucket").to_numpy()
    raw[at] += sums.column("raw").to_numpy()
    target[at] += sums.column("target").to_numpy()
    if not share:
        return np.zeros(BUCKETS), None
    # Rare buckets lean on the raw model, so that unlabelled words aren't held against a text.
    p = raw / raw.sum()
    q = (target + 50 * BUCKETS * p / BUCKETS) / (target.sum() + 50)
    return np.log(q / p), share


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column without nulls, by counts in narrowing bins."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    inside = F.col(column) >= low
    while True:
        width = (high - low) / 1024
        if width <= 0 or low + width == low:
            return low
        bins = rows.filter(inside).groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(1023)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("least"), F.max(column).alias("most")).collect()
        for r in sorted(bins, key=lambda r: -r.bin):
            if k <= r.n:
                break
            k -= r.n
        low, high = r.least, r.most
        if k == r.n or low == high:
            return low
        inside = (F.col(column) >= low) & (F.col(column) <= high)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, key, kept): a row for each row of ``docs``."""
    ratios, share = log_ratios(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for part in slices(batch, "text"):
                at, owner = _grams(utf8(part.column("text")))
                n = np.maximum(1, np.bincount(owner, minlength=part.num_rows))
                weight = SHARPNESS * np.bincount(owner, table[at], part.num_rows) / n
                u = (part.column("noise").to_numpy().view(np.uint64).astype(np.float64) + 0.5) / 2.0**64
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(weight), pa.array(weight - np.log(-np.log(np.clip(u, 1e-18, 1 - 1e-16))))],
                                                 ["doc_id", "log_weight", "key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("noise", F.xxhash64(F.lit(seed), "doc_id", "text"))
    found = stored(rows.mapInArrow(run, "doc_id long, log_weight double, key double"), "importance")
    n = found.count()
    k = min(n, k if k is not None else n if share is None else round(share * n))
    if not n or k >= n:
        return found.withColumn("kept", F.lit(True))
    return found.withColumn("kept", F.col("key") >= kth_largest(found, "key", k) if k else F.lit(False))
