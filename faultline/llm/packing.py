"""Packing token sequences by non-negative least squares on the length histogram.

A document's ids, with an end id, are cut into whole windows and a remainder
under one window. Only the histogram of remainder lengths (a row per length)
reaches the driver. There the shallow combinations of lengths that fill a
window exactly (two lengths, or one twice and another) are enumerated, repeat
counts are solved against the histogram by non-negative least squares (cyclic
coordinate descent), rounded down and held to what is there. What is left is
packed greedily: the longest left opens as many sequences as the tokens left
can fill, each gap takes the longest remainder that fits, and where none fits one
is cut. So every sequence is full; the last tokens, less than one window, are
dealt into sequences whose lengths are powers of two. Nothing is padded.

The plan is a list of ranges: the remainders of length l with ranks r to s go to
sequences q, q+1, ... at one offset. Its size depends on the number of lengths,
not of documents. Ranks are counted within a length and a hash bucket of the id
and moved by the earlier buckets' counts, so a length that many copies share is
not one group.

Ids are those of the ``tokenizers`` file; texts of ordinary script are encoded
with the same vocabulary's ranks, several times faster, where the two give the
same ids: not for texts with special strings, very long unbroken runs or code
points past U+2FFF, which ``tokenizers`` encodes itself.

Defined results: a null text is empty and is the end id alone; rows that repeat
an id give pieces each; a null id stays null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from faultline.llm._shared import slices, stored

WINDOW = 2048
END = 1
#: Rows of a rank bucket on average, and the least number of buckets.
BUCKET, BUCKETS = 1 << 14, 64

_ODD = re.compile(r"[^\x00-⿿]|\S{4000}|\s{4000}")


def encoder(tokenizer: str, ranks: str | None) -> Callable[[list[str]], list[np.ndarray]]:
    """Texts to id arrays by a tokenizers file, through the same vocabulary's ranks where that gives the same ids."""
    @cache
    def slow():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(tokenizer)

    if ranks:
        import base64

        import tiktoken
        from public_tokenizers import PATTERN

        with open(tokenizer, encoding="utf-8") as described:
            special = [t["content"] for t in json.load(described).get("added_tokens") or []]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def one(text: str) -> np.ndarray:
        if ranks and not any(s in text for s in special) and not _ODD.search(text):
            return np.array(fast.encode_ordinary(text), np.uint32)
        return np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32)

    return lambda texts: [one(t) for t in texts]


def _tokens(docs: DataFrame, window: int, end: int, tokenizer: str, ranks: str | None, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, tokens, crcs, rest, rest_crc, ids): of each row its whole windows' checksums and its remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for ids in encode([t or "" for t in part.column("text").to_pylist()]):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    whole = len(ids) // window
                    rest = ids[whole * window:].tobytes()
                    rows.append((len(ids), [zlib.crc32(ids[i * window: (i + 1) * window].tobytes()) for i in range(whole)], len(ids) % window, zlib.crc32(rest), rest))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *map(pa.array, columns, kinds)],
                                                 ["doc_id", "key", "tokens", "crcs", "rest", "rest_crc", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(
        run, "doc_id long, key long, tokens long, crcs array<long>, rest int, rest_crc long, ids binary")


def repeats(histogram: np.ndarray, window: int, sweeps: int = 60) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths that fill a window and how often to use them.
    ``histogram[l]`` is the number of remainders of length l."""
    have = histogram > 0
    combos = [(a, window - a) for a in range(1, window // 2 + 1) if have[a] and have[window - a]]
    combos += [(a, a, window - 2 * a) for a in range(1, (window + 1) // 2) if have[a] and have[window - 2 * a]]
    parts = []
    for c in combos:
        own: dict[int, int] = {}
        for x in c:
            own[x] = own.get(x, 0) + 1
        parts.append(list(own.items()))
    left = histogram.astype(float).tolist()
    x = [0.0] * len(combos)
    for _ in range(sweeps):
        moved = 0.0
        for j, own in enumerate(parts):
            step = sum(left[a] * k for a, k in own) / sum(k * k for _, k in own)
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for a, k in own:
                    left[a] -= k * step
        if moved < 0.25:
            break
    free, out = histogram.copy(), []
    for j in sorted(range(len(combos)), key=lambda j: -x[j]):
        n = min([int(x[j]), *(int(free[a]) // k for a, k in parts[j])])
        if n > 0:
            for a, k in parts[j]:
                free[a] -= n * k
            out.append((combos[j], n))
    return out


def plan(histogram: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Ranges (length, from rank, to rank, start, part, sequence, offset) and the
    number of sequences. Of the remainders of ``length``, those ranks put their
    ids start..start+part at the offset of sequences that follow each other."""
    out, used, sequence = [], np.zeros(window, np.int64), 0
    for combo, n in repeats(histogram, window):
        offset = 0
        for a in combo:
            out.append((a, int(used[a]), int(used[a]) + n, 0, a, sequence, offset))
            used[a] += n
            offset += a
        sequence += n
    # What is left, by length: (length, from rank, to rank, start).
    pool: dict[int, list[tuple[int, int, int, int]]] = {
        a: [(a, int(used[a]), int(histogram[a]), 0)] for a in range(1, window) if histogram[a] > used[a]}
    tokens = sum(a * (t - f) for a, own in pool.items() for _, f, t, _ in own)

    def take(size: int, part: int, most: int, first: int, offset: int) -> int:
        """Put ``part`` ids of up to ``most`` pooled remainders of ``size`` at the offset of sequences from ``first``; returns how many."""
        nonlocal tokens
        length, f, t, start = pool[size].pop()
        n = min(most, t - f)
        if f + n < t:
            pool[size].append((length, f + n, t, start))
        if not pool[size]:
            del pool[size]
        out.append((length, f, f + n, start, part, first, offset))
        if part < size:
            pool.setdefault(size - part, []).append((length, f, f + n, start + part))
        tokens -= n * part
        return n

    def fill(first: int, n: int, offset: int, target: int) -> None:
        """Fill n sequences from ``first``, all filled up to ``offset``, up to ``target``."""
        todo = [(first, n, offset)]
        while todo:
            first, n, offset = todo.pop()
            gap = target - offset
            if not gap:
                continue
            fits = [a for a in pool if a <= gap]
            size = max(fits) if fits else min(pool)
            got = take(size, min(size, gap), n, first, offset)
            todo.append((first, got, offset + min(size, gap)))
            if got < n:
                todo.append((first + got, n - got, offset))

    while tokens >= window:
        size = max(pool)
        got = take(size, size, min(tokens // window, sum(t - f for _, f, t, _ in pool[size])), sequence, 0)
        fill(sequence, got, size, window)
        sequence += got
    while tokens:
        target = 1 << (tokens.bit_length() - 1)
        fill(sequence, 1, 0, target)
        sequence += 1
    return out, sequence


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, window: int = WINDOW, end: int = END,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the
    pieces of all rows. ``tokenizer`` is the path of a tokenizers file, ``ranks``
    that of the same vocabulary as ranks, if there is one."""
    rows = stored(_tokens(docs, window, end, tokenizer, ranks, id_col, text_col), "tokens")
    counted = rows.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = np.zeros(window, np.int64)
    for r in counted:
        histogram[r.rest] = r.n
    total, histogram[0] = int(histogram.sum()), 0
    ranges, _ = plan(histogram, window)
    buckets = max(BUCKETS, math.ceil(total / BUCKET))
    dealt = rows.select("doc_id", "key", "tokens", "crcs", "rest", "rest_crc").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    # Whole windows are sequences of their own, numbered within a bucket; the plan's come before all of them.
    before = F.coalesce(F.sum(F.size("crcs")).over(Window.partitionBy("bucket").orderBy("doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.withColumn("before", before)
    whole = numbered.select("doc_id", "tokens", "bucket", "before", F.posexplode("crcs").alias("i", "crc")).select(
        "doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        F.col("tokens").alias("doc_tokens"), F.expr("shiftleft(cast(bucket + 1 as bigint), 40) + before + i").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = dealt.filter("rest > 0")
    sums = rests.groupBy("rest", "bucket").agg(F.count(F.lit(1)).alias("of"))
    moved = sums.select("rest", "bucket", (F.sum("of").over(Window.partitionBy("rest").orderBy("bucket")) - F.col("of")).alias("moved"))
    rank = F.row_number().over(Window.partitionBy("bucket", "rest").orderBy("doc_id", "key")) - 1
    ranked = rests.withColumn("rank", rank).join(moved, ["rest", "bucket"]).select(
        "doc_id", "key", "tokens", "rest", "rest_crc", (F.col("rank") + F.col("moved")).alias("rank"))
    by: dict[int, list] = {}
    for r in ranges:
        by.setdefault(r[0], []).append(r)
    sent = docs.sparkSession.sparkContext.broadcast({a: np.array(own, np.int64) for a, own in by.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = sent.value
        for batch in batches:
            rest, rank = batch.column("rest").to_numpy(), batch.column("rank").to_numpy()
            order = np.lexsort((rank, rest))
            found = []
            cut = np.flatnonzero(np.diff(rest[order])) + 1
            for own in np.split(order, cut):
                if not len(own):
                    continue
                ranks_here = rank[own]
                for _, f, t, start, part, sequence, offset in plans[int(rest[own[0]])].tolist():
                    a, b = np.searchsorted(ranks_here, (f, t))
                    if a < b:
                        found.append((own[a:b], np.full(b - a, start), np.full(b - a, part), sequence + ranks_here[a:b] - f, np.full(b - a, offset)))
            if found:
                at, start, part, sequence, offset = (np.concatenate(x) for x in zip(*found))
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in ("doc_id", "key", "tokens", "rest", "rest_crc")), *map(pa.array, (start, part, sequence, offset))],
                                                 ["doc_id", "key", "tokens", "rest", "rest_crc", "begin", "part", "sequence", "offset"])

    pieces = stored(ranked.mapInArrow(place, "doc_id long, key long, tokens long, rest int, rest_crc long, begin long, part long, sequence long, offset long"), "pieces")
    names = ["doc_id", (F.col("tokens") - F.col("rest") + F.col("begin")).alias("start"), F.col("part").alias("length"), "ids_crc32",
             F.col("tokens").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset"]
    uncut = pieces.filter("part = rest").withColumn("ids_crc32", F.col("rest_crc")).select(*names)
    # Only lengths that the plan cuts are read with their ids.
    lengths = sorted({r[0] for r in ranges if r[4] < r[0]})
    ids = rows.filter(F.col("rest").isin(lengths) if lengths else F.lit(False)).select(
        F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "ids").dropDuplicates(["of", "of_key"])
    cut = pieces.filter("part < rest").join(ids, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))).withColumn(
        "ids_crc32", F.crc32(F.expr("substring(ids, cast(begin * 4 + 1 as int), cast(part * 4 as int))"))).select(*names)
    return whole.union(uncut).union(cut)
