"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each its mean and deviation are kept, at
several resolutions from one segment to sixteen. By Cauchy and Schwarz, two
vectors' squared distance is at least the sum over segments of length * ((mean
difference)**2 + (deviation difference)**2), and with the norms that lower bound
of the distance is an upper bound of the inner product. Coarse to fine, a pair
whose bound is below what the query already has k times is given up; the rest gets its
exact integer score.

Queries and candidates are packed into blocks of bounded size, and each pair of
blocks is one row of work: a stated query set against all rows, in blocks. A
query keeps k per candidate block, and a grouped rank merges those.

Defined results: a component x counts as floor(1024 * x) (``scale`` in general); a vector that is null, or holds a
null or non-finite component, takes no part; an empty vector has the score 0
with any; of two vectors with different lengths the longer one's further
components count as 0; equal scores go to the smaller id; rows that repeat an id
are candidates each, ask once if they are equal and are ranked together if not;
a query's own id is never its candidate; a null id takes no part; scores are
exact as long as they fit 64 bits; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.llm._shared import stored

RESOLUTIONS = (1, 4, 16)
#: Vectors of a query block, and of a candidate block at least and at most (hashing deals them evenly).
QUERIES = 512
SMALL, LARGE = 2048, 1 << 16


def _blocks(rows: DataFrame, groups: int, name: str) -> DataFrame:
    """Pack (id, v) into ``groups`` rows at most, dealt by a hash of the row: (name,
    width, ids, values), 64-bit integers, shorter vectors filled with zeros."""

    def pack(table: pa.Table) -> pa.Table:
        lists = table.column("v").combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().to_numpy()
        width = int(sizes.max())
        values = np.zeros((len(sizes), width), np.int64)
        values[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
        return pa.table({name: pa.array([table.column(name)[0].as_py()], pa.int32()), "width": pa.array([width], pa.int32()),
                         "ids": [table.column("id").to_numpy().tobytes()], "values": [values.tobytes()]})

    dealt = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(groups)).cast("int").alias(name), "id", "v")
    return stored(dealt.groupBy(name).applyInArrow(pack, f"{name} int, width int, ids binary, values binary"), name)


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Each segment's mean and deviation, times the root of its length, so that plain distances of these are the bound."""
    cuts = [x.shape[1] * i // segments for i in range(segments + 1)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            part = x[:, a:b]
            out += [part.mean(axis=1) * math.sqrt(b - a), part.std(axis=1) * math.sqrt(b - a)]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


def best(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of each query's k best in one pair of blocks, ties to smaller ids."""
    width = max(q.shape[1], v.shape[1], 1)
    q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
    order = np.argsort(vid, kind="stable")
    vid, v = vid[order], v[order]
    qf, vf = q.astype(np.float64), v.astype(np.float64)
    norm_q, norm_v = (qf * qf).sum(axis=1), (vf * vf).sum(axis=1)
    levels = [(_statistics(qf, s), _statistics(vf, s)) for s in RESOLUTIONS if s <= width]
    levels = [(a, b, (a * a).sum(axis=1), (b * b).sum(axis=1)) for a, b in levels]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(qid)):
        # rounding slack: far above what doubles lose, far below one unit for vectors of ordinary size
        slack = 1e-9 * (norm_q[i] + norm_v.max(initial=0.0)) + 1e-6
        alive = np.flatnonzero(vid != qid[i])
        floor = -np.inf
        for a, b, na, nb in levels:
            # distance >= na + nb - 2 a.b, so score <= (norms - that) / 2
            bound = (norm_q[i] + norm_v[alive] - na[i] - nb[alive]) / 2 + b[alive] @ a[i]
            if len(alive) > k:
                some = alive[np.argpartition(-bound, k - 1)[:k]]  # the most promising ones' exact scores
                floor = max(floor, float((v[some] @ q[i]).min()))
                alive = alive[bound >= floor - slack]
        score = v[alive] @ q[i]
        top = np.lexsort((vid[alive], -score))[:k]
        out.append((np.full(len(top), qid[i]), vid[alive][top], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out))


def search(rows: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the k
    other rows with the highest inner products, ranks from 1."""
    x = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = rows.filter(usable).select(
        F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(scale))).alias("v"), is_query.alias("asks"))
    whole = stored(whole, "vectors")
    n = whole.count()
    asked = whole.filter("asks").select("id", "v").distinct()
    queries = _blocks(asked, math.ceil(asked.count() / QUERIES), "qblock") if n else asked
    if not n or queries.isEmpty():
        return whole.limit(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    cores = whole.sparkSession.sparkContext.defaultParallelism
    groups = math.ceil(n / min(LARGE, max(SMALL, n // (4 * cores))))
    candidates = _blocks(whole.select("id", "v"), groups, "cblock")
    # Each block of queries goes to every block of candidates.
    asks = queries.select(F.col("ids").alias("qids"), F.col("values").alias("qvalues"), F.col("width").alias("qwidth"),
                          F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cblock"))
    pairs = asks.join(candidates, "cblock")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("qids", "qvalues", "qwidth", "ids", "values", "width")}
                qid, vid = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["ids"], np.int64)
                found = best(qid, np.frombuffer(row["qvalues"], np.int64).reshape(len(qid), row["qwidth"]),
                             vid, np.frombuffer(row["values"], np.int64).reshape(len(vid), row["width"]), k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["query_id", "vec_id", "score"])

    found = pairs.select("qids", "qvalues", "qwidth", "ids", "values", "width").mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
