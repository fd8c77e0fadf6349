"""Mixing sources to target weights.

Each source's words are packed into fixed-length blocks. The mix has a number of
slots, a block each, in output shards; every shard draws how many of its slots
each source fills from a multinomial with the target shares. A source's slots
are numbered through the shards, and slot j takes the block at place j of a
pseudorandom permutation of the source's block indices (a Feistel network, a new
one for each pass over the source); the blocks are then joined by index.

Shares come from weights 5, 2, 1 repeating over the sources in code point order,
null last. A target stops at a bound (twice its source's size); the excess is
shared by weight among the others until none is above.

Slots beyond a source's target are struck and missing ones are added in a last
shard, so the words taken come to the target up to half a block, or the source's
short last one. Blocks have ``BLOCK`` words, in a source of under ``FINE`` blocks fewer,
so that it still has about ``FINE``. No block is taken more often than the bound, so neither is a document.

A source's order is by a hash bucket and then by id, so that running sums need
one bucket of one source in a task at most; everything per source (sizes,
targets, shard counts) is as many rows as sources times buckets or shards.

Defined results: a null or empty text has size 0 and is never taken; a null
source is a source; rows that repeat an id are ordered by size and a hash of the text, equal rows are alike;
a source of size 0 has the target 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.llm._bytes import mix as mixed
from faultline.llm._shared import slices, stored, utf8

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
BOUND = 2.0
BLOCK = 256
FINE = 256
#: Slots of an output shard, and rows of a bucket, on average; the least number of buckets.
SHARD = 1 << 14
BUCKET, BUCKETS = 1 << 14, 64
SEED = 20


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, bound: float = BOUND) -> list[float]:
    """The target words of each source, in the sources' order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, out = share * sum(sizes), [0.0] * len(sizes)
    free = [i for i in range(len(sizes))]
    while free:
        total = sum(w[i] for i in free)
        over = [i for i in free if left * w[i] / total > bound * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = bound * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def permuted(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """Place j of a pseudorandom permutation of 0..n-1: four Feistel rounds on the
    smallest even number of bits, walking on while outside."""
    half = max(1, math.ceil(max(1, n - 1).bit_length() / 2))
    mask = np.uint64((1 << half) - 1)

    def step(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            left, right = right, left ^ (mixed(right + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & mask)
        return left << np.uint64(half) | right

    out = step(j.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = step(out[outside])
    return out.astype(np.int64)


def _mark(text_col: str) -> Column:
    return F.unhex(F.md5(text_col))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, mark): the words of each row, and a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes = [len(t.split()) for t in utf8(part.column("text"))]  # at ASCII white space, as bytes
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(sizes, pa.int64()), part.column("mark")], ["doc_id", "source", "size", "mark"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), _mark(text_col).alias("mark")).mapInArrow(
        run, "doc_id long, source string, size long, mark binary")


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, mark, start): each row's place in its source's words; and
    (source, code, source_size, target, width, blocks) of each source, code by code point, null last."""
    spark = docs.sparkSession
    rows = stored(_sized(docs, id_col, text_col, source_col), "sizes")
    n = rows.count()
    buckets = max(BUCKETS, math.ceil(n / BUCKET))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("of"))
    before = sums.select("source", "bucket", (F.sum("of").over(Window.partitionBy("source").orderBy("bucket")) - F.col("of")).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("d").join(
        before.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket"))).select(
        "d.doc_id", "d.source", "d.size", "d.mark", (F.col("b.before") + F.col("d.within")).alias("start"))
    # One row per source.
    sources = sorted(rows.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r.source is None, r.source or ""))
    made = []
    for code, (r, target) in enumerate(zip(sources, targets([r["size"] for r in sources]))):
        width = max(1, min(BLOCK, r["size"] // FINE))
        made.append((r.source, code, r["size"], float(target), width, math.ceil(r["size"] / width)))
    return placed, spark.createDataFrame(made, "source string, code int, source_size long, target double, width int, blocks long")


def slots(sources: DataFrame, seed: int = SEED) -> DataFrame:
    """(shard, slot, code, pass, block): the blocks that the mix takes, from the
    sources' codes, targets, widths and numbers of blocks."""
    spark = sources.sparkSession
    # One row per source.
    known = sorted((r for r in sources.collect() if r.blocks), key=lambda r: r.code)
    wanted = []
    for r in known:
        passes = min(int(r.target // r.source_size), int(BOUND))
        wanted.append(passes * r.blocks + min(r.blocks, round((r.target - passes * r.source_size) / r.width)))
    total = sum(wanted)
    if not total:
        return spark.createDataFrame([], "shard long, slot long, code int, pass int, block long")
    shares = np.array(wanted) / total
    shards = max(1, math.ceil(total / SHARD))
    per = math.ceil(total / shards)
    codes, blocks = [r.code for r in known], [r.blocks for r in known]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = batch.column("id").to_numpy()
            counts = np.concatenate([np.random.default_rng([seed, int(s)]).multinomial(min(per, total - int(s) * per) if int(s) * per < total else 0, shares) for s in shard])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(shard, len(codes))), pa.array(np.tile(codes, len(shard)), pa.int32()), pa.array(counts, pa.int64())], ["shard", "code", "n"])

    drawn = stored(spark.range(shards).mapInArrow(draw, "shard long, code int, n long"), "drawn")
    quota = spark.createDataFrame(list(zip(codes, wanted)), "code int, wanted long")
    # What the draws leave open comes in a last shard.
    rest = drawn.groupBy("code").agg(F.sum("n").alias("n")).join(quota, "code").select(
        F.lit(shards).cast("long").alias("shard"), "code", F.greatest(F.col("wanted") - F.col("n"), F.lit(0)).alias("n"))
    counted = drawn.union(rest).withColumn("from", F.sum("n").over(Window.partitionBy("code").orderBy("shard")) - F.col("n")).join(quota, "code")
    ranges = counted.select("shard", "code", "from", F.least(F.col("from") + F.col("n"), F.col("wanted")).alias("to")).filter("to > from")
    numbered = ranges.select("shard", "code", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("slot"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = dict(zip(codes, blocks))
        for batch in batches:
            code, slot = batch.column("code").to_numpy(), batch.column("slot").to_numpy()
            block, turn = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int32)
            for c in np.unique(code).tolist():
                own = code == c
                turn[own] = slot[own] // by[c]
                for t in np.unique(turn[own]).tolist():
                    at = own & (turn == t)
                    block[at] = permuted(slot[at] % by[c], by[c], (seed * 1009 + c) * 1009 + t)
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("slot"), batch.column("code"), pa.array(turn), pa.array(block)],
                                             ["shard", "slot", "code", "pass", "block"])

    return numbered.mapInArrow(place, "shard long, slot long, code int, pass int, block long")


def _taken(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows and sources as :func:`_placed` has them, rows with their code; and (doc_id, code, mark, start, pass, shard, slot, a, b): the
    pieces taken, words a to b of a row."""
    placed, sources = _placed(docs, id_col, text_col, source_col)
    placed = placed.alias("p").join(sources.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select(
        "p.doc_id", "p.size", "p.mark", "p.start", "s.code", "s.source_size", "s.target", "s.width")
    spread = placed.filter("size > 0").select(
        "doc_id", "code", "mark", "start", "size", "width", F.explode(F.expr("sequence(start div width, (start + size - 1) div width)")).alias("block"))
    pieces = spread.join(slots(sources, seed), ["code", "block"]).select(
        "doc_id", "code", "mark", "start", "pass", "shard", "slot",
        F.greatest(F.lit(0), F.col("block") * F.col("width") - F.col("start")).alias("a"),
        F.least(F.col("size"), (F.col("block") + 1) * F.col("width") - F.col("start")).alias("b"))
    return placed, sources, pieces


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken): a row for each row of ``docs``
    with the words the mix takes of it, repeats counted."""
    placed, _, pieces = _taken(docs, id_col, text_col, source_col, seed)
    # (code, start) names a row that has words.
    sums = pieces.groupBy("code", "start").agg(F.sum(F.col("b") - F.col("a")).alias("taken"))
    rows = placed.filter("size > 0").join(sums, ["code", "start"], "left")
    empty = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    names = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return rows.select(*names).union(empty.select(*names))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as documents: for each pass in which the mix takes words of a row,
    the row with the words taken, in their order; the text is as it was where
    all are taken. A row is known by its id, source and text; rows that repeat all
    three have the same words, and are told apart by rank."""
    _, sources, pieces = _taken(docs, "doc_id", "text", "source", seed)
    spans = pieces.groupBy("doc_id", "code", "mark", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    # a start is one row of its source, in every pass
    rank = Window.partitionBy("doc_id", "code", "mark").orderBy("start")
    lists = spans.withColumn("copy", F.dense_rank().over(rank)).join(sources.select("code", F.col("source").alias("of")), "code")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # their names can't clash with ours
    own = {c: f"c{docs.columns.index(c)}" for c in ("doc_id", "text", "source")}
    keyed = plain.withColumns({"id": F.col(own["doc_id"]).cast("long"), "of": F.col(own["source"]).cast("string"), "mark": _mark(own["text"])})
    hashed = [c for c, t in plain.dtypes if "map<" not in t and "variant" not in t]
    same = Window.partitionBy("id", "of", "mark").orderBy(F.xxhash64(*hashed))
    rows = keyed.withColumn("copy", F.row_number().over(same)).alias("d")
    joined = rows.join(lists.alias("l"), F.col("d.id").eqNullSafe(F.col("l.doc_id")) & F.col("d.of").eqNullSafe(F.col("l.of"))
                       & (F.col("d.mark") == F.col("l.mark")) & (F.col("d.copy") == F.col("l.copy"))).select(
        *[F.col(c).alias(name) for c, name in zip(plain.columns, docs.columns)], F.col("l.spans").alias("taken spans"))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                texts = []
                for text, own in zip(utf8(part.column(at)), part.column(len(names)).to_pylist()):
                    found = text.split()
                    merged: list[list[int]] = []
                    for s in own:
                        if merged and merged[-1][1] == s["a"]:
                            merged[-1][1] = s["b"]
                        else:
                            merged.append([s["a"], s["b"]])
                    whole = merged == [[0, len(found)]]
                    texts.append(text.decode() if whole else b" ".join(w for a, b in merged for w in found[a:b]).decode())
                columns = [pa.array(texts, part.schema.field(i).type) if i == at else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, docs.schema)
