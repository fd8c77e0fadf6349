"""Document fingerprints: SimHash over weighted terms, and the search for near ones.

Terms are pairs of neighbouring words (runs of letters and digits, in lower
case; the word itself in a text of one word), weighted by 1 + ln of how often
the text has them. Each term's 128-bit hash votes with its weight for or against
each bit. Weights are whole sixteenths, so equal texts have equal fingerprints
on any machine.

Near fingerprints come from permuted block tables: the bits are cut into blocks,
and for each choice of ``blocks - radius`` of them a table is keyed by those
blocks, moved to the front. Two fingerprints within the radius differ in at most
``radius`` blocks, so some table has them in one slot; there complete distances
decide. A slot of many fingerprints is cut into chunks, and each pair of chunks
is a row of work of its own; a pair counts in the first table that has it, and
only counts leave the task, never pairs.

Defined results: a null text is empty; a text without words has the fingerprint
0; null ids come first in the order of ids, equal ids are ordered by fingerprint
and text; the document after the last is the first, in a table of one row
the row itself; repeated rows each give a row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from faultline.llm._bytes import BY_LETTERS, gram_hashes, mix, words
from faultline.llm._shared import slices, stored, utf8

BITS = 128
RADIUS = 3
#: Rows of a range of ids on average, up to so many ranges; fingerprints of a chunk.
RANGE, RANGES = 2048, 100_000
CHUNK = 512


def simhashes(texts: list[bytes]) -> list[bytes]:
    """The fingerprints of texts, 16 bytes each."""
    found = words(texts, BY_LETTERS)
    h, owner = found.hashes(), found.owner()
    pairs = gram_hashes(h, 2)
    inside = owner[:-1] == owner[1:] if len(h) > 1 else np.zeros(0, bool)
    single = np.diff(found.first) == 1
    terms = np.concatenate([pairs[inside], h[found.first[:-1][single]]])
    of = np.concatenate([owner[:-1][inside] if len(h) > 1 else owner[:0], np.flatnonzero(single)])
    order = np.lexsort((terms, of))
    terms, of = terms[order], of[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    weights = np.round(16 * (1 + np.log(np.diff(np.append(at, len(terms))))))
    terms, of = terms[at], of[at]
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        votes = np.zeros(BITS)
        for i in range(a, b, 1 << 14):
            t, w = terms[i: min(b, i + (1 << 14))], weights[i: min(b, i + (1 << 14))]
            bits = np.unpackbits(np.stack([mix(t), mix(t ^ np.uint64(0x5851F42D4C957F2D))], axis=1).view(np.uint8), axis=1)
            votes += w.astype(np.float32) @ bits.astype(np.float32)  # whole numbers under 2**24: exact in any order
        out.append(np.packbits(2 * votes > weights[a:b].sum()).tobytes())
    return out


def likeness(a: bytes, b: bytes) -> float:
    """The cosine that two fingerprints' distance stands for, 0 for a right angle or more."""
    distance = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return max(0.0, math.cos(math.pi * distance / BITS))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, body, next_fp, next_body): each row beside the row with the next
    id; the bodies are the texts, compressed.

    Ids are cut into ranges at existing ids, so that each range's first row can
    be sent to the range before it too; nothing is sorted in one place.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = rows.agg(F.count("doc_id")).first()[0]
    parts = min(RANGES, max(1, n // RANGE))
    at = [i / parts for i in range(parts)]
    found = rows.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * parts)), F.min("doc_id")).first()  # a number per range
    bounds = np.unique(np.array([*(found[0] or []), *([] if found[1] is None else [found[1]])], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        last = max(0, len(bounds) - 1)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = utf8(part.column("text"))
                null = pa.compute.is_null(part.column("doc_id")).to_numpy(zero_copy_only=False)
                ids = pa.compute.fill_null(part.column("doc_id"), 0).to_numpy()
                own = np.where(null, 0, np.maximum(0, np.searchsorted(bounds, ids, side="right") - 1))
                squeeze = zstandard.ZstdCompressor(level=3)
                bodies, fps = [squeeze.compress(t) for t in texts], simhashes(texts)
                first = np.flatnonzero(null | np.isin(ids, bounds))
                rows = np.concatenate([np.arange(len(texts)), first])
                before = np.where(null[first] | (own[first] == 0), last, own[first] - 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([own, before]).astype(np.int32)), pa.array(np.arange(len(rows)) >= len(texts)),
                    part.column("doc_id").take(pa.array(rows)), pa.array([fps[i] for i in rows], pa.binary()), pa.array([bodies[i] for i in rows], pa.binary())],
                    ["range", "guest", "doc_id", "fp", "body"])

    dealt = rows.mapInArrow(run, "range int, guest boolean, doc_id long, fp binary, body binary")
    order = Window.partitionBy("range").orderBy("guest", "doc_id", "fp", "body")
    return dealt.select("*", F.lead("fp").over(order).alias("next_fp"), F.lead("body").over(order).alias("next_body")).filter("not guest").select(
        "doc_id", "fp", "body", "next_fp", "next_body")


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the start of the next."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next): each text's fingerprint against those of its edited text and of the next row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for part in slices(batch, "body", 1 << 20):
                loose = zstandard.ZstdDecompressor()
                texts, following = ([loose.decompress(x).decode() for x in part.column(c).to_pylist()] for c in ("body", "next_body"))
                changed = [edited(t, f).encode() for t, f in zip(texts, following)]
                fps, changed_fps = part.column("fp").to_pylist(), simhashes(changed)
                columns = [part.column("doc_id"), [len(t) for t in texts], [hashlib.sha256(t).hexdigest() for t in changed],
                           [f.hex() for f in fps], [f.hex() for f in changed_fps],
                           [likeness(a, b) for a, b in zip(fps, changed_fps)], [likeness(a, b) for a, b in zip(fps, part.column("next_fp").to_pylist())]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                                                 ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _choices(radius: int, blocks: int) -> list[tuple[int, ...]]:
    return list(combinations(range(blocks), blocks - radius))


def _block_pairs(fps: DataFrame, radius: int, blocks: int | None) -> tuple[DataFrame, list[np.ndarray]]:
    """(tab, same, others, fps): pairs of chunks of fingerprints that agree on a table's
    blocks, and each table's mask."""
    blocks = blocks or radius + 1
    if not radius < blocks <= BITS:
        raise ValueError("there are more blocks than bits may differ, and at most 128")
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (b - a)) - 1) << (BITS - b) for a, b in ((cuts[i], cuts[i + 1]) for i in own)) for own in _choices(radius, blocks)]

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [bytes.fromhex(x) for x in batch.column("fingerprint").to_pylist()]
            values = [int.from_bytes(x, "big") for x in fps]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(masks), dtype=np.int32), len(fps))),
                pa.array([(v & m).to_bytes(BITS // 8, "big") for m in masks for v in values], pa.binary()), pa.array(fps * len(masks), pa.binary())], ["tab", "key", "fp"])

    dealt = fps.select("fingerprint").distinct().mapInArrow(slots, "tab int, key binary, fp binary").select("tab", F.xxhash64("key").alias("key"), "fp")
    dealt = stored(dealt, "block-tables")
    sizes = dealt.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    chunks = dealt.join(sizes, ["tab", "key"]).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")).groupBy(
        "tab", "key", "chunk", "chunks").agg(F.collect_list("fp").alias("fps"))
    chunks = stored(chunks, "block-chunks")
    left = chunks.select("tab", "key", F.col("chunk").alias("a"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("chunk"), F.col("fps").alias("others"))
    pairs = left.join(chunks.select("tab", "key", "chunk", "fps"), ["tab", "key", "chunk"]).select("tab", (F.col("a") == F.col("chunk")).alias("same"), "others", "fps")
    return pairs, [np.frombuffer(m.to_bytes(BITS // 8, "big"), np.uint8) for m in masks]


def _near(batch: pa.RecordBatch, radius: int, masks: list[np.ndarray]) -> Iterator[tuple[bytes, list[bytes], list[int]]]:
    """Of each fingerprint of a batch of chunk pairs those within the radius that no earlier table has, and their distances."""
    popcount = np.array([bin(i).count("1") for i in range(256)], np.uint8)
    for tab, same, a, b in zip(*(batch.column(c).to_pylist() for c in ("tab", "same", "others", "fps"))):
        x, y = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1) for v in (a, b))
        for i in range(len(x)):
            first = i + 1 if same else 0
            differ = y[first:] ^ x[i]
            distance = popcount[differ].sum(axis=1)
            hit = distance <= radius
            for m in masks[:tab]:
                hit &= (differ & m).any(axis=1)
            if hit.any():
                found = np.flatnonzero(hit)
                yield a[i], [b[first + j] for j in found.tolist()], distance[found].tolist()


def near_counts(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(fingerprint, near): for the distinct fingerprints (hex) that have any, how
    many others are within ``radius`` bits."""
    pairs, masks = _block_pairs(fps, radius, blocks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, int] = {}
            for own, others, _ in _near(batch, radius, masks):
                found[own] = found.get(own, 0) + len(others)
                for other in others:
                    found[other] = found.get(other, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k.hex() for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["fingerprint", "near"])

    return pairs.mapInArrow(count, "fingerprint string, near long").groupBy("fingerprint").agg(F.sum("near").alias("near"))


def near_pairs(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(fingerprint, near, distance): every two different fingerprints (hex) within
    ``radius`` bits, once, the smaller first. Rows leave a task as they are found."""
    pairs, masks = _block_pairs(fps, radius, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, int]] = []

        def sent() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32()))], ["fingerprint", "near", "distance"])

        for batch in batches:
            for own, others, distances in _near(batch, radius, masks):
                rows += [(*sorted((own.hex(), other.hex())), d) for other, d in zip(others, distances)]
                if len(rows) >= 10_000:
                    yield sent()
                    rows = []
        yield sent()

    return pairs.mapInArrow(run, "fingerprint string, near string, distance int")


def fingerprint_report(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of :func:`compared` and near_fingerprints, how many other
    fingerprints of the table are within ``radius`` bits of the row's."""
    rows = stored(compared(docs, id_col, text_col), "fingerprint-report")
    counts = near_counts(rows, radius).withColumnRenamed("fingerprint", "of")
    return rows.join(counts, rows.fingerprint == counts.of, "left").select(*rows.columns, F.coalesce("near", F.lit(0)).cast("long").alias("near_fingerprints"))
