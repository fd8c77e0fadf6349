"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has a bit where more than half of its shingle hashes have
it. The 64 bits are cut into ``radius // 2 + 1`` segments, so two fingerprints
within the radius agree in one segment up to one bit. Each distinct fingerprint
puts its segments into a table and looks up, per segment, the Hamming ball of
radius one (the segment itself, and it with one of its set bits cleared: of two
segments that differ in one bit, exactly one has the bit). Matches are verified
by the complete distance inside the join.

Equal fingerprints are one row from the start, so copies never pair up. Within
a table slot that many distinct fingerprints share, the pairs are replaced by
balls: see :func:`_dense_links`.

Defined results: null texts count as empty; a text without words has the
fingerprint 0 and links like any other; a text with fewer words than a shingle
is one shingle; a null id never names a component (a component of null ids only
has a null ``component_id``); repeated rows each give a row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm._shared import slices, stored, utf8
from faultline.llm.components import components

#: Distinct fingerprints in one table slot above which its pairs aren't compared one by one.
DENSE = 512


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash of a text as a signed integer."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # ASCII letters and ASCII white space only, as bytes
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(x) + 1 for x in found])
    starts = [0, *ends[:-1].tolist()][: max(1, len(found) - shingle + 1)]
    last = (ends[min(shingle, len(found)) - 1:] - 1).tolist()
    h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, last)), np.uint64, len(starts))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[at: at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): a row for each row of ``docs``."""
    return _fingerprinted(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), shingle)


def _fingerprinted(rows: DataFrame, shingle: int) -> DataFrame:
    """The columns of ``rows``, with the fingerprint for the text."""
    keep = [c for c in rows.columns if c != "text"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = [fingerprint(x, shingle) for x in utf8(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(fps, pa.int64())], [*keep, "fp"])

    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "fp long"]))


def segments(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    m = radius // 2 + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return fp if width == 64 else F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _bit(i: int) -> int:
    return (1 << i) if i < 63 else -(1 << 63)


def _table(fps: DataFrame, radius: int, probe: bool) -> DataFrame:
    """(seg, key, near, fp): the slots that a fingerprint is stored in, or looks up.

    ``near`` is 0 for the segment itself and 1 for a neighbour with a cleared bit.
    """
    keys = []
    for seg, (shift, width) in enumerate(segments(radius)):
        own = _segment(F.col("fp"), shift, width)
        keys.append(F.array(F.struct(F.lit(seg).alias("seg"), own.alias("key"), F.lit(0).alias("near"))))
        if probe and radius:
            keys.append(F.filter(
                F.array(*[F.when(own.bitwiseAND(F.lit(_bit(i))) != 0, F.struct(
                    F.lit(seg).alias("seg"), own.bitwiseXOR(F.lit(_bit(i))).alias("key"), F.lit(1).alias("near"))) for i in range(width)]),
                lambda x: x.isNotNull()))
    return fps.select("fp", F.explode(F.concat(*keys)).alias("at")).select("at.seg", "at.key", "at.near", "fp")


def links(fps: DataFrame, radius: int = 3, dense: int = DENSE) -> DataFrame:
    """(a, b): links between distinct fingerprints within the radius.

    Every link is there outside slots of more than ``dense`` fingerprints; in
    those slots the links given join the same fingerprints together.
    """
    index = _table(fps, radius, probe=False)
    sizes = index.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > dense).select("seg", "key")
    crowded = stored(sizes, "crowded")
    probes = _table(fps, radius, probe=True)
    pairs = probes.join(crowded, ["seg", "key"], "left_anti").alias("p").join(
        index.alias("i"), (F.col("p.seg") == F.col("i.seg")) & (F.col("p.key") == F.col("i.key"))
        & ((F.col("p.near") == 1) | (F.col("p.fp") < F.col("i.fp")))
        & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("i.fp"))) <= radius))
    out = pairs.select(F.col("p.fp").alias("a"), F.col("i.fp").alias("b"))
    if crowded.isEmpty():
        return out
    return out.union(_dense_links(probes.join(crowded, ["seg", "key"], "left_semi"), radius))


def _dense_links(probes: DataFrame, radius: int) -> DataFrame:
    """Links for crowded slots that need no pairs: each row spreads over the points
    of small Hamming balls around its fingerprint's rest (the bits outside the
    segment), for radii up to 4.

    In a slot, rows with near 0 share the segment and may differ by d = ``radius``
    in the rest (kind 0); a row with near 1 differs from those by one bit already,
    so d = ``radius - 1`` (kind 1). Two rests within d bits have a point within
    ``d // 2`` of either one and ``d - d // 2`` of the other. So at each point one
    near-0 row of the inner ball becomes the head, to which all rows of the outer
    ball link: they are within d of it. A row costs a fixed number of points
    however crowded the slot is.
    """
    spread = []
    for seg, (shift, width) in enumerate(segments(radius)):
        rest = [i for i in range(64) if not shift <= i < shift + width]
        ones = [_bit(i) for i in rest]
        balls = [[0], ones, [x ^ y for k, x in enumerate(ones) for y in ones[k + 1:]]]
        cut = 0
        for x in ones:
            cut |= x
        at = probes.filter(F.col("seg") == seg)
        for kind in ((0, 1) if radius else (0,)):
            inner, outer = (radius - kind) // 2, radius - kind - (radius - kind) // 2
            masks = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(int(w <= inner)).alias("inner"))
                              for w in range(outer + 1) for m in balls[w]])
            spread.append((at if kind else at.filter("near = 0")).select("seg", "key", "near", "fp", F.explode(masks).alias("m")).select(
                "seg", "key", F.lit(kind).alias("kind"), F.col("fp").bitwiseAND(F.lit(cut)).bitwiseXOR(F.col("m.mask")).alias("point"),
                "fp", (F.col("near") + 1 - F.col("m.inner") == 0).alias("inner")))
    points = spread[0]
    for x in spread[1:]:
        points = points.union(x)
    by = ["seg", "key", "kind", "point"]
    heads = points.groupBy(*by).agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("head"), F.count(F.lit(1)).alias("n")).filter(
        "head is not null and n > 1").select(*by, "head")
    return points.join(heads, by).filter("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text",
                    dense: int = DENSE) -> DataFrame:
    """(doc_id, fp, component_id): each row's fingerprint and the smallest id that
    links of at most ``radius`` differing bits reach from it, itself included."""
    rows = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"), radius, dense))
    of = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(least, "root").select(F.col("fp").alias("named"), "component_id")
    return rows.join(named, rows.fp == named.named).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of ``docs`` of each component: the one with the smallest doc_id, of
    rows that repeat it the first by hashes of the text and of all columns. Rows
    with a null doc_id are a kind of their own: of a component's, the first by
    those hashes stays, also beside a named one."""
    hashed = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    keyed = docs.withColumns({"own id": F.col("doc_id").cast("long"), "own mark": F.coalesce(F.unhex(F.md5("text")), F.lit(b"")), "own hash": F.xxhash64(*hashed)})
    rows = _fingerprinted(keyed.select(F.col("own id").alias("doc_id"), F.col("own mark").alias("mark"), F.col("own hash").alias("hash"), "text"), shingle)
    key = F.struct("doc_id", "mark", "hash")
    kinds = {"named": F.col("doc_id").isNotNull(), "nameless": F.col("doc_id").isNull()}
    fps = stored(rows.groupBy("fp").agg(*[F.min(F.when(is_kind, key)).alias(c) for c, is_kind in kinds.items()]), "distinct-fingerprints")
    roots = components(links(fps.select("fp"), radius))
    of = fps.join(roots, fps.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(*[F.min(c).alias(c) for c in kinds])
    keys = least.select(F.explode(F.array(*kinds)).alias("k")).filter("k is not null").select("k.*")
    kept = keyed.join(keys, F.col("own id").eqNullSafe(keys.doc_id) & (F.col("own mark") == keys.mark) & (F.col("own hash") == keys.hash), "left_semi")
    return kept.dropDuplicates(["own id", "own mark", "own hash"]).select(*docs.columns)
