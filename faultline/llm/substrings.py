"""Repeated passages by prefix-partitioned suffix trees over words.

The strings are the documents' words; a suffix matters down to the depth of one
window (50 words). Three steps, each a Spark stage:

1. *Anchors.* The anchor of a window is its leftmost ten-word run with the
   smallest hash, so equal windows have equal anchors. A grouped count finds the
   anchors that occur in at least two documents; every other suffix is a leaf
   right below the root and goes no further. Nothing that repeats is lost.
2. *Prefixes.* The suffixes left are dealt out by a prefix: the ten words at
   their anchor, which follow each other's in a text and so keep neighbours
   together, or with them the first half or all of the window's words, the more
   the more often the anchor occurs, so that a group fits a task's memory. Equal
   suffixes that meet in one map task are merged first: all but the smallest
   document's are marked there and only those of the smallest one travel, so a
   passage that a third of all documents hold sends a few rows per task.
3. *Subtrees.* A group sorts its suffixes by the tree's edges (the anchor's words,
   then the window's first and second half, compared by 64-bit hashes of words that
   another seed hashes than the anchors') and reads
   the tree off the sorted order: neighbours that agree on all edges hang below
   one internal node of depth 50 or more. Those deep nodes' suffixes repeat; the
   ones outside the node's smallest document are marked.

Marked windows that follow each other add up to the maximal repeats.

Defined results: a null text has no words; a text of fewer words than a window
repeats nothing; rows that repeat an id count as one document for the order (a
window that only they share stays in each); a null id sorts before all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm._bytes import Words, gram_hashes, mix, span_hashes, words
from faultline.llm._shared import slices, stored, utf8

#: Words of an anchor, the shortest prefix that groups are made of.
PREFIX = 10
#: An anchor that occurs more often has its suffixes dealt by half a window too, by a whole one from eight times as often.
OFTEN = 20_000
#: Suffix records that a group should hold.
GROUP = 400_000

_NO_ID = -(1 << 63)
_RECORD = np.dtype([("k", "<u8"), ("e1", "<u8"), ("e2", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("pos", "<i4")])


def _windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Words]:
    """Of all windows: text, first word in the text, first word in the batch, anchor hash; and the batch's words."""
    found = words(texts)
    h = found.mixed_hashes(1)
    if len(h) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), found
    grams = gram_hashes(h, PREFIX)
    owner = found.owner()
    at = np.flatnonzero(owner[: len(h) - window + 1] == owner[window - 1:])
    span = window - PREFIX + 1
    least = np.empty(len(h) - window + 1, np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    for a in range(0, len(least), 1 << 16):
        least[a: a + (1 << 16)] = view[a: a + (1 << 16)].min(axis=1)
    return owner[at], at - found.first[owner[at]], at, least[at], found


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(gram, doc, row): the distinct anchors of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                text, _, _, least, _ = _windows(utf8(part.column("text")), window)
                keep = np.ones(len(text), bool)
                keep[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
                text, least = text[keep], least[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least.view(np.int64)), part.column("doc").take(pa.array(text)), part.column("row").take(pa.array(text))], ["gram", "doc", "row"])

    return docs.mapInArrow(run, "gram long, doc long, row int").distinct()


def _sort(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The records in the tree's order, and for each the first position of its deepest node's run."""
    records = records[np.lexsort((records["pos"], records["doc"], records["e2"], records["e1"], records["k"]))]
    new = np.ones(len(records), bool)
    if len(records) > 1:
        a, b = records[1:], records[:-1]
        new[1:] = (a["k"] != b["k"]) | (a["e1"] != b["e1"]) | (a["e2"] != b["e2"])  # the common prefix is shorter than a window
    return records, np.maximum.accumulate(np.where(new, np.arange(len(records)), 0))


def _marks(records: np.ndarray, repeated: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(doc, row, positions) of the repeated records."""
    records = records[repeated]
    records = records[np.lexsort((records["pos"], records["row"], records["doc"]))]
    cut = np.flatnonzero((records["doc"][1:] != records["doc"][:-1]) | (records["row"][1:] != records["row"][:-1])) + 1
    return [(int(x["doc"][0]), int(x["row"][0]), x["pos"].tobytes()) for x in np.split(records, cut) if len(x)]


def _deal(records: np.ndarray, level: np.ndarray, groups: int) -> np.ndarray:
    """The group of each record, by the prefix that its level asks for."""
    key = mix(records["k"] ^ np.uint64(7))  # anchors have small hashes
    key[level > 0] = mix(key[level > 0] ^ mix(records["e1"][level > 0] + np.uint64(1)))
    key[level > 1] = mix(key[level > 1] ^ mix(records["e2"][level > 1] + np.uint64(2)))
    return ((key >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int32)


_DEALT = "grp int, doc long, row int, blob binary"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) if found else [(), (), (), ()]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["grp", "doc", "row", "blob"])


def _suffixes(docs: DataFrame, window: int, groups: int) -> DataFrame:
    """Records of the suffixes by group, and marks (doc is set) of those that a smaller document repeats in the same task."""
    middle = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = utf8(part.column("text"))
                text, pos, at, least, found = _windows(texts, window)
                h = found.mixed_hashes(2)
                lists = part.column("grams")
                owner = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                flat = lists.flatten()
                gram, level = flat.field("gram").to_numpy().view(np.uint64), flat.field("level").to_numpy()
                # A window goes on if its anchor is in its row's list.
                by = mix(gram ^ mix(owner.astype(np.uint64)))
                order = np.argsort(by)
                by = by[order]
                want = mix(least ^ mix(text.astype(np.uint64)))
                where = np.minimum(np.searchsorted(by, want), max(0, len(by) - 1))
                keep = by[where] == want if len(by) else np.zeros(len(want), bool)
                text, pos, at, least, level = text[keep], pos[keep], at[keep], least[keep], level[order][where[keep]] if len(by) else np.zeros(0, np.int32)
                if not len(at):
                    continue
                records = np.empty(len(at), _RECORD)
                records["k"] = least
                records["e1"] = span_hashes(h, at, at + middle, 4)
                records["e2"] = span_hashes(h, at + middle, at + window, 5)
                records["doc"] = part.column("doc").to_numpy()[text]
                records["row"] = part.column("row").to_numpy()[text]
                records["pos"] = pos
                grp = _deal(records, level, groups)
                deal = np.lexsort((records["pos"], records["doc"], records["e2"], records["e1"], records["k"]))
                records, head = _sort(records)
                grp = grp[deal]
                repeated = records["doc"] > records["doc"][head]
                found = [(int(mix(np.array([d], np.int64).view(np.uint64))[0] % np.uint64(groups)), d, r, b) for d, r, b in _marks(records, repeated)]
                records, grp = records[~repeated], grp[~repeated]
                order = np.argsort(grp, kind="stable")
                records, grp = records[order], grp[order]
                cut = np.flatnonzero(grp[1:] != grp[:-1]) + 1
                starts = np.concatenate(([0], cut))
                found += [(int(grp[a]), None, None, x.tobytes()) for a, x in zip(starts.tolist(), np.split(records, cut))]
                yield _rows(found)

    return docs.mapInArrow(run, _DEALT)


def _subtree(table: pa.Table) -> pa.Table:
    """The marks of one group: of its deep nodes' suffixes, and those it was sent."""
    sent = table.filter(pa.compute.is_valid(table.column("doc")))
    blobs = table.filter(pa.compute.is_null(table.column("doc"))).column("blob").to_pylist()
    records, head = _sort(np.frombuffer(b"".join(blobs), _RECORD))
    found = [(0, d, r, b) for d, r, b in _marks(records, records["doc"] > records["doc"][head])]
    return pa.concat_tables([sent, pa.Table.from_batches([_rows(found)])]).select(["doc", "row", "blob"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            out = []
            for text, blobs, window in zip(utf8(part.column("text")), part.column("blobs").to_pylist(), part.column("width").to_pylist()):
                found = text.split()  # at ASCII white space, as bytes
                spans = []
                if blobs:
                    at = np.sort(np.frombuffer(b"".join(blobs), np.int32))
                    cut = np.flatnonzero(np.diff(at) > window) + 1
                    spans = [{"start": int(x[0]), "end": int(x[-1]) + window} for x in np.split(at, cut)]
                kept, last = [], 0
                for x in spans:
                    kept += found[last: x["start"]]
                    last = x["end"]
                kept += found[last:]
                out.append((len(found), spans, b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array([x[2] for x in out], pa.string())], ["doc_id", "n_words", "removed", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, removed, kept_text): a row for each row of ``docs`` without
    the words of every window whose word sequence also starts in a document with
    a smaller id. ``removed`` has the maximal word spans that went."""
    if window < PREFIX + 2:
        raise ValueError(f"a window has at least {PREFIX + 2} words")
    # The texts meet the anchors and then the marks in the same order, so Spark shuffles them once for both.
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.col(text_col).alias("text")).select(
        "doc", F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("row"), "text")
    anchors = stored(_anchors(texts, window), "anchors")
    shared = anchors.groupBy("gram").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most").select(
        "gram", ((F.col("n") > OFTEN).cast("int") + (F.col("n") > 8 * OFTEN).cast("int")).alias("level"))
    repeated = stored(anchors.join(shared, "gram").groupBy("doc", "row").agg(F.collect_list(F.struct("gram", "level")).alias("grams")), "shared-anchors")
    #: an anchor stands for about twenty suffixes
    total = 20 * (repeated.agg(F.sum(F.size("grams"))).first()[0] or 0)
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // GROUP)
    marks = _suffixes(texts.join(repeated, ["doc", "row"]), window, groups).groupBy("grp").applyInArrow(
        _subtree, "doc long, row int, blob binary").groupBy("doc", "row").agg(F.collect_list("blob").alias("blobs"))
    return texts.join(marks, ["doc", "row"], "left").select(
        F.when(F.col("doc") != _NO_ID, F.col("doc")).alias("doc_id"), "text", "blobs", F.lit(window).alias("width")).mapInArrow(
        _finish, "doc_id long, n_words long, removed array<struct<start:int,end:int>>, kept_text string")
