"""Alignment of two tokenizers' ids by the byte offsets where both end a token.

A text is encoded by both. The cumulative ends of each id list go into a
dictionary from end to index; the intersection of the two key sets, sorted, are
the offsets that both respect, and slice the id lists into groups that cover the
same bytes. A slice is expanded to links: the pairs of occurrences that end at the
same byte, which are its last ids.

A link count says how often two ids are linked in the corpus. Each task counts
its own links, Spark sums them. As two ids that end together spell, one of them, a
suffix of the other, there are at most as many linked pairs as the bytes of both
vocabularies (times the tokens that spell the same), whatever the corpus: that
table of numbers, checked against its bound, is sent to the tasks that look up
each row's links.

A: the ``tokenizers`` file on a space and the text; special tokens are plain text.
Texts of ordinary script are encoded with the same vocabulary's ranks, which
give the same ids. B: the ``sentencepiece`` model on the text, to which it adds
the space. About a megabyte of texts is aligned as one, since a text's end is a common
end; dictionaries are filled a block of bytes at a time, so a long text needs little
beside its ids.

Defined results: a null or empty text, and one whose tokens' bytes are not the
space and the text, has no tokens: zeros and an empty digest; repeated rows
each give a row and count each; a null id stays null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm._shared import slices, stored

#: Bytes whose ends are in the dictionaries at once.
BLOCK = 1 << 12
#: Distinct links that a task holds before it sends their counts on.
HELD = 1 << 20

# Where the ranks' splitting rule may know other letters, or take long.
_UNKNOWN, _RUN, _GAP = re.compile("[^\x00-\u2fff]"), 4000, re.compile(r"\s{4000}")


def _ordinary(text: str) -> bool:
    return (text.isascii() or not _UNKNOWN.search(text)) and (len(text) < _RUN or max(map(len, text.split()), default=0) < _RUN and not _GAP.search(text))


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies spell bytes: printable Latin-1
    as themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    out |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in out.values())}
    return out


class Pair:
    """Two tokenizers, and the bytes of their ids."""

    def __init__(self, bpe: str, pieces: str, ranks: str | None = None):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(bpe)
        self.slow.encode_special_tokens = True
        self.fast = None
        if ranks:
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.other = sentencepiece.SentencePieceProcessor(model_file=pieces)
        letters = byte_letters()
        size = self.slow.get_vocab_size()
        self.a = [bytes(letters[c] for c in x) if all(c in letters for c in x) else x.encode() for x in (self.slow.id_to_token(i) or "" for i in range(size))]
        self.b = []
        for i in range(self.other.get_piece_size()):
            piece = self.other.id_to_piece(i)
            self.b.append(bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode())
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in v], np.int64) for v in (self.a, self.b))

    def encode(self, text: str | None) -> tuple[np.ndarray, list[int]]:
        """Ids of both, or none if either doesn't spell the space and the text."""
        if text:
            spaced = " " + text
            want = spaced.encode("utf-8", "surrogatepass")
            if self.fast and _ordinary(text):
                a = self.fast.encode_to_numpy(spaced, disallowed_special=())
                same = self.fast.decode_bytes(a) == want
            else:
                a = np.array(self.slow.encode(spaced, add_special_tokens=False).ids, np.uint32)
                same = b"".join(map(self.a.__getitem__, a.tolist())) == want
            if same:
                b = self.other.encode(text)
                if b"".join(map(self.b.__getitem__, b)) == want:
                    return a, b
        return np.empty(0, np.uint32), []

    def names(self) -> list[str]:
        """Each id of A and of B as text inside a group, then each as the last of its side."""
        a, b = ([str(i) for i in range(len(v))] for v in (self.a, self.b))
        return [x + "," for x in a] + [x + "," for x in b] + [x + "|" for x in a] + [x + ";" for x in b]

    def most_links(self) -> int:
        """No more than so many different ids can be linked: of two that end together one spells a suffix of the other."""
        spelled_a, spelled_b = ({}, {})
        for own, v in ((spelled_a, self.a), (spelled_b, self.b)):
            for x in v:
                own[x] = own.get(x, 0) + 1
        return sum(other.get(x[i:], 0) for v, other in ((self.a, spelled_b), (self.b, spelled_a)) for x in v for i in range(len(x)))


def cuts(ends_a: np.ndarray, ends_b: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Of two rising lists of ends the indices of those in both, by dictionaries
    from end to index over one block of bytes after the other."""
    total = int(ends_a[-1]) if len(ends_a) else 0
    at_a, at_b, i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0, 0
    borders = np.arange(block, total + block, block)
    for to_i, to_j in zip(np.searchsorted(ends_a, borders, "right").tolist(), np.searchsorted(ends_b, borders, "right").tolist()):
        index_a = dict(zip(ends_a[i:to_i].tolist(), range(i, to_i)))
        index_b = dict(zip(ends_b[j:to_j].tolist(), range(j, to_j)))
        common = sorted(index_a.keys() & index_b.keys())
        at_a.append(np.fromiter(map(index_a.__getitem__, common), np.int64, len(common)))
        at_b.append(np.fromiter(map(index_b.__getitem__, common), np.int64, len(common)))
        i, j = to_i, to_j
    return np.concatenate(at_a), np.concatenate(at_b)


class Aligned(NamedTuple):
    """Texts one behind the other: a text's end is a common end, so they align as one."""

    a: np.ndarray  #: ids
    b: np.ndarray
    last_a: np.ndarray  #: of each group the indices of its last ids
    last_b: np.ndarray
    of_a: np.ndarray  #: of each text the indices of its first ids and group, and their numbers at the end
    of_b: np.ndarray
    of_group: np.ndarray


def aligned(pair: Pair, texts: list[str | None]) -> Aligned:
    encoded = [pair.encode(t) for t in texts]
    of_a, of_b = (np.cumsum([0, *(len(x[k]) for x in encoded)]) for k in (0, 1))
    a = np.concatenate([np.empty(0, np.uint32), *(x[0] for x in encoded)]).astype(np.int64)
    b = np.fromiter(chain.from_iterable(x[1] for x in encoded), np.int64, int(of_b[-1]))
    last_a, last_b = cuts(np.cumsum(pair.sizes_a[a]), np.cumsum(pair.sizes_b[b]))
    return Aligned(a, b, last_a, last_b, of_a, of_b, np.searchsorted(last_a, of_a))


def spelled(found: Aligned, names: list[str]) -> list[str]:
    """``a1,a2|b1;a3|b2,b3``: of each text the groups as text."""
    size_a, half = names.index("0,", 1), len(names) // 2
    to_a, to_b = np.append(0, found.last_a + 1), np.append(0, found.last_b + 1)
    # An id stands behind its own and the other list's earlier groups; B's behind A's of its group, too.
    place_a = np.arange(len(found.a)) + np.repeat(to_b[:-1], np.diff(to_a))
    place_b = np.arange(len(found.b)) + np.repeat(to_a[1:], np.diff(to_b))
    out = np.empty(len(found.a) + len(found.b), np.int64)
    out[place_a], out[place_b] = found.a, found.b + size_a
    out[place_a[found.last_a]] += half
    out[place_b[found.last_b]] += half
    text, at = list(map(names.__getitem__, out.tolist())), (found.of_a + found.of_b).tolist()
    return ["".join(text[i:j])[:-1] for i, j in zip(at, at[1:])]


def align(docs: DataFrame, bpe: str, pieces: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups): of each row the groups in order, each with its ids ``a`` and ``b``."""
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(bpe, pieces, ranks)
        for batch in batches:
            for part in slices(batch, "text"):
                found = aligned(pair, part.column("text").to_pylist())
                own = [{"a": x, "b": y} for x, y in zip(np.split(found.a, found.last_a + 1), np.split(found.b, found.last_b + 1))]
                rows = [own[i:j] for i, j in zip(found.of_group, found.of_group[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "groups"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, groups array<struct<a:array<int>,b:array<int>>>")


def linked(docs: DataFrame, bpe: str, pieces: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, links, times, groups_sha256), stored: of each row
    its different links as sorted numbers a * 2**32 + b, how often it has each, and the digest of its groups."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "links", "times", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(bpe, pieces, ranks)
        spelling, wide = pair.names(), len(pair.b)
        for batch in batches:
            for part in slices(batch, "text"):
                found = aligned(pair, part.column("text").to_pylist())
                n = [pa.array(np.diff(x)) for x in (found.of_a, found.of_b, found.of_group)]
                digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in spelled(found, spelling)]
                # Different links of each text: text, then link, as one number where that has 64 bits.
                links, owner = found.a[found.last_a] * wide + found.b[found.last_b], np.repeat(np.arange(part.num_rows), np.diff(found.of_group))
                span = len(pair.a) * wide
                if part.num_rows * span < 1 << 63:
                    own, times = np.unique(owner * span + links, return_counts=True)
                    owner, links = np.divmod(own, span)
                else:
                    (owner, links), times = np.unique(np.stack([owner, links]), axis=1, return_counts=True)
                edges = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)), pa.int32())
                links = (links // wide << 32) + links % wide
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (links, times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *n, *lists, pa.array(digests, pa.string())], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, links array<long>, times array<int>, groups_sha256 string"), "links")


def _flat(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False)


def link_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n, best): of each linked pair of ids how many links hold it, and
    whether no other pair of its ``b`` has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, times = np.empty(0, np.int64), np.empty(0, np.int64)

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(links), pa.array(times)], ["link", "n"])

        for batch in batches:
            links, at = np.unique(np.concatenate([links, _flat(batch, "links")]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, _flat(batch, "times")]), len(links)).astype(np.int64)
            if len(links) > HELD:
                yield sent()
                links, times = links[:0], times[:0]
        yield sent()

    counts = rows.select("links", "times").mapInArrow(run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n")).select(
        F.shiftright("link", 32).alias("a"), F.col("link").bitwiseAND((1 << 32) - 1).alias("b"), "n")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def report(docs: DataFrame, bpe: str, pieces: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): of
    each row its tokens, groups and links, how many links are among the most frequent of their
    ``b``, and the sum of their corpus-wide counts."""
    rows = linked(docs, bpe, pieces, ranks, id_col, text_col)
    counts = stored(link_counts(rows), "link-counts")
    bound, n = Pair(bpe, pieces, ranks).most_links(), counts.count()
    if n > bound:
        raise ValueError(f"{n} pairs of ids are linked, of at most {bound}")
    found = counts.select((F.shiftleft("a", 32) + F.col("b")).alias("link"), "n", "best").orderBy("link").toArrow().combine_chunks()
    columns = [found.column(c).to_numpy() for c in ("link", "n", "best")]
    sent = docs.sparkSession.sparkContext.broadcast(columns)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, counted, best = sent.value
        for batch in batches:
            at, times = np.searchsorted(links, _flat(batch, "links")), _flat(batch, "times").astype(np.int64)
            edges = np.zeros(batch.num_rows + 1, np.int64)
            np.cumsum(pa.compute.list_value_length(batch.column("links")).to_numpy(zero_copy_only=False), out=edges[1:])

            def summed(values: np.ndarray) -> pa.Array:
                total = np.zeros(len(values) + 1, np.int64)
                np.cumsum(values, out=total[1:])
                return pa.array(total[edges[1:]] - total[edges[:-1]])

            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")), summed(times * best[at]),
                                              summed(times * counted[at]), batch.column("groups_sha256")], names)

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
