"""Secrets: strict patterns, and strings that stay new to a primed compressor.

Base spans are assignments to a sensitive name, access keys and long lower-case
hex strings, by fixed patterns. Beside them every other string of key letters
with a sensitive word before it on its line is a candidate. Its novelty is the
number of bytes by which it makes its surroundings' compressed form longer:
zstandard, primed with a dictionary of the corpus's identifiers and with the code
around the string (other occurrences of it cut out), compresses that code with
and without the string behind it. Names, paths and phrases are mostly matches
and cost few bytes; random keys match nothing. A candidate whose cost is at
least ``NOVEL`` of its length and ``LEAST`` bytes is reported, as kind ``novel``.

The dictionary holds the identifiers that occur most often in all documents
(the letters' runs of words and names, in lower case, as all that is compressed; nothing inside a base span or candidate
counts, so a key that is copied often doesn't make itself known), up to
``PRIMED`` bytes, the most frequent last. Tasks count, Spark sums; only the top
of the list reaches the driver.

Defined results: a null or empty text has no spans; repeated rows each give a
row; a null id stays null; without any identifier the compressor is primed with
the code around alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm._shared import slices, stored

#: Base kinds in order, then the added one.
KINDS = ("assign", "access", "hex", "novel")
#: Least share of its length, and least bytes, that a candidate has to cost.
NOVEL, LEAST = 0.65, 8
#: Code points of surroundings on either side, and bytes of the dictionary.
AROUND, PRIMED = 256, 1 << 16
LEVEL = 9
#: Different identifiers that a task holds before it sends their counts on.
HELD = 1 << 17

# ---------------------------------------------------------------- fixed patterns
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # of a run of at least 32 the leftmost match is all of it

# Sensitive words, anywhere and as words of their own.
_ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
_INSIDE = (*_ASSIGNED[:4], "apikey", "_key", "passwort", "passphrase", "passcode", "pwd", "credential", "authoriz", "bearer", "signature", "session", "cookie")
_ALONE = ("auth", "key", "pin", "salt")
_STRING = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: How far before a string its sensitive word may begin.
_REACH = 64
_IDENTIFIER = re.compile(r"[^\W\d_]{3,24}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end): leftmost non-overlapping per kind, failing matches dropped."""
    out, low = [], text.lower()
    if any(x in low for x in _ASSIGNED):
        out += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def sensitive_words(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sensitive words, in any case, by end."""
    low = text.lower()
    if len(low) != len(text):  # some letter is longer in lower case: places have to be the text's
        low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    out = []
    for word in (*_INSIDE, *_ALONE):
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            if word not in _ALONE or not (low[at - 1: at].isalnum() or low[at - 1: at] == "_" or low[end: end + 1].isalnum() or low[end: end + 1] == "_"):
                out.append((at, end))
            at = low.find(word, end)
    return sorted(out, key=lambda x: x[1])


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end): strings of key letters with a digit or both cases, behind a
    sensitive word on their line, that touch no base span."""
    words = sensitive_words(text)
    if not words:
        return []
    ends = [b for _, b in words]
    out = []
    for m in _STRING.finditer(text):
        a, b = m.start(), m.end()
        i = bisect_right(ends, a) - 1
        if i < 0 or words[i][0] < a - _REACH or "\n" in text[words[i][1]: a]:
            continue
        s = m[0]
        if s.strip("=-_+/").isalpha() and (s.islower() or s.isupper() or s.istitle()) or not any(c.isalnum() for c in s):
            continue
        out.append((a, b))
    return _apart(out, [(x, y) for _, x, y in base])


def _apart(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of sorted spans those that meet none of the taken ones."""
    merged: list[list[int]] = []
    for x, y in sorted(taken):
        if merged and x < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], y)
        else:
            merged.append([x, y])
    edges = [z for x in merged for z in x]
    out = []
    for a, b in found:
        i = bisect_right(edges, a)
        if i % 2 == 0 and (i == len(edges) or edges[i] >= b):
            out.append((a, b))
    return out


class Novelty:
    """The bytes that a string adds to its surroundings' compressed form."""

    def __init__(self, dictionary: bytes):
        import zstandard

        primed = None
        if len(dictionary) >= 8:
            primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def size(self, code: str) -> int:
        return len(self.compressor.compress(code.lower().encode("utf-8", "surrogatepass")))

    def cost(self, text: str, start: int, end: int) -> int:
        own = text[start:end]
        around = (text[max(0, start - AROUND): start] + "\n" + text[end: end + AROUND]).replace(own, "") + "\n"
        return self.size(around + own) - self.size(around)


def found_spans(text: str, novelty: Novelty) -> list[dict]:
    """Base spans and novel strings by start, then kind."""
    base = base_spans(text)
    out = [{"kind": KINDS[k], "start": a, "end": b, "base": True, "cost": None} for k, a, b in base]
    for a, b in candidates(text, base):
        cost = novelty.cost(text, a, b)
        if cost >= max(LEAST, NOVEL * (b - a)):
            out.append({"kind": "novel", "start": a, "end": b, "base": False, "cost": cost})
    return sorted(out, key=_order)


def _order(span: dict) -> tuple[int, int]:
    return span["start"], KINDS.index(span["kind"])


def _outside(text: str) -> Iterator[str]:
    """The text without base spans and candidates."""
    base = base_spans(text)
    last = 0
    for a, b in sorted([(a, b) for _, a, b in base] + candidates(text, base)):
        if a > last:
            yield text[last:a]
        last = max(last, b)
    yield text[last:]


def identifiers(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each identifier occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                for part in _outside(text.as_py() or ""):
                    counts.update(_IDENTIFIER.findall(part.lower()))
                if len(counts) > HELD:
                    yield sent()
                    counts.clear()
        yield sent()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, text_col: str = "text") -> bytes:
    """The most frequent identifiers, up to ``PRIMED`` bytes, the most frequent last."""
    words = stored(identifiers(docs, text_col).filter("n > 1"), "identifiers")
    most = PRIMED // 4  # the shortest word and its line end
    # A task would send its own top of the list: first find the count, in eighths of a power of two, that few enough reach.
    step = F.floor(F.log2("n") * 8).cast("int")
    bins, reached, least = words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect(), 0, 0
    for r in bins:
        least, reached = r.step, reached + r.words
        if reached >= most:
            break
    top = words.filter(step >= least).orderBy(F.desc("n"), "word").limit(most).collect()
    out, size = [], 0
    for r in top:
        word = r.word.encode()
        size += len(word) + 1
        if size > PRIMED:
            break
        out.append(word)
    return b"\n".join(reversed(out))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("cost", pa.int32())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): of each row its base spans and novel strings, as (kind,
    start, end, base, cost) by start and kind; code points, end exclusive. ``cost``
    is the marginal compressed bytes of a novel string."""
    primed = dictionary(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(primed)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [found_spans(t or "", novelty) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, _SPANS)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean,cost:int>>")


def joined(spans: list[dict]) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of the rows of :func:`find`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("spans").to_pylist()
            base = [[s for s in own if s["base"]] for own in rows]
            columns = [batch.column("doc_id"), *(pa.array([sum(s["kind"] == k for s in own) for own in base], pa.int64()) for k in KINDS[:3]),
                       pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own in base], pa.string()), pa.array([joined(own) for own in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS[:3]), "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS[:3]) + ", base_sha256 string, spans string")
