"""Personal data by weak supervision.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers
that a strict pattern and its check accept. Beside them a looser set of
candidates is cut out: what a strict pattern matched but its check refused,
addresses spelled out ("name at host dot org"), phone numbers without a country
code, and IPv6 addresses. Labelers vote yes, no or nothing on every span:
patterns and checks (strict pattern, checksum or range), gazetteers (top-level
domains, calling codes, card issuers, address blocks), and context (words of
the kind, or of another use, before the span; letters or digits that run on
around it).

Expectation-maximisation over the votes of all spans of a kind estimates, for
each labeler, how often it votes what on true and on false spans, and from that
each span's probability. With those as soft labels a logistic span classifier
is trained on what the span itself looks like and its votes. Base spans always
stay; a candidate is added if the classifier gives it at least one half.

Votes and looks are small whole numbers, so all spans of the corpus reach the
driver as counts of their distinct combinations (under 4 * 3**5 * 96 rows).

Defined results: a null text is empty and has no spans; a kind without any span
trains nothing; repeated rows each give a row, a null id stays null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm._shared import slices, stored

KINDS = ("email", "ip", "card", "phone")
#: Weight of the classifier's penalty.
RIDGE = 0.02

# Gazetteers.
DOMAINS = set("com org net edu gov mil int info biz io co de fr es it uk us eu nl be at ch pl pt se no dk fi ie ru cn jp kr in br mx ar ca au nz za".split())
CALLING = ("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
           "212 213 216 218 220 221 234 254 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 420 421 852 880 886 961 962 965 966 971 972 974").split()
WORDS = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|write|reach)\b"),
    "ip": re.compile(r"(?i)\b(ip|ipv[46]|address|host|server|client|from)\b"),
    "card": re.compile(r"(?i)\b(card|visa|mastercard|amex|credit|debit|payment|pay)\b"),
    "phone": re.compile(r"(?i)\b(tel|phone|telephone|call|fax|mobile|cell|whatsapp)\b"),
}
OTHER = re.compile(r"(?i)\b(version|ver|isbn|issn|order|invoice|sku|serial|hash|sha|build|release|page|line|chapter)\b[^a-z0-9]*$")

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits fails or matches as a whole, so trying it once, from its start, finds the same leftmost matches.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
_IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_SPELLED = re.compile(r"(?: at | ?\(at\) ?| ?\[at\] ?)([A-Za-z0-9-]{1,63}(?:(?: dot | ?\(dot\) ?| ?\[dot\] ?|\.)[A-Za-z0-9-]{1,63}){1,5})")
_DOT = re.compile(r" dot |\(dot\)|\[dot\]|\(at\)|\[at\]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address has one @, and the parts before different ones don't overlap:
    from each @ the longest local part leftwards gives the leftmost matches in linear time."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _HOST.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base): base spans and candidates, in order."""
    out: list[tuple[int, int, int, bool]] = [(0, a, b, True) for a, b in _emails(text)]
    if "." in text:
        out += [(1, m.start(), m.end(), all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")))
                for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m[0])
            if 12 <= len(d) <= 19:
                out.append((2, m.start(), m.end(), luhn(d)))
    if "+" in text:
        out += [(3, m.start(), m.end(), True) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    more = [(3, m.start(), m.end()) for m in _LOCAL_PHONE.finditer(text)]
    if text.count(":") >= 7:
        more += [(1, m.start(), m.end()) for m in _IPV6.finditer(text)]
    if _DOT.search(text):
        for m in _SPELLED.finditer(text):
            start = m.start()
            while start > 0 and m.start() - start < 64 and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                more.append((0, start, m.end()))
    if more:
        taken: dict[int, list[int]] = {}
        for kind in {k for k, _, _ in more}:
            taken[kind] = sorted(x for k, a, b, _ in out if k == kind for x in (a, b))
        for kind, a, b in more:
            # free if no border of a found span lies inside, and it lies inside none
            i = bisect_left(taken[kind], a)
            if i % 2 == 0 and (i == len(taken[kind]) or taken[kind][i] >= b):
                out.append((kind, a, b, False))
    return sorted(out, key=lambda x: (x[1], x[0]))


def _votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, int, int, int, int]:
    """Of each labeler 1 (yes), -1 (no) or 0 (nothing): pattern, check, gazetteer, context, neighbours."""
    s = text[start:end]
    before = text[max(0, start - 48): start]
    pattern = 1 if base else (0 if kind in (0, 3) or ":" in s else -1)
    d = _digits(s)
    if kind == 0:
        check = 1 if "@" in s else 0
        gazetteer = 1 if re.split(r"[.\])]| ", s)[-1].lower() in DOMAINS else -1
    elif kind == 1:
        parts = s.split(".")
        check = 1 if base or ":" in s else -1
        first = int(parts[0][:9]) if ":" not in s else 1
        gazetteer = 0 if ":" in s else 1 if 1 <= first <= 223 and not any(len(x) > 1 and x[0] == "0" for x in parts) else -1
    elif kind == 2:
        check = 1 if luhn(d) else -1
        issuer = d[0] == "4" or "51" <= d[:2] <= "55" or d[:2] in ("34", "37", "65") or d[:4] == "6011" or "2221" <= d[:4] <= "2720"
        gazetteer = 1 if issuer and len(d) in (13, 15, 16, 19) else -1
    else:
        check = 1 if 10 <= len(d) <= 13 else -1
        gazetteer = 0 if s[0] != "+" else 1 if any(d.startswith(x) for x in CALLING) else -1
    context = 1 if WORDS[KINDS[kind]].search(before) else -1 if OTHER.search(before) else 0
    sides = (text[start - 1: start] or " ") + (text[end: end + 1] or " ")
    neighbours = -1 if any(c.isalnum() or c in "_" for c in sides) else 1 if sides.isspace() else 0
    return pattern, check, gazetteer, context, neighbours


def _look(text: str, kind: int, start: int, end: int) -> int:
    """What a span looks like, as one number: separators, length, letters, what it starts with."""
    s = text[start:end]
    parts = min(3, len(re.findall(r"[ .()\-]+", s)))
    return parts + 4 * min(3, (end - start) // 8) + 16 * (0 if s[0].isalpha() else 1 if s[0].isdigit() else 2) + 48 * any(c.isalpha() for c in s)


def _code(votes: tuple[int, ...]) -> int:
    n = 0
    for v in votes:
        n = 3 * n + v + 1
    return n


def described(text: str) -> list[tuple[int, int, int, bool, int, int]]:
    """(kind, start, end, base, votes, look) of each span."""
    return [(k, a, b, base, _code(_votes(text, k, a, b, base)), _look(text, k, a, b)) for k, a, b, base in spans(text)]


_SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,votes:int,look:int>>"


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, spans) with their votes and looks."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("look", pa.int32())]))
    names = ("kind", "start", "end", "base", "votes", "look")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [[dict(zip(names, x)) for x in described(t or "")] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, spans {_SPAN}")


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern (rows of -1, 0, 1; n: how many spans have
    it), and per labeler P(no, yes | false, true), by expectation-maximisation."""
    p = 1 / (1 + np.exp(-votes.sum(axis=1)))  # majority
    rates = np.full((votes.shape[1], 2, 2), 0.5)
    for _ in range(rounds):
        w = np.stack([n * (1 - p), n * p])
        prior = (w.sum(axis=1) + 1) / (n.sum() + 2)
        logs = np.repeat(np.log(prior)[None], len(n), axis=0)
        for i in range(votes.shape[1]):
            no, yes = votes[:, i] < 0, votes[:, i] > 0  # a labeler that doesn't vote says nothing
            rates[i] = np.stack([w[:, no].sum(axis=1), w[:, yes].sum(axis=1)], axis=1) + [[1.0, 0.5], [0.5, 1.0]]
            rates[i] /= rates[i].sum(axis=1, keepdims=True)
            logs += np.where(no[:, None], np.log(rates[i][:, 0]), np.where(yes[:, None], np.log(rates[i][:, 1]), 0.0))
        p = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
    return p, rates


def _features(votes: np.ndarray, look: np.ndarray) -> np.ndarray:
    """One column for each value of each vote and of each part of the look."""
    columns = [np.ones(len(look))]
    columns += [(votes[:, i] == v).astype(float) for i in range(votes.shape[1]) for v in (-1, 1)]
    for base, size in ((1, 4), (4, 4), (16, 3), (48, 2)):
        columns += [((look // base) % size == v).astype(float) for v in range(1, size)]
    return np.stack(columns, axis=1)


def _logistic(x: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x.T * (n * q * (1 - q) + 1e-9)) @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (n * (p - q)) - RIDGE * w)
        w += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(found: DataFrame) -> dict[tuple[int, int, int], float]:
    """The classifier's probability for each (kind, votes, look) that occurs in the corpus."""
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.look").agg(F.count(F.lit(1)).alias("n")).collect()
    by: dict[int, list] = defaultdict(list)
    for r in sorted(rows):
        by[r.kind].append(r)
    out = {}
    for kind, own in by.items():
        votes = np.array([[(r.votes // 3 ** (4 - i)) % 3 - 1 for i in range(5)] for r in own])
        n, look = np.array([r.n for r in own], float), np.array([r["look"] for r in own])
        p, _ = reliabilities(votes, n)
        x = _features(votes, look)
        q = 1 / (1 + np.exp(-np.clip(x @ _logistic(x, p, n), -30, 30)))
        out |= {(kind, r.votes, r["look"]): float(v) for r, v in zip(own, q)}
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): of each row its base spans and the added ones, as (kind,
    start, end, base, score), by start and kind; code points, end exclusive."""
    found = stored(_found(docs, id_col, text_col), "spans")
    model = train(found)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own in batch.column("spans").to_pylist():
                kept = [(s, model[s["kind"], s["votes"], s["look"]]) for s in own]
                rows.append([{"kind": KINDS[s["kind"]], "start": s["start"], "end": s["end"], "base": s["base"], "score": p} for s, p in kept if s["base"] or p >= 0.5])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")


def redacted(text: str, accept: Callable[[int, int, int], bool]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind."""
    out, last, until = [], 0, 0
    for kind, a, b, base, votes, look in described(text):
        if not (base or accept(kind, votes, look)):
            continue
        if a >= until:
            out += [text[last:a], f"[{KINDS[kind].upper()}]"]
        until = last = max(until, b)
    return "".join(out) + text[last:]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all found spans replaced by their kinds in brackets; a null text stays null."""
    model = train(stored(_found(docs, id_col, text_col), "spans"))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [None if t is None else redacted(t, lambda *key: model.get(key, 0.0) >= 0.5) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def joined(spans: list[dict]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))))


def digests(found: DataFrame) -> DataFrame:
    """Per row of :func:`find`, the base spans' counts and digest, and all spans joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("spans").to_pylist()
            base = [[s for s in own if s["base"]] for own in rows]
            columns = [batch.column("doc_id"), *(pa.array([sum(s["kind"] == k for s in own) for own in base], pa.int64()) for k in KINDS),
                       pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own in base], pa.string()), pa.array([joined(own) for own in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
