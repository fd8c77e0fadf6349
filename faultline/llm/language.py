"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence add up in log space for each language:

* the text: trigrams of the page's visible bytes (markup, scripts, styles and all
  of <head>, <nav> and <footer>, the title included, cut out; a page with text only
  there has no text evidence) under each language's trigram model, learnt from all labelled
  documents and tempered, as neighbouring trigrams say much the same;
* the language that the first <html> tag with one declares, wherever in the page
  it stands outside comments, scripts and styles, and the address suffix (top-level
  domain, and the first path part where it is a language code): P(value |
  language) from grouped counts over all pages, smoothed;
* a prior of the host: its pages' languages, smoothed towards its domain's, and
  those towards all pages'. These are grouped aggregates of the pages' text
  languages; a page's own vote is taken out of its host's and domain's counts.

Models are languages times ``BUCKETS`` numbers; priors stay in Spark, and a host with a third
of all pages is one row that joins them.

Defined results: null or empty markup has no text and declares nothing; a null address
has the host '' and no suffix; pages without any evidence get the most common language;
languages are those of the labelled documents (null ones are ignored), without any of which
every language is null; ties go to the language first in code point order; repeated rows
each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm._bytes import BY_LETTERS, mix, pieces
from faultline.llm._shared import slices, stored, utf8

BUCKETS = 1 << 16
TEMPER = 0.1
#: Pages' worth of the wider prior in the narrower one; counts added to each value of a language.
PRIOR = 5.0
SMOOTH = 1.0

#: Elements that go with what they hold, and their ends.
_OPEN = re.compile(r"(?ia)<(script|style|nav|footer|head)\b")
_CLOSE = {name: re.compile(rf"(?ia)</{name}\s*>") for name in ("script", "style", "nav", "footer", "head")}
#: Comments, scripts and styles (unclosed ones reach to the end) and <html> tags: each match is used up, so a page is read once.
_HTML = re.compile(r"(?is)<!--(?:-?>|.*?(?:--!?>|\Z))|<(script|style)\b.*?(?:</\1\s*>|\Z)|<html\b[^>]*")
_LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")
_CODE = re.compile(r"[a-z]{2}")


def without_markup(page: str) -> str:
    """The page with a blank for each tag, comment and element that goes whole. An
    end that isn't found once isn't looked for again, so a page is read once."""
    out, last, gone, at = [], 0, set(), page.find("<")
    while at >= 0:
        end, element = -1, _OPEN.match(page, at)
        if element and (name := element[1].lower()) not in gone:
            close = _CLOSE[name].search(page, element.end())
            end = close.end() if close else -1
            gone |= set() if close else {name}
        elif "<!--" not in gone and page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            if end < 3:
                end, gone = -1, gone | {"<!--"}
        if end < 0 and ">" not in gone:
            end = page.find(">", at + 1) + 1 or -1
            gone |= set() if end > 0 else {">"}
        if end > 0:
            out += [page[last:at], " "]
            last = end
        elif ">" in gone:
            break
        at = page.find("<", max(end, at + 1))
    return "".join(out) + page[last:]


def visible(page: str) -> str:
    return markup.unescape(without_markup(page))


def declared(page: str) -> str:
    for tag in _HTML.finditer(page):
        if tag[0][:5].lower() == "<html" and (found := _LANG.search(tag[0], 5)):
            return found[1].lower()
    return ""


def address(url: str) -> tuple[str, str, str]:
    """Host, domain (its last two labels) and suffix of an address."""
    rest = url.split("://", 1)[-1]
    host, _, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].split(":")[0].split("?")[0].split("#")[0].lower().strip(".")
    labels = host.split(".")
    part = path.split("/")[0].split("?")[0].split("#")[0].lower()
    suffix = (labels[-1] if len(labels) > 1 else "") + (f"/{part}" if _CODE.fullmatch(part) else "")
    return host, ".".join(labels[-2:]), suffix


def _trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each trigram, and its text."""
    parts = [(at, of[owner]) for some, of in pieces(texts) for at, owner in [_trigrams_of(some)]]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _trigrams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    symbols = BY_LETTERS[np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)]
    ends = np.cumsum([len(x) + 1 for x in texts])
    keep = np.flatnonzero((symbols[1:] != 0) | (symbols[:-1] != 0)) + 1
    owner = np.searchsorted(ends, keep, side="left")
    s = symbols[keep].astype(np.uint64)
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = s[:-2] << np.uint64(16) | s[1:-1] << np.uint64(8) | s[2:]
    inside = owner[:-2] == owner[2:]
    return (mix(codes[inside]) % np.uint64(BUCKETS)).astype(np.int64), owner[:-2][inside]


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, and ln P(trigram bucket | language), a row per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                at, owner = _trigrams(utf8(part.column("text")))
                langs = part.column("lang").to_pylist()
                for lang in set(langs):
                    own = np.array([x == lang for x in langs])
                    sums[lang] = sums.get(lang, 0) + np.bincount(at[own[owner]], minlength=BUCKETS)
        for lang, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.full((len(langs), BUCKETS), 0.5)
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        table[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def _evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(page_id, host, domain, suffix, declared, logs, vote): of each page its text's log-likelihoods and the best of them."""
    sent = pages.sparkSession.sparkContext.broadcast(table.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = sent.value
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [x or "" for x in part.column("html").to_pylist()]
                at, owner = _trigrams([visible(x).encode() for x in texts])
                sums = np.stack([np.bincount(owner, row[at], len(texts)) for row in logs], axis=1) * TEMPER
                some = np.bincount(owner, minlength=len(texts)) > 0
                vote = np.where(some, sums.argmax(axis=1), -1)
                places = [address(x or "") for x in part.column("url").to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column("page_id"), *(pa.array([p[i] for p in places], pa.string()) for i in range(3)),
                    pa.array([declared(x) for x in texts], pa.string()), pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array(vote, pa.int32())],
                    ["page_id", "host", "domain", "suffix", "declared", "logs", "vote"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id long, host string, domain string, suffix string, declared string, logs array<double>, vote int")


def _votes(rows: DataFrame, by: str, n: int, name: str) -> DataFrame:
    """Of each value of a column, how many pages' texts vote for each language."""
    return rows.filter("vote >= 0").groupBy(by).agg(*[F.sum((F.col("vote") == i).cast("double")).alias(f"v{i}") for i in range(n)]).select(
        by, F.array(*[f"v{i}" for i in range(n)]).alias(name))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host): a row for each row
    of ``pages`` (page_id, url, html); ``docs`` (text, lang) teach the text models."""
    langs, table = learn(docs)
    n = len(langs)
    if not n:
        empty = F.lit(None).cast("string")
        return _evidence(pages, [""], np.zeros((1, BUCKETS))).select("page_id", empty.alias("lang"), F.lit(None).cast("double").alias("probability"), empty.alias("text_lang"), "declared", "host")
    rows = stored(_evidence(pages, langs, table), "page-evidence")
    total = rows.filter("vote >= 0").groupBy("vote").count().collect()  # a row per language
    base = np.ones(n)
    for r in total:
        base[r.vote] += r["count"]
    overall = F.array(*[F.lit(float(x)) for x in base / base.sum()])
    of = F.array(*[F.lit(float(x)) for x in base - 1])
    zeros = F.array(*[F.lit(0.0)] * n)
    joined = rows
    for by, name in (("host", "host_votes"), ("domain", "domain_votes"), ("declared", "declared_votes"), ("suffix", "suffix_votes")):
        joined = joined.join(_votes(rows, by, n, name), by, "left").withColumn(name, F.coalesce(name, zeros))
    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == F.col("vote")).cast("double"))
    joined = joined.withColumn("own", own)
    less = lambda name: F.zip_with(name, "own", lambda a, b: a - b)  # noqa: E731  without the page's own vote
    sum_of = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    joined = joined.withColumn("domain_votes", less("domain_votes")).withColumn("host_votes", less("host_votes"))
    joined = joined.withColumn("domain_prior", F.zip_with("domain_votes", overall, lambda v, p: (v + PRIOR * p) / (sum_of(F.col("domain_votes")) + PRIOR)))
    joined = joined.withColumn("host_prior", F.zip_with("host_votes", "domain_prior", lambda v, p: (v + PRIOR * p) / (sum_of(F.col("host_votes")) + PRIOR)))
    total_log = F.zip_with("logs", "host_prior", lambda a, b: a + F.log(b))
    for c in ("declared", "suffix"):
        # P(value | language): the value's votes of the language over all of the language's; the empty value says nothing
        less_likely = F.zip_with(less(f"{c}_votes"), of, lambda v, m: F.log((v + SMOOTH) / (m + 100 * SMOOTH)))
        total_log = F.zip_with(total_log, F.when(F.col(c) == "", zeros).otherwise(less_likely), lambda a, b: a + b)
    joined = joined.withColumn("total", total_log).withColumn("most", F.array_max("total"))
    names = F.array(*[F.lit(x) for x in langs])
    weight = sum_of(F.transform("total", lambda x: F.exp(x - F.col("most"))))
    return joined.select("page_id", F.element_at(names, F.array_position("total", F.col("most")).cast("int")).alias("lang"), (F.lit(1.0) / weight).alias("probability"),
                         F.when(F.col("vote") >= 0, F.get(names, F.col("vote"))).alias("text_lang"), "declared", "host")
