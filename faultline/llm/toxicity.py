"""Toxicity by class-conditional Kneser-Ney models.

The models are over symbols: a text is lower-cased, its words are runs of
letters and digits, each with a border sign. For each class (toxic, ordinary)
P(symbol | the five before it) interpolates that class's discounted counts of
six-symbol runs with a model that both classes share: the Kneser-Ney estimate
from both classes' counts together, which in turn backs off to the continuation
of the last three symbols, counted over distinct runs. What the discounts leave,
and ``STRENGTH`` counts for each five symbols, go to the shared estimate, so a rare
run says little. A run that no labelled text has still says how much of its five
symbols' weight each class leaves to the shared estimate, so every symbol has its
likelihood in both classes. Runs of six symbols also reach expressions of which
only the stem was labelled.

A word's two likelihoods are the products over all its symbols and the border
behind it. A toxic text is mostly ordinary words: each is of the toxic model with
a small probability, the share, else of the ordinary one. A text's evidence is the
difference of its log-likelihoods under that mixture and under the ordinary model,
normalised by its length, and a logistic curve of that evidence, fitted on a part of
the labelled rows that the counts don't have, gives the score. The same part of the
rows picks the share. No run, word or text is left out.

All counts are grouped sums over every labelled training row. Log ratios are a
table by exact run (and by the five symbols before, for unseen runs). The most
frequent ones, ``SENT`` at most (32 MB), are sent to the tasks; if there are more, the
words that may need one of the others (by a bitmap of fixed size, which only spares
rows) meet them by a join. Log ratios are whole multiples of a small unit, so both ways
give the same sums, in any order.

Defined results: a null or empty text (and one without letters) has evidence 0; labels
other than 0 and 1, and null ones, are not used; a label whose doc_id is null
or not in ``documents`` is not used; several labels of one id vote, a tie is no
label; without labels of both classes every score is 0; repeated rows each give
a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm._bytes import BY_LETTERS, mix, pieces, words
from faultline.llm._shared import slices, stored, utf8

ORDER = 6
#: The most log ratios that are sent to tasks (16 bytes each).
SENT = 1 << 21
#: Bits of the places in the bitmap of the others (8 MB).
PLACE = 26
#: Log ratios are whole multiples of 1 / UNIT.
UNIT = 1 << 32
FOLDS = 5
#: The absolute discount, and how many counts the shared estimate has beside a class's own.
DISCOUNT = 0.75
STRENGTH = 30.0
#: The shares to choose from: how many of a toxic text's words the toxic model writes.
SHARES = (0.1, 0.03, 0.01, 0.003, 0.001)
#: Log-likelihoods are divided by this power of the number of runs.
LENGTH = 0.5
#: Marks the five symbols before a run, which have the log ratio of unseen runs.
BEFORE = 1 << 48


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: 0 is held out, 4 calibrates, the rest is counted."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of each text, as codes, and the text of each."""
    parts = []
    for some, of in pieces(texts):
        codes, owner = _runs_of(some)
        parts.append((codes, of[owner]))
    if len(parts) == 1:
        return parts[0]
    codes, owner = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return _distinct(codes, owner)


def _distinct(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # nested, as codes and places are small numbers alike
    _, first = np.unique(mix(codes ^ mix(owner.astype(np.uint64) + np.uint64(1 << 56))), return_index=True)
    first.sort()
    return codes[first], owner[first]


def _runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each word, and the border after it, the run of six symbols
    that ends there as a 48-bit code, and its text; a text's repeated runs count
    once. Nothing before a word's own border counts (zeros), and borders between
    words count once however many signs they have."""
    symbols = BY_LETTERS[np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)]
    ends = np.cumsum([len(x) + 1 for x in texts])
    at = np.flatnonzero((symbols[1:] != 0) | (symbols[:-1] != 0)) + 1
    owner = np.searchsorted(ends, at, side="left")
    place = np.arange(len(symbols))
    depth = (place - np.maximum.accumulate(np.where(symbols == 0, place, 0)))[at]
    closing = symbols[at] == 0
    depth[closing] = (place - np.maximum.accumulate(np.where(symbols == 0, place, 0)))[at[closing] - 1] + 1
    codes = np.zeros(len(at), np.uint64)
    for i in range(ORDER):
        codes |= np.where(depth > i, symbols[np.maximum(at - i, 0)], 0).astype(np.uint64) << np.uint64(8 * i)
    return _distinct(codes, owner)


def _counts(labelled: DataFrame) -> DataFrame:
    """(run, toxic, ordinary): how often each class has each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                codes, owner = _runs(utf8(part.column("text")))
                toxic = part.column("toxic").to_numpy()[owner]
                found, at = np.unique(codes, return_inverse=True)
                hits = np.bincount(at, toxic, len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), pa.array(hits), pa.array(np.bincount(at, minlength=len(found)) - hits)], ["run", "toxic", "ordinary"])

    return labelled.select("text", "toxic").mapInArrow(run, "run long, toxic long, ordinary long").groupBy("run").agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def log_ratios(labelled: DataFrame) -> DataFrame:
    """(run, n, ratio, over): ln P(last | before, toxic) - ln P(last | before, ordinary)
    in units, of every run that a text has, and under ``BEFORE`` + the five symbols before,
    of all runs behind them that none has. ``over`` is what a run's ratio adds to that
    one, so a text's sum is over its runs and over what is before them."""
    counts = stored(_counts(labelled), "runs").withColumn("n", F.col("toxic") + F.col("ordinary")).withColumn("before", F.shiftright("run", 8))
    total = counts.agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).first()
    if not total.toxic or not total.ordinary:
        return labelled.sparkSession.createDataFrame([], "run long, n long, ratio long, over long")
    # The shared lower order: in how many distinct runs three symbols end, by interpolated discounting over those.
    tails = counts.groupBy(F.col("run").bitwiseAND(F.lit(0xFFFFFF)).alias("tail")).agg(F.count(F.lit(1)).alias("runs"))
    heads = tails.groupBy(F.shiftright("tail", 8).alias("head")).agg(F.sum("runs").alias("of"), F.count(F.lit(1)).alias("kinds"))
    low = tails.join(heads, F.shiftright("tail", 8) == F.col("head")).select(
        "tail", ((F.col("runs") - DISCOUNT + DISCOUNT * F.col("kinds") / 256) / F.col("of")).alias("low"))
    sums = [F.sum("n").alias("of"), F.count(F.lit(1)).alias("kinds")]
    for c in ("toxic", "ordinary"):
        sums += [F.sum(c).alias(f"{c}_of"), F.sum(F.least(F.col(c), F.lit(DISCOUNT))).alias(f"{c}_left")]
    shared = (F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("low")) / F.col("of")
    p, left = [], []
    for c in ("toxic", "ordinary"):
        # without a count of its own a class has the shared estimate: all weight is left to it
        left.append((F.col(f"{c}_left") + STRENGTH) / (F.col(f"{c}_of") + STRENGTH))
        p.append((F.col(c) - F.least(F.col(c), F.lit(DISCOUNT))) / (F.col(f"{c}_of") + STRENGTH) + left[-1] * F.col("shared"))
    units = lambda a, b: F.round((F.log(a) - F.log(b)) * UNIT).cast("long")
    befores = stored(counts.groupBy("before").agg(*sums).withColumn("unseen", units(*left)), "befores")
    found = counts.join(befores, "before").join(low, F.col("run").bitwiseAND(F.lit(0xFFFFFF)) == F.col("tail")).withColumn(
        "shared", shared).select("run", "n", units(*p).alias("ratio"), "unseen").select("run", "n", "ratio", (F.col("ratio") - F.col("unseen")).alias("over"))
    unseen = befores.select((F.col("before") + BEFORE).alias("run"), F.col("of").alias("n"), F.col("unseen").alias("ratio"), F.col("unseen").alias("over"))
    return stored(found.union(unseen), "log-ratios")


def _slots(runs: np.ndarray) -> np.ndarray:
    """Each run's place in the bitmap."""
    return mix(runs.astype(np.uint64)) >> np.uint64(64 - PLACE)


def _most_frequent(ratios: DataFrame, sent: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], DataFrame | None]:
    """Runs (in order) and ratios of the most frequent runs, ``sent`` at most, a bitmap of
    all others, and their table, if any. Runs as frequent as each other stay together."""
    top, rest, places = ratios, None, np.zeros(0, np.uint64)
    if ratios.count() > sent:
        # how many runs have each count: far fewer rows than runs
        ns = ratios.groupBy("n").agg(F.count(F.lit(1)).alias("runs")).toArrow()
        n, runs = (ns.column(c).to_numpy() for c in ("n", "runs"))
        order = np.argsort(-n)
        least = int(n[order[np.searchsorted(np.cumsum(runs[order]), sent, side="right")]])
        top, rest = ratios.filter(F.col("n") > least), ratios.filter(F.col("n") <= least)

        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = _slots(batch.column("run").to_numpy())
                bits = np.uint64(1) << (at & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(bits.view(np.int64))], ["place", "bits"])

        marked = rest.select("run").mapInArrow(marks, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
        places = np.zeros(1 << (PLACE - 6), np.uint64)
        places[marked.column("place").to_numpy()] = marked.column("bits").to_numpy().view(np.uint64)
    top = top.select("run", "over").toArrow()
    run = top.column("run").to_numpy()
    order = np.argsort(run)
    return (run[order].astype(np.uint64), top.column("over").to_numpy()[order], places), rest


def _words(texts: list[bytes], table: tuple[np.ndarray, np.ndarray, np.ndarray], held: bool = False) -> tuple[np.ndarray, ...]:
    """Of each text's distinct words: a hash, the text, the number of runs, the log ratio
    by the runs that were sent, and whether it may need others; with ``held`` also those
    that it may need, as runs and the place of their word."""
    runs, over, places = table
    parts, keys, at = [], [], 0
    for some, of in pieces(texts):
        found = words(some, BY_LETTERS)
        h, owner = found.mixed_hashes(), of[found.owner()]
        _, one = np.unique(h, return_index=True)
        starts, size = found.starts[one], found.ends[one] - found.starts[one] + 1  # with the border behind
        first = np.cumsum(size) - size
        own = np.repeat(np.arange(len(one)), size)
        depth = np.arange(len(own)) - first[own] + 1
        place = starts[own] + depth - 1
        codes = np.zeros(len(own), np.uint64)
        for i in range(ORDER):
            codes |= np.where(depth > i, found.symbols[np.maximum(place - i, 0)], 0).astype(np.uint64) << np.uint64(8 * i)
        before = (codes >> np.uint64(8)) + np.uint64(BEFORE)
        total, asks = np.zeros(len(own), np.int64), np.zeros(len(own), bool)
        for some_runs in (codes, before):
            where, known = _places(runs, some_runs)
            total[known] += over[where[known]]
            if len(places):
                slot = _slots(some_runs)
                ask = (places[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool) & ~known
                asks |= ask
                if held:
                    keys.append((some_runs[ask], at + own[ask]))
        sums = (np.add.reduceat(total, first), np.logical_or.reduceat(asks, first)) if len(one) else (total, asks)
        which = np.searchsorted(h[one], h)
        parts.append((h, owner, size[which], sums[0][which], sums[1][which], at + which))
        at += len(one)
    if not parts:
        parts = [tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, bool, np.int64))]
    h, owner, size, total, asks, which = (np.concatenate(x) for x in zip(*parts))
    _, one = np.unique(mix(h ^ mix(owner.astype(np.uint64) + np.uint64(1 << 56))), return_index=True)
    out = tuple(x[one] for x in (h, owner, size, total, asks))
    if not held:
        return out
    asked = [np.concatenate(x) for x in zip(*keys)] if keys else [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    return *out, which[one], *asked


def _mixed(ratio: np.ndarray, share: float) -> np.ndarray:
    """A word's evidence in units when the toxic model writes ``share`` of the words (1 or more: all), from its log ratio in units."""
    if share >= 1:
        return ratio
    return np.rint(np.logaddexp(math.log1p(-share), math.log(share) + ratio / UNIT) * UNIT).astype(np.int64)


def _places(runs: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each code its place among the runs, and whether it is one of them."""
    if not len(runs):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(runs, codes), len(runs) - 1)
    return at, runs[at] == codes


def _evidence(docs: DataFrame, ratios: DataFrame, shares: tuple[float, ...], keep: list[str], sent: int | None = None) -> DataFrame:
    """``keep`` columns, the number of runs in the distinct words, and e0, e1, ...: the
    evidence of each text by each share."""
    arrays, rest = _most_frequent(ratios, sent or SENT)
    table = docs.sparkSession.sparkContext.broadcast(arrays)
    names = [f"s{i}" for i in range(len(shares))]
    named = [*keep, "text key"] if rest is not None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, owner, size, ratio, asks = _words(utf8(part.column("text")), table.value)
                n = np.bincount(owner, size, part.num_rows).astype(np.int64)
                sums = [np.zeros(part.num_rows, np.int64) for _ in shares]
                for share, out in zip(shares, sums):
                    np.add.at(out, owner[~asks], _mixed(ratio[~asks], share))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in named), pa.array(n), *map(pa.array, sums)], [*named, "n", *names])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, owner, _, ratio, asks, place, runs, of = _words(utf8(part.column("text")), table.value, held=True)
                # each word that asks, with each run that it asks for and how often
                order = np.argsort(of, kind="stable")
                runs, of = runs[order], of[order]
                h, owner, ratio, place = h[asks], owner[asks], ratio[asks], place[asks]
                a, b = np.searchsorted(of, place), np.searchsorted(of, place, side="right")
                word = np.repeat(np.arange(len(place)), b - a)
                at = np.arange(len(word)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[word]
                # a text's key once for each of its words, so that copies of a text give the same rows
                _, one, times = np.unique(mix(runs[at] ^ mix(word.astype(np.uint64) + np.uint64(1 << 56))), return_index=True, return_counts=True)
                word, at = word[one], at[one]
                yield pa.RecordBatch.from_arrays(
                    [part.column("text key").take(pa.array(owner[word])), pa.array(h[word].view(np.int64)), pa.array(ratio[word]), pa.array(runs[at].view(np.int64)), pa.array(times)],
                    ["text key", "word", "part", "run", "times"])

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = batch.column("ratio").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("text key"), *(pa.array(_mixed(ratio, share)) for share in shares)], ["text key", *names])

    if rest is not None:
        docs = docs.withColumn("text key", F.md5("text"))
    kinds = dict(docs.dtypes)
    out = docs.select(*dict.fromkeys([*named, "text"])).mapInArrow(
        run, ", ".join([*(f"`{c}` {kinds[c]}" for c in named), "n long", *(f"{c} long" for c in names)]))
    if rest is not None:
        # A text's evidence is its own, so copies of a text share theirs.
        met = docs.filter("text is not null").select("text key", "text").mapInArrow(
            others, "`text key` string, word long, part long, run long, times long").distinct().join(rest.select("run", "over"), "run", "left")
        far = met.groupBy("text key", "word").agg((F.max("part") + F.sum(F.coalesce(F.col("over") * F.col("times"), F.lit(0)))).alias("ratio")).select(
            "text key", "ratio").mapInArrow(mixed, ", ".join(["`text key` string", *(f"{c} long" for c in names)])).groupBy("text key").agg(
            *[F.sum(c).alias(f"far {c}") for c in names])
        out = out.join(far, "text key", "left").withColumns({c: F.col(c) + F.coalesce(F.col(f"far {c}"), F.lit(0)) for c in names})
    return out.select(*keep, "n", *[(F.col(c) / F.lit(float(UNIT)) / F.pow(F.greatest("n", F.lit(1)), F.lit(LENGTH))).alias(f"e{i}") for i, c in enumerate(names)])


def _curve(rows: DataFrame) -> tuple[float, float, float]:
    """Mean loss, slope and offset of the logistic curve by Newton steps on a histogram of the evidence (4,096 bins, so bounded)."""
    seen = rows.agg(F.min("evidence").alias("a"), F.max("evidence").alias("b")).first()
    if seen.a is None:
        return 0.0, 0.0, 0.0
    width = max(seen.b - seen.a, 1e-9) / 4096
    bins = rows.groupBy(F.least(F.floor((F.col("evidence") - seen.a) / width), F.lit(4095)).alias("bin")).agg(
        F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("bin")
    x = seen.a + (bins["bin"].to_numpy(float) + 0.5) * width
    hits, n = bins["hits"].to_numpy(float), bins["n"].to_numpy(float)
    scale = math.sqrt(float((n * x * x).sum() / n.sum())) or 1.0
    x = np.column_stack([x / scale, np.ones(len(x))])
    w, penalty = np.zeros(2), np.array([1e-2, 1e-6])
    loss = lambda w: float((n * np.logaddexp(0, x @ w) - hits * (x @ w)).sum() + (penalty * w * w).sum() / 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag(penalty), x.T @ (hits - n * p) - penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return loss(w) / max(1.0, n.sum()), float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sent: int | None = None) -> tuple[DataFrame, float, float, float]:
    """The table of log ratios, the share, and the curve's slope and offset, from all labelled rows outside fold 0."""
    voted = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("mean")).filter(
        "mean <> 0.5").select("doc_id", F.round("mean").cast("int").alias("toxic"))
    # Labels grow with the input: at any size they meet the texts by a shuffle, not a broadcast.
    rows = docs.select("doc_id", "text").filter("text is not null").withColumn("fold", fold(F.col("doc_id"))).filter("fold <> 0").join(
        voted.hint("shuffle_hash"), "doc_id")
    ratios = log_ratios(rows.filter(f"fold <> {FOLDS - 1}"))
    held = stored(_evidence(rows.filter(f"fold = {FOLDS - 1}"), ratios, SHARES, ["toxic"], sent).filter("n > 0"), "calibration")
    fits = [_curve(held.select("toxic", F.col(f"e{i}").alias("evidence"))) for i in range(len(SHARES))]
    best = min(range(len(SHARES)), key=lambda i: fits[i][0])
    return ratios, SHARES[best], fits[best][1], fits[best][2]


def _scored(docs: DataFrame, labels: DataFrame, keep: list[str], sent: int | None = None) -> DataFrame:
    ratios, share, slope, offset = fit(docs, labels, sent)
    z = F.col("e0") * slope + offset
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z)))) if not ratios.isEmpty() else F.lit(0.0)
    return _evidence(docs, ratios, (share,), keep, sent).select(*keep, F.col("e0").alias("evidence"), p.alias("score"))


def score(docs: DataFrame, labels: DataFrame, sent: int | None = None) -> DataFrame:
    """(doc_id, evidence, score): a row for each row of ``docs``; the score is the
    probability of label 1. ``sent`` stands in for ``SENT``."""
    return _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, ["doc_id"], sent)


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns."""
    plain = docs.toDF(*[f"c{i}" if c != "text" else c for i, c in enumerate(docs.columns)])
    known = plain.withColumnRenamed(f"c{docs.columns.index('doc_id')}", "doc_id")
    return _scored(known, labels, known.columns).filter(F.col("score") < threshold).drop("evidence", "score").toDF(*docs.columns)
