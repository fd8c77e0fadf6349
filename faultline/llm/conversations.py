"""Repair of broken conversations by scalar big-integer weights.

A conversation's rows, in order of turn, are edited to read like a dialogue:
role initials ``(s?(ua)+)?``. Keeping a row costs 0, giving it the role user or
assistant 1, deleting it 2 (which blank rows and duplicates need), inserting an
empty user or assistant row 5; a truncated row that stays adds 5. An audit is
the initials of the edits in order (``D``, ``I``, ``K``, ``R``). Of the cheapest
audits the least in ASCII is taken.

One integer decides both: its high digits carry the cost, and its low digits,
of a fixed number, are the audit's letters from the left, with zeros behind the
last one. An edit adds its cost above and its letter at the next place, and the
path of least integer through the graph of (row, grammar state) is the repair.
Of two paths into a node that cost the same, neither audit begins with the
other (it would hold more insertions), so the least one stays the least
whatever follows.

So a conversation need not be in one task: rows are sorted into ranges, each
run of at most ``2**CHUNK_BITS`` rows gives the least integers from each of the four
states to each, and up to ``FAN`` neighbouring runs at a time are joined until a
conversation has one. Only an audit as such is whole in a task, and the repaired
rows pass through one in order, a batch at a time, since their digest is that of
one long string.

Defined results: a null role or text is one space; null turns come first; rows
of one turn come by role and text; equal rows follow each other; a null id is
a conversation of its own; a conversation without rows needs no edits; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.llm._shared import stored

REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: A run has up to 2**CHUNK_BITS rows (equal ones as one); FAN runs are joined at a time.
CHUNK_BITS, FAN = 9, 64
SPACES = " \t\n\x0b\x0c\r"
#: Grammar states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: From a state by a role's initial.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ADJACENT = ("su", "ua", "au")

Entry = tuple[int, str]  # cost and audit


def damage(convs: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): ``convs`` with faults put in by the CRC-32 of
    ``conv_id:turn`` modulo 20 (nulls are one space): 0 drops a row, 1 empties its text, 2 removes
    the full stops, exclamation and question marks, 3 repeats the row, 4 makes its role user."""
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                        (F.crc32(F.concat(conv, F.lit(":"), turn)) % 20).alias("fault")).filter("fault <> 0")
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       F.explode(times).alias("copy")).drop("copy")


def examined(convs: DataFrame) -> DataFrame:
    """(conv_id, at, turn, role, text, n, fault), stored: every row with its place and
    its first fault (blank, duplicate, truncated or none). ``at`` grows along a
    conversation. Equal rows of a turn are one row and their number ``n``; all but
    the first are duplicates, or blank if it is."""
    rows = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    equal = stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("digest", F.sha2("text", 256)), "conversation-rows")
    # Role and text of several turns: all but the first are duplicates.
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = equal.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("turns")).filter("turns > 1").select(
        F.col("conv_id").alias("of"), F.col("role").alias("of_role"), F.col("digest").alias("of_digest"), "first")
    met = equal.join(again, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest")), "left")
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    fault = (F.when(last == "", "blank").when(F.col("first").isNotNull() & ~place.eqNullSafe(F.col("first")), "duplicate")
             .when(~last.isin(".", "!", "?"), "truncated").otherwise(""))
    ranged = met.select("conv_id", "turn", "role", "text", "n", fault.alias("fault")).repartitionByRange(
        "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return stored(ranged.withColumn("at", F.monotonically_increasing_id()), "examined")


def _symbol() -> Column:
    """What the repair sees of a row: its initial, as a capital if it is truncated,
    or ``x`` if it has to go, and the number of its copies, if any."""
    initial = F.left("role", F.lit(1))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    one = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return F.concat(one, F.when(F.col("n") > 1, (F.col("n") - 1).cast("string")).otherwise(""))


def _least(found) -> dict[int, tuple[int, int]]:
    """Of (state, (integer, letters)) the least integer of each state."""
    out: dict[int, tuple[int, int]] = {}
    for state, value in found:
        if state not in out or value < out[state]:
            out[state] = value
    return out


def _entry(value: tuple[int, int] | None, width: int) -> Entry | None:
    if value is None:
        return None
    cost, letters = divmod(value[0], 1 << (8 * width))
    return cost, letters.to_bytes(width, "big").rstrip(b"\0").decode("ascii")


def run_table(symbols: str) -> tuple[Entry | None, ...]:
    """For a run of rows, as comma-joined symbols, the cheapest, then ASCII-least
    audit from each state to each state: entry 4 * from + to, None where no edits
    lead there. Copies are deleted right behind their row: an insertion between
    them costs the same behind them, where its audit is less."""
    rows = [(x[0], int(x[1:] or 0)) for x in symbols.split(",")] if symbols else []
    width = 3 * len(rows) + 2 + sum(n for _, n in rows)  # letters: a row's, two insertions around each, deletions of copies
    cost_unit = 1 << (8 * width)

    def edit(value: tuple[int, int], letters: str, cost: int) -> tuple[int, int]:
        total, k = value
        return total + cost * cost_unit + (int.from_bytes(letters.encode("ascii"), "big") << (8 * (width - k - len(letters)))), k + len(letters)

    def inserted(at: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
        for _ in range(2):
            at = _least([*at.items(), *((STEPS[s, r], edit(v, "I", INSERT)) for s, v in at.items() for r in "ua" if (s, r) in STEPS)])
        return at

    out: list[Entry | None] = []
    for start in range(4):
        at = inserted({start: (0, 0)})
        for symbol, copies in rows:
            found = [(s, edit(v, "D", DELETE)) for s, v in at.items()]
            if symbol != "x":
                more = CUT_SHORT if symbol.isupper() else 0
                for s, v in at.items():
                    if (s, symbol.lower()) in STEPS:
                        found.append((STEPS[s, symbol.lower()], edit(v, "K", more)))
                    found += [(STEPS[s, r], edit(v, "R", REROLE + more)) for r in "ua" if (s, r) in STEPS]
            at = _least(found)
            if copies:
                at = {s: edit(v, "D" * copies, DELETE * copies) for s, v in at.items()}
            at = inserted(at)
        out += [_entry(at.get(end), width) for end in range(4)]
    return tuple(out)


def joined_tables(tables: list[list[Entry | None]]) -> list[Entry | None]:
    """The table of runs that follow each other."""
    if len(tables) == 1:
        return tables[0]
    width = sum(max((len(e[1]) for e in t if e), default=0) for t in tables)
    cost_unit = 1 << (8 * width)
    out: list[Entry | None] = []
    for start in range(4):
        at: dict[int, tuple[int, int]] = {start: (0, 0)}
        for t in tables:
            own = [e and (e[0] * cost_unit, int.from_bytes(e[1].encode("ascii"), "big"), len(e[1])) for e in t]
            at = _least((end, (total + e[0] + (e[1] << (8 * (width - k - e[2]))), k + e[2]))
                        for s, (total, k) in at.items() for end in range(4) if (e := own[4 * s + end]))
        out += [_entry(at.get(end), width) for end in range(4)]
    return out


_TABLE = "conv_id long, run long, entries array<struct<cost:long,audit:string>>"
_ENTRIES = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))


def _tables(part: pa.RecordBatch, tables) -> pa.RecordBatch:
    rows = [[e and {"cost": e[0], "audit": e[1]} for e in t] for t in tables]
    return pa.RecordBatch.from_arrays([part.column("conv_id"), part.column("run"), pa.array(rows, _ENTRIES)], ["conv_id", "run", "entries"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    solve = lru_cache(maxsize=1 << 12)(run_table)  # short conversations are often alike
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            yield _tables(part, [solve(s) for s in part.column("symbols").to_pylist()])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1)
            yield _tables(part, [joined_tables([[e and (e["cost"], e["audit"]) for e in t["entries"]] for t in own]) for own in part.column("tables").to_pylist()])


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, cost, audit) of the conversations of :func:`examined`."""
    runs = rows.select("conv_id", "at", _symbol().alias("symbol")).groupBy("conv_id", F.shiftright("at", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), ",").alias("symbols"))
    number = (F.row_number().over(Window.partitionBy("conv_id").orderBy("chunk")) - 1).cast("long")
    at = stored(runs.select("conv_id", number.alias("run"), "symbols").mapInArrow(_solved, _TABLE), "runs")
    most = at.agg(F.max("run")).first()[0] or 0
    while most:
        near = at.groupBy("conv_id", F.floor(F.col("run") / FAN).cast("long").alias("of")).agg(F.array_sort(F.collect_list(F.struct("run", "entries"))).alias("tables"))
        at = stored(near.select("conv_id", F.col("of").alias("run"), "tables").mapInArrow(_met, _TABLE), "runs")
        most //= FAN
    # What was nothing before may stay nothing, or end with an answer.
    best = F.array_min(F.filter(F.array(F.col("entries")[4 * START + START], F.col("entries")[4 * START + ASSISTANT]), lambda e: e.isNotNull()))
    return at.select("conv_id", best.alias("best")).select("conv_id", "best.cost", "best.audit")


class _Reading:
    """A conversation's rows read along its audit, in order."""

    def __init__(self, conv_id: int | None, cost: int, audit: str):
        self.conv_id, self.cost, self.audit = conv_id, cost, audit
        self.k, self.state, self.out, self.sha, self.previous = 0, START, 0, hashlib.sha256(), None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns: list[int] = []  # first, last, and how many different
        self.kept: list[tuple] = []

    def _keep(self, edit: str, turn: int | None, role: str | None, text: str) -> None:
        if role is None:
            role = "assistant" if self.state == USER else "user"
        self.state = STEPS.get((self.state, role[:1]), self.state)
        self.sha.update((("\n" if self.out else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.kept.append((self.conv_id, self.out, edit, turn, role, text))
        self.out += 1

    def insertions(self) -> None:
        while self.audit[self.k: self.k + 1] == "I":
            self.k += 1
            self._keep("I", None, None, "")

    def row(self, turn: int | None, role: str, text: str, n: int, fault: str) -> None:
        if fault:
            self.counts[fault] += 1
        self.counts["blank" if fault == "blank" else "duplicate"] += n - 1
        initial = role[:1]
        self.counts["illegal"] += (self.previous is not None and self.previous + initial not in ADJACENT) + (n - 1) * (initial + initial not in ADJACENT)
        self.previous = initial
        if turn is not None and not (self.turns and self.turns[1] == turn):
            self.turns = [self.turns[0] if self.turns else turn, turn, self.turns[2] + 1 if self.turns else 1]
        self.insertions()
        edit = self.audit[self.k: self.k + 1]
        if edit != "D":
            self._keep(edit, turn, role if edit == "K" else None, text)
        self.k += n

    def taken(self) -> list[tuple]:
        """What was kept since the last call."""
        out, self.kept = self.kept, []
        return out

    def digest(self) -> tuple:
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return self.conv_id, gaps, *self.counts.values(), self.cost, self.audit, self.sha.hexdigest()


def _along(convs: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of each conversation in order, headed by its audit; a conversation of
    ``convs`` without rows has an empty one."""
    none = lambda kind: F.lit(None).cast(kind)
    names = ["conv_id", "at", "turn", "role", "text", "n", "fault", "cost", "audit"]
    body = rows.select("conv_id", "at", "turn", "role", F.when(~F.col("fault").isin("blank", "duplicate"), F.col("text")).alias("text"), "n", "fault",
                       none("long").alias("cost"), none("string").alias("audit"))
    heads = found.select("conv_id", F.lit(-1).cast("long").alias("at"), none("long").alias("turn"), *(none("string").alias(c) for c in ("role", "text")),
                         none("long").alias("n"), none("string").alias("fault"), "cost", "audit")
    empty = convs.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(
        "conv_id", F.lit(-2).cast("long").alias("at"), none("long").alias("turn"), *(none("string").alias(c) for c in ("role", "text")),
        none("long").alias("n"), none("string").alias("fault"), F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    return body.unionByName(heads).unionByName(empty).select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "at")


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Reading, bool]]:
    """Each conversation as it is read: after every slice of rows, and once more at its end."""
    now: _Reading | None = None
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            for row in batch.slice(i, 256).to_pylist():
                if now is None or row["at"] == -2 or row["conv_id"] != now.conv_id:
                    if now is not None:
                        now.insertions()
                        yield now, True
                    now = _Reading(row["conv_id"], row["cost"], row["audit"])
                elif row["at"] == -1:
                    now.cost, now.audit = row["cost"], row["audit"]
                else:
                    now.row(row["turn"], row["role"], row["text"], row["n"], row["fault"])
            if now is not None:
                yield now, False
    if now is not None:
        now.insertions()
        yield now, True


def repair(convs: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the rows of the repaired
    conversations, in order of ``place`` from 0. ``edit`` is K, R or I; an
    inserted row has no turn."""
    rows = examined(convs)
    names = ["conv_id", "place", "edit", "turn", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reading, _ in _readings(batches):
            if kept := reading.taken():
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept), kinds)], names)

    return _along(convs, rows, audits(rows)).mapInArrow(run, "conv_id long, place long, edit string, turn long, role string, text string")


def report(convs: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) of each conversation of ``convs``, and of those that only
    ``whole`` has as empty ones."""
    rows = examined(convs)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for reading, over in _readings(batches):
            reading.taken()
            if over:
                done.append(reading.digest())
            if len(done) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    schema = ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds))
    return _along(whole if whole is not None else convs, rows, audits(rows)).mapInArrow(run, schema)
