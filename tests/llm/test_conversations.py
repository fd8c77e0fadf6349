import hashlib
import itertools
import random
import zlib

from hypothesis import given, settings, strategies as st

from faultline.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if f == 0:
            continue
        if f == 1:
            text = ""
        if f == 2:
            text = "".join(c for c in text if c not in ".!?")
        if f == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if f == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        own = text.strip(SPACE)
        out.append("blank" if not own else "duplicate" if (role, text) in seen else "truncated" if own[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def by_hand(rows):
    """The cheapest, then least audit over (cost, audit) pairs, a row at a time; insertions until nothing is better."""
    found = faults(rows)
    states = {("", ()): (0, "")}

    def insert(at):
        at, todo = dict(at), list(at.items())
        while todo:
            (s, made), (cost, audit) = todo.pop()
            for r in "ua":
                if (s, r) in NEXT and cost < 60:
                    key, value = (NEXT[s, r], ()), (cost + 5, audit + "I")
                    if key not in at or value < at[key]:
                        at[key] = value
                        todo.append((key, value))
        return at

    states = insert(states)
    for (_, _, role, _), fault in zip(rows, found):
        new = {}
        for (s, made), (cost, audit) in states.items():
            options = [(s, cost + 2, audit + "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                options += [(NEXT[s, r], cost + 1 + more, audit + "R") for r in "ua" if (s, r) in NEXT]
                if (s, role[:1]) in NEXT:
                    options.append((NEXT[s, role[:1]], cost + more, audit + "K"))
            for t, c, a in options:
                if (t, ()) not in new or (c, a) < new[t, ()]:
                    new[t, ()] = c, a
        states = insert(new)
    return min(v for (s, _), v in states.items() if s in ("", "a"))


def exhaustive(rows):
    """Every audit with up to three insertions, by trying all."""
    found, best = faults(rows), None
    n = len(rows)
    for gaps in itertools.product(range(3), repeat=n + 1):
        if sum(gaps) > 3:
            continue
        for edits in itertools.product("DKR", repeat=n):
            letters = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))
            s, cost, at = "", 0, 0
            for e in letters:
                if e == "I":
                    cost += 5
                    s = {"": "u", "s": "u", "a": "u", "u": "a"}[s]
                    continue
                (_, _, role, _), fault = rows[at], found[at]
                at += 1
                if e == "D":
                    cost += 2
                    continue
                cost += (e == "R") + 5 * (fault == "truncated")
                r = role[:1] if e == "K" else {"u": "a"}.get(s, "u")
                if fault in ("blank", "duplicate") or (s, r) not in NEXT:
                    break
                s = NEXT[s, r]
            else:
                if s in ("", "a") and (best is None or (cost, letters) < best):
                    best = cost, letters
    return best


def expected(rows, ids):
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for conv in ids:
        own = sorted(by.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit = by_hand(own)
        left, s, repaired = list(own), "", []
        for e in audit:
            row = left.pop(0) if e != "I" else None
            if e == "D":
                continue
            role = row[2] if e == "K" else "assistant" if s == "u" else "user"
            s = role[:1]
            repaired.append(f"{role}:{row[3] if row else ''}")
        initials = [r[2][:1] for r in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def symbols(rows):
    out = []
    for (_, _, role, _), fault in zip(rows, faults(rows)):
        known = role[:1] if role[:1] in ("s", "u", "a") else "o"
        out.append("x" if fault in ("blank", "duplicate") else known.upper() if fault == "truncated" else known)
    return out


def best(table):
    return min(e for e in (table[0], table[3]) if e)


ROWS = st.lists(st.tuples(st.just(1), st.just(0), st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["a.", "b!", "c", "", " ", "d?"])), max_size=9)


@settings(max_examples=60, deadline=None)
@given(ROWS.map(lambda r: r[:4]))
def test_integers_decide_as_trying_all_edits(rows):
    assert best(C.run_table(",".join(symbols(rows)))) == exhaustive(rows)


@settings(max_examples=300, deadline=None)
@given(ROWS, st.lists(st.integers(0, 9), max_size=3))
def test_runs_join_to_the_whole(rows, cuts):
    own = symbols(rows)
    edges = [0, *sorted(min(c, len(own)) for c in cuts), len(own)]
    tables = [list(C.run_table(",".join(own[a:b]))) for a, b in zip(edges, edges[1:])]
    assert best(C.joined_tables(tables)) == best(C.run_table(",".join(own))) == by_hand(rows)
    assert C.joined_tables(tables) == list(C.run_table(",".join(own)))


def test_copies_are_deleted_behind_their_row():
    for n in (1, 2, 5):
        for before, own, after in itertools.product(["", "u", "a", "S"], ["u", "A", "x", "o"], ["", "a", "u", "U"]):
            spelled = ",".join(filter(None, [before, own, *["x"] * n, after]))
            assert C.run_table(",".join(filter(None, [before, f"{own}{n}", after]))) == C.run_table(spelled)


SCHEMA = "conv_id long, turn long, role string, text string, at long, n long, cost long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7) for r in rows], SCHEMA)


def check(spark, rows, damage):
    convs = frame(spark, rows)
    seen = damaged(rows) if damage else [(a, b, " " if c is None else c, " " if d is None else d) for a, b, c, d in rows]
    found = C.report(C.damage(convs) if damage else convs, convs).collect()
    want = expected(seen, {r[0] for r in rows})
    assert len(found) == len(want)
    for r in found:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id
    return want


def made(rng, convs, longest):
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][t % 2]
            if t == 0 and rng.random() < 0.3:
                role = "system"
            rows.append((c, t if rng.random() < 0.9 else t + 2, rng.choice([role, role, role, None, "tool", ""]) if rng.random() < 0.1 else role,
                         rng.choice([f"text {rng.randrange(4)}.", "one", None, "", "Ü?\n", "a b!"])))
    return rows


def test_report_against_plain_python(spark):
    rng = random.Random(3)
    rows = made(rng, 60, 12) + [(None, None, "user", "x."), (None, 3, None, None), (None, None, "user", "x."), (99, None, "assistant", "y " * 5000), (98, 0, "user", "a.")] + [(97, 5, "user", "same.")] * 40
    rng.shuffle(rows)
    check(spark, rows, damage=True)
    check(spark, rows, damage=False)


def test_long_conversation_in_many_runs(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_BITS", 2)
    monkeypatch.setattr(C, "FAN", 2)
    rng = random.Random(4)
    check(spark, [(1, t, rng.choice(["user", "assistant", "assistant"]), rng.choice(["a.", "b", "", f"{t}!"])) for t in range(150)] + made(rng, 5, 9), damage=False)


def test_repaired_rows_are_what_the_digest_says(spark):
    convs = frame(spark, made(random.Random(6), 25, 9))
    want = {r.conv_id: r.repaired_sha256 for r in C.report(convs).collect()}
    got = {}
    for r in sorted(C.repair(convs).collect(), key=lambda r: (r.conv_id, r.place)):
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.edit in "KRI" and (r.turn is None) <= (r.edit == "I")
    assert {c: hashlib.sha256("\n".join(got.get(c, [])).encode()).hexdigest() for c in want} == want


def test_empty_table(spark):
    none = frame(spark, [(1, 1, "user", "x.")]).filter("conv_id = 0")
    assert C.report(C.damage(none), none).count() == 0 and C.repair(none).count() == 0
