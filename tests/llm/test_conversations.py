from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from dossier.llm import conversations as C
from dossier.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, audit int, piece string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if fault == 3 else 1)
    return out


def brute(rows):
    """(cost, audit, repaired) by trying all edits, shortest paths with whole audits."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        if not body:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif body[-1] not in ".!?":
            faults.append("truncated")
        else:
            faults.append("")
        seen.add((role, text))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def more(found):
        # insertions, cheapest first, until nothing gets better
        found, changed = dict(found), True
        while changed:
            changed = False
            for state, (cost, audit, lines) in list(found.items()):
                for initial, to in step[state].items():
                    if initial != "s":
                        new = (cost + 5, audit + "I", (*lines, (names[initial], "")))
                        if to not in found or new[:2] < found[to][:2]:
                            found[to], changed = new, True
        return found

    def offer(found, state, new):
        if state not in found or new[:2] < found[state][:2]:
            found[state] = new

    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        # insertions kept apart by start, so that no better start hides an audit that comes first later
        for state, way in best.items():
            for at, (cost, audit, lines) in more({state: way}).items():
                offer(after, at, (cost + 2, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                extra = 5 if fault == "truncated" else 0
                if role[:1] in step[at]:
                    offer(after, step[at][role[:1]], (cost + extra, audit + "K", (*lines, (role, text))))
                for initial in "ua":
                    if initial in step[at]:
                        offer(after, step[at][initial], (cost + 1 + extra, audit + "R", (*lines, (names[initial], text))))
        best = after
    ends = [more({s: w}).get(e) for s, w in best.items() for e in ("", "a")]
    cost, audit, lines = min(e for e in ends if e)
    return faults, cost, audit, lines


def expected(conv, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))
    faults, cost, audit, lines = brute(rows) if rows else ([], 0, "", ())
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    text = "\n".join(f"{r}:{t}" for r, t in lines)
    count = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (conv, gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


@pytest.fixture(scope="module")
def rows():
    rnd, out = random.Random(6), []
    for conv in range(400):
        for turn in range(rnd.choice([1, 2, 3, 4, 5, 8, 13])):
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.2 else ("user", "assistant")[turn % 2]
            if turn == 0 and rnd.random() < 0.3 or rnd.random() < 0.03:
                role = "system"
            out.append((conv, turn + rnd.choice([0, 0, 0, 7]), role, rnd.choice(["Yes.", "No!", "and so", " \t", "Why? ", f"Line {turn}.", "été."])))
    out += [(1000, t, rnd.choice(["user", "assistant", "tool", "", "agent", None]), rnd.choice([None, "", "Ok.", "é"])) for t in [None, None, 3, 3, 3, 9]]
    out += [(None, t, "user", "Hm.") for t in (None, 1, 2)] + [(1001, 5, "user", "word " * 50_000 + "end.")]
    out += [(1002, None, "assistant", "Yes.")] * 3
    # one conversation of a third of all rows, over several pieces
    out += [(77, t, ("user", "assistant")[t % 2], rnd.choice(["Yes.", "No!", f"Line {t}.", "so"])) for t in range(20, 900)]
    return out


def compare(spark, rows, parts):
    frame = spark.createDataFrame([(*r, 3, "x") for r in rows], SCHEMA).repartition(parts)
    got = C.digests(C.repaired(queries.damaged(frame)))
    found = {tuple(r) for r in got.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    want = {expected(conv, kept) for conv, kept in damage(rows).items()}
    assert found == want
    assert got.count() == len(want)


def test_equals_all_edits(spark, rows):
    compare(spark, rows, 5)


def test_pieces_do_not_matter(spark, rows, monkeypatch):
    monkeypatch.setattr(C, "PIECE_ROWS", 16)
    compare(spark, rows, 3)


def test_empty_table_and_dropped_conversations(spark):
    assert C.digests(C.repaired(queries.damaged(spark.createDataFrame([], SCHEMA)))).count() == 0
    gone = [(c, 0, "user", "Hi.") for c in range(3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert len(gone) > 50
    compare(spark, gone, 2)


def test_long_stretch_equals_one_walk():
    """10,000 rows: the states found are those of a walk with whole audits."""
    rnd = np.random.default_rng(9)
    types = rnd.integers(0, 12, 10_000)
    padded = np.concatenate([types, np.full(16_384 - len(types), C.NO_ROW)])
    tables = C.levels(C.COST[padded][None], C.ORDER[padded][None])
    end, cost = C.ends(tables[-1][0][:, 0], tables[-1][1][:, 0])
    before, behind = C.crossings(tables, np.zeros(1, dtype=np.int64), end)
    audit = "".join(C.TABLES[t][p][q][1] for t, p, q in zip(types, before[0], behind[0], strict=False)) + C.TAIL[end[0]]
    best = {0: (0, "")}
    for t in types.tolist():
        after = {}
        for state, (paid, letters) in best.items():
            for to, edit in enumerate(C.TABLES[t][state]):
                if edit:
                    new = (paid + edit[0], letters + edit[1])
                    after[to] = min(after.get(to, new), new)
        best = after
    assert min((paid + 5 * len(C.TAIL[s]), letters + C.TAIL[s]) for s, (paid, letters) in best.items()) == (cost[0], audit)


def test_real_outputs(spark):
    turns = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello."), (1, 3, "user", "Hi."), (1, 4, "user", "Why?"), (1, 5, "assistant", "So.")]
    frame = spark.createDataFrame([(*t, True) for t in turns], "conv_id long, turn long, role string, text string, present boolean")
    row = C.repaired(frame).first()
    _, cost, audit, lines = brute([t[1:] for t in turns])
    assert (row["cost"], row["audit"]) == (cost, audit) and [tuple(t) for t in row["repaired"]] == list(lines)
    assert audit == "KKRDKK" and lines[2] == ("assistant", "Hello.")
