"""Operator 11: the search against a plain dynamic programme, whole results against a plain rerun."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from floatline.llm import conversation_repair as cr

LAYOUT = "conv_id long, turn long, role string, text string, kind int, n string, copies2 int"


def least(initials, faults):
    """(cost, audit) by trying every state after every row, insertions in between."""
    def inserted(states):
        for _ in range(4):
            for s, (c, a) in list(states.items()):
                to = cr.ASSISTANT if s == cr.USER else cr.USER
                if to not in states or (c + 2, a + "I") < states[to]:
                    states[to] = (c + 2, a + "I")
        return states

    states = {cr.NOTHING: (0, "")}
    for r, f in zip(initials, faults):
        after = {}

        def reach(s, cost, audit):
            if s not in after or (cost, audit) < after[s]:
                after[s] = (cost, audit)

        for s, (c, a) in inserted(dict(states)).items():
            reach(s, c + 3, a + "D")
            if f != "x":
                more = f == "t"
                nxt = cr.ASSISTANT if s == cr.USER else cr.USER
                reach(nxt, c + 2 + more, a + "R")
                if r == "s" and s == cr.NOTHING:
                    reach(cr.SYSTEM, c + more, a + "K")
                elif r == ("a" if s == cr.USER else "u"):
                    reach(nxt, c + more, a + "K")
        states = after
    return min(v for s, v in inserted(dict(states)).items() if s in cr.ENDS)


rows_of = st.lists(st.tuples(st.sampled_from("suuaaat") | st.just(""), st.sampled_from("--tx")), min_size=1, max_size=14)


@settings(max_examples=400, deadline=None)
@given(rows_of)
def test_best_edits(rows):
    initials, faults = [r for r, _ in rows], "".join(f for _, f in rows)
    assert cr.best_edits(initials, faults) == least(initials, faults)


@settings(max_examples=200, deadline=None)
@given(rows_of, st.integers(1, 5))
def test_chained_blocks(rows, size):
    initials, faults = [r for r, _ in rows], "".join(f for _, f in rows)
    cuts = range(0, len(rows), size)
    cost, parts = cr.chain([cr.transfers(initials[i:i + size], faults[i:i + size]) for i in cuts])
    assert (cost, "".join(a for _, a in parts)) == least(initials, faults)


def test_a_long_conversation_is_solved_in_time_that_grows_with_it():
    rng = np.random.default_rng(0)
    initials, faults = list(rng.choice(list("suuaa"), 20_000)), "".join(rng.choice(list("--tx"), 20_000))
    cost, audit = cr.best_edits(initials, faults)
    assert (cost, audit) == least(initials, faults)


def plain(conversations):
    """The contract, conversation by conversation."""
    out = []
    for conv in {r[0] for r in conversations}:
        rows = []
        for _, turn, role, text in (r for r in conversations if r[0] == conv):
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind == 1:
                text = ""
            if kind == 2:
                text = "".join(c for c in text if c not in ".!?")
            if kind == 4:
                role = "user"
            rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in rows:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "-")
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in rows]
        cost, audit = least(initials, ["x" if f in "bd" else f for f in faults]) if rows else (0, "")
        kept = list(cr.apply_edits([r[1] for r in rows], [r[2] for r in rows], cr.NOTHING, audit))
        final = "".join(r[:1] for r, _ in kept)
        assert final.removeprefix("s").replace("ua", "") == "" and final != "s"
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], LAYOUT)
    got = [tuple(r) for r in cr.conversation_repair(df, cr.damaged(df)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    return df


def random_rows(seed, conversations, longest):
    rng = np.random.default_rng(seed)
    rows = []
    for conv in range(conversations):
        for _ in range(rng.integers(1, longest + 1)):
            role = rng.choice(["user", "assistant", "system", "tool", "", "User"])
            text = rng.choice(["Hi.", "Hi", "", " \t", "What?", "été !\x0b", "Same text.", "a.b", " "])
            turn = None if rng.random() < 0.05 else int(rng.integers(0, longest))
            rows.append((conv, turn, None if rng.random() < 0.05 else str(role), None if rng.random() < 0.05 else str(text)))
    return rows


@pytest.mark.parametrize("block_rows", [1024, 3])
def test_whole_results(spark, monkeypatch, block_rows):
    monkeypatch.setattr(cr, "BLOCK_ROWS", block_rows)
    rows = random_rows(1, 60, 9)
    rows += [(None, 0, "user", "Hello."), (None, None, None, None), (None, 3, "assistant", "Yes.")]
    rows += [(900, 5, "user", "again.")] * 40 + [(901, i, "user", "hot.") for i in range(300)]
    rows += [(902, 2, "assistant", "x" * 200_000 + "!"), (903, -(1 << 40), "user", "far."), (903, 1 << 40, "user", "away.")]
    rows += random_rows(2, 1, 200)
    check(spark, rows)


def test_every_row_dropped_and_empty_table(spark):
    dropped = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    check(spark, [(7, dropped, "user", "Hi.")])
    check(spark, [])


def test_repaired_rows_are_those_digested(spark, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK_ROWS", 4)
    rows = random_rows(3, 20, 12)
    df = check(spark, rows)
    damaged = cr.damaged(df)
    found = {}
    for r in cr.repaired_rows(damaged).orderBy("conv_id", "pid", "seq", "place").collect():
        found.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in cr.conversation_repair(df, damaged).collect():
        assert hashlib.sha256("\n".join(found.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]
