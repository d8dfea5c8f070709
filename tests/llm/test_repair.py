import hashlib
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pytest

from rivulet.llm import repair as rp

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    """(conv, rows after damage) by the rules, in order of turn."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        code = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        mine = out.setdefault(conv, [])
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        mine += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in out.items()}


def brute(rows):
    """Plain search over all edits, a turn at a time, keeping the cheapest and least edits of each state."""
    faults, seen = [], set()
    for _, role, text in rows:
        ink = re.sub("[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    states = {"": (0, "", ())}  # the roles so far, as far as they matter

    def put(to, state, item):
        if state not in to or item[:2] < to[state][:2]:
            to[state] = item

    def insertions(states):
        todo = dict(states)
        for _ in range(4):
            for state, (cost, audit, lines) in list(todo.items()):
                role = "assistant" if state == "u" else "user"
                put(todo, role[0], (cost + 3, audit + "I", (*lines, role + ":")))
        return todo

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, (cost, audit, lines) in insertions(states).items():
            put(new, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            want = "assistant" if state == "u" else "user"
            put(new, want[0], (cost + 3 + more, audit + "R", (*lines, f"{want}:{text}")))
            if role[:1] == want[0] or (role[:1] == "s" and state == ""):
                put(new, role[0], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
        states = new
    cost, audit, lines = min(v for k, v in insertions(states).items() if k in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    first = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    return sorted(((c, *brute(r)) for c, r in damaged(rows).items()), key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
                   for r in df.collect()), key=str)


def made(seed, convs=60, longest=12):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(convs), None]:
        for t in range(rnd.randrange(1, longest)):
            role = rnd.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
            text = rnd.choice(["Yes.", "No!", "so\n", "Why? ", "ä", " \t", "", None, f"line {t}.", f"open {t}"])
            rows.append((c, t * rnd.choice([1, 1, 1, 2]) * 20 if rnd.random() < 0.97 else None, role, text))
    one_each = {}
    for r in rows:  # equal turns have no order of their own
        one_each.setdefault(r[:2], r)
    rows = list(one_each.values())
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(llm, seed):
    rows = made(seed)
    df = llm.createDataFrame(rows, SCHEMA)
    assert result(rp.summarise(rp.repair(rp.damage(df), copies_col="copies"))) == expected(rows)


def test_blocks_and_rules_do_not_change_results(llm):
    rows = made(5, convs=8, longest=60) + [(99, t, "user" if t % 3 else "assistant", f"t{t}." if t % 7 else "same") for t in range(300)]
    df = rp.damage(llm.createDataFrame(rows, SCHEMA))
    for more in ({"block_rows": 3}, {"block_bytes": 5}, {"rounds": 0}, {"block_rows": 7, "rounds": 9, "per_round": 1}):
        assert result(rp.summarise(rp.repair(df, copies_col="copies", **more))) == expected(rows)


def test_one_conversation_spreads_over_tasks(llm):
    df = llm.range(4000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id, '.') as text")
    pieces = rp.repair(df, block_rows=100).collect()
    assert len({p["task"] for p in pieces}) == 4 and len(pieces) >= 40
    assert sum(len(p["texts"]) for p in pieces) == 4000 and {p["cost"] for p in pieces} == {0}


def test_repeated_rows_are_one_group(llm):
    row = (1, 5, "user", "again.")
    df = llm.createDataFrame([row] * 500 + [(1, 6, "assistant", "ok.")], SCHEMA)
    (got,) = result(rp.summarise(rp.repair(df, block_rows=64)))
    assert got[1:7] == (0, 0, 499, 0, 499, 4 * 499) and got[7] == "K" + "D" * 499 + "K"


def test_repaired_turns_and_their_roles(llm):
    df = llm.createDataFrame([(1, 1, "tool", "x."), (1, 2, "assistant", "y."), (2, 1, "system", "z.")], SCHEMA)
    got = {1: [], 2: []}
    for p in sorted(rp.repair(df).collect(), key=lambda p: (p["task"], p["block"])):
        got[p["conv"]] += [p["audit"], *zip(p["roles"], p["texts"], strict=True)]
    assert "".join(x for x in got[1] if isinstance(x, str)) == "RK"
    assert [x for x in got[1] if not isinstance(x, str)] == [("user", "x."), ("assistant", "y.")]
    assert got[2] == ["D"]


def test_odd_tables(llm):
    empty = llm.createDataFrame([], SCHEMA)
    assert result(rp.summarise(rp.repair(rp.damage(empty), copies_col="copies"))) == []
    long = [(1, 0, "user", "w " * 400_000 + "."), (1, 1, "assistant", "a" * 700_000)]
    df = llm.createDataFrame([(*r, "x", 3) for r in long], SCHEMA + ", CONV string, copies int")
    got = result(rp.summarise(rp.repair(df.drop("copies"))))
    assert got == [(1, *brute([r[1:] for r in long]))]
    gone = llm.createDataFrame([(4, 1, "user", "x.", 0)], SCHEMA + ", copies int")
    assert result(rp.summarise(rp.repair(gone, copies_col="copies"))) == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_query_on_the_whole_table(llm, sf):
    rows = [tuple(r) for r in llm.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = rp.op13(llm, sf).withColumnRenamed("conv_id", "conv")
    assert result(got) == expected(rows)


def test_rewriting_keeps_the_sequence():
    rnd = np.random.default_rng(3)
    grammar = rp.Grammar()
    grammar.add([(2, 2), (4, 6)])
    grammar.add([(10, 10), (11, 3)])
    names = {10: [2, 2], 11: [4, 6], 12: [2, 2, 2, 2], 13: [4, 6, 3]}
    for _ in range(50):
        s = rnd.choice([0, 2, 3, 4, 6], 40)
        new = grammar.rewrite(s)
        assert [x for y in new.tolist() for x in names.get(y, [y])] == s.tolist()
        runs = [len(list(g)) for k, g in groupby(new.tolist()) if k == 2]
        assert all(n == 1 for n in runs)
