"""Conversation repair against exhaustive search and a plain dynamic program."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cadenza.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, place int, fault string"
LEGAL = re.compile(r"(s?(ua)+)?")
GAPS = ["", "u", "a", "ua", "au", "uau", "aua"]
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """(cost, audit, repaired) of the cheapest repair of a few rows, by trying all."""
    best = None
    options = []
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        more = fault == "t"
        own = [(3, "D", "", [])]
        if fault not in ("b", "d"):
            own += [(more, "K", role[:1] or "-", [f"{role}:{text}"]), (2 + more, "R", "u", [f"user:{text}"]), (2 + more, "R", "a", [f"assistant:{text}"])]
        options.append(own)
    for edits in itertools.product(*options):
        for gaps in itertools.product(GAPS, repeat=len(rows) + 1):
            roles = gaps[0] + "".join(e[2] + g for e, g in zip(edits, gaps[1:], strict=True))
            if LEGAL.fullmatch(roles):
                cost = 2 * sum(map(len, gaps)) + sum(e[0] for e in edits)
                audit = "I" * len(gaps[0]) + "".join(e[1] + "I" * len(g) for e, g in zip(edits, gaps[1:], strict=True))
                if best is None or (cost, audit) < best[:2]:
                    lines = [f"{NAMES[x]}:" for x in gaps[0]]
                    for e, g in zip(edits, gaps[1:], strict=True):
                        lines += e[3] + [f"{NAMES[x]}:" for x in g]
                    best = (cost, audit, "\n".join(lines))
    return best


def program(rows):
    """(cost, audit) by a fold over one row at a time."""

    def insert(x):
        x = dict(x)
        for _ in range(3):
            for p, q in (("e", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                if p in x:
                    x[q] = min(x.get(q, (1 << 60, "")), (x[p][0] + 2, x[p][1] + "I"))
        return x

    x = {"e": (0, "")}
    for (role, _), fault in zip(rows, faults(rows), strict=True):
        y = {}

        def go(state, cost, audit, y=y):
            y[state] = min(y.get(state, (1 << 60, "")), (cost, audit))

        for p, (cost, audit) in insert(x).items():
            go(p, cost + 3, audit + "D")
            if fault not in ("b", "d"):
                more = fault == "t"
                for name, letter, price in ((role[:1], "K", 0), ("u", "R", 2), ("a", "R", 2)):
                    if (name == "s" and p == "e" and letter == "K") or (name == "u" and p in "esa") or (name == "a" and p == "u"):
                        go(name, cost + price + more, audit + letter)
        x = y
    x = insert(x)
    return min(v for p, v in x.items() if p in "ea")


def some_rows(rnd, n):
    role = lambda: rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "usher"])
    text = lambda: rnd.choice(["Yes.", "No!", "open end", "  ", "", "Why?", "line\nend.", " \t.\x0b", f"n{rnd.randrange(99)}."])
    return [(role(), text()) for _ in range(n)]


def repaired(spark, cases, block=conversations.BLOCK):
    rows = [(c, k, *r, 1, "x") for c, rs in enumerate(cases) for k, r in enumerate(rs)]
    return {r.conv_id: r for r in conversations.repaired_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3).select("conv_id", "turn", "role", "text"), block).collect()}


def test_few_rows_against_exhaustive_search(spark):
    rnd = random.Random(4)
    cases = [some_rows(rnd, rnd.randint(1, 3)) for _ in range(60)]
    got = repaired(spark, cases)
    for c, rows in enumerate(cases):
        assert (got[c].cost, got[c].audit, got[c].repaired) == exhaustive(rows), rows


@pytest.mark.parametrize("block", [3, conversations.BLOCK])
def test_blocks_and_long_conversations(spark, block):
    rnd = random.Random(5)
    cases = [some_rows(rnd, rnd.randint(4, 40)) for _ in range(25)] + [[(rnd.choice(["user", "assistant"]), f"turn {k}.") for k in range(1500)]]
    got = repaired(spark, cases, block)
    for c, rows in enumerate(cases):
        assert (got[c].cost, got[c].audit) == program(rows)


def test_query_on_nulls_ties_and_repeats(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(c, k, *r, 1, "x") for c in range(40) for k, r in enumerate(some_rows(rnd, rnd.randint(1, 3)))]
    gone = next(c for c in range(200, 900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "dropped.", 1, "x"), (100, 1, None, None, 1, "x"), (100, None, "user", "no turn.", 1, "x"), (None, 2, "user", "no id.", 1, "x"), (None, 2, "user", "no id.", 1, "x"), (101, 5, "user", "b.", 1, "x"), (101, 5, "assistant", "a.", 1, "x"), (101, 1, "system", "s.", 1, "x"), (None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    want = {c: [] for c, *_ in rows}
    for c, turn, role, text, *_ in rows:
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[c] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = {r.conv_id: r for r in conversations.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for c, found in want.items():
        found.sort()
        turns = [t for known, t, *_ in found if known]
        pairs = [(role, text) for *_, role, text in found]
        kinds = faults(pairs)
        r = got[c]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert (r.blank, r.duplicate, r.truncated) == tuple(kinds.count(k) for k in "bdt")
        assert r.illegal == sum(x[:1] + y[:1] not in ("su", "ua", "au") for (x, _), (y, _) in itertools.pairwise(pairs))
        cost, audit, text = exhaustive(pairs) if len(pairs) <= 3 else (*program(pairs), None)
        assert (r.cost, r.audit) == (cost, audit)
        assert text is None or r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert any(not x for x in want.values())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    out = conversations.op12_conversation_repair(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:2] == ["conv_id", "gaps"]


def test_no_python_on_the_way(spark):
    plan = conversations.op12_conversation_repair(spark, "/root/testdata/sf0.001").select(F.max("audit"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
