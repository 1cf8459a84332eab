"""Conversation repair against exhaustive dynamic programming over all edits."""

import hashlib
import random
import zlib
from itertools import product

import pytest

from tideline.llm import conversations as conv

DATA = "/root/testdata/sf0.001"
BLANK = " \t\n\v\f\r"


def best_by_force(marks):
    """Least (cost, edits) over every sequence of edits with at most two insertions in a row."""
    ways = {"start": (0, "")}

    def insert(ways):
        for _ in range(2):
            for at, (cost, edits) in list(ways.items()):
                to = "a" if at == "u" else "u"
                ways[to] = min(ways.get(to, (1e9, "")), (cost + 2, edits + "I"))
        return ways

    for initial, fault in marks:
        new = {}

        def go(to, cost, edits):
            new[to] = min(new.get(to, (1e9, "")), (cost, edits))

        for at, (cost, edits) in insert(ways).items():
            go(at, cost + 3, edits + "D")
            if fault < 2:
                go("a" if at == "u" else "u", cost + 2 + fault, edits + "R")
                if initial == "s" and at == "start" or initial == "u" and at != "u" or initial == "a" and at == "u":
                    go(initial, cost + fault, edits + "K")
        ways = new
    return min(insert(ways).get(end, (1e9, "")) for end in ("start", "a"))


def test_search_is_the_exhaustive_best_on_all_short_sequences():
    kinds = list(product("suax", range(3)))
    for n in range(4):
        for marks in product(kinds, repeat=n):
            assert conv.search(list(marks)) == best_by_force(marks)


@pytest.mark.parametrize("weights", [(1, 1, 1, 1), (5, 1, 1, 0), (0, 1, 9, 0), (9, 1, 1, 1), (0, 0, 0, 1)])
def test_search_on_long_sequences(weights):
    rng = random.Random(sum(weights))
    for n in (30, 400):
        marks = [(rng.choices("suax", weights)[0], rng.choices(range(3), (6, 2, 1))[0]) for _ in range(n)]
        assert conv.search(marks) == best_by_force(marks)


def expected(rows):
    """Contract columns of conversations from their damaged rows, in plain Python."""
    out = {}
    groups = {}
    for c, turn, role, text in rows:
        key, role, text = c, " " if role is None else role, " " if text is None else text
        groups.setdefault(key, [])
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
        role = "user" if fault == 4 else role
        groups[key] += [(turn, role, text)] * (2 if fault == 3 else 1)
    for c, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marks, n = set(), [], [0, 0, 0]
        for _, role, text in group:
            fault = 0 if not text.strip(BLANK) else 1 if (role, text) in seen else 2 if text.rstrip(BLANK)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            marks.append((role[:1], 0 if fault is None else 1 if fault == 2 else 2))
        cost, audit = best_by_force(marks)
        rows_, at, last = [], 0, ""
        for e in audit:
            last_role = "assistant" if last == "u" else "user"
            if e == "I":
                rows_.append(f"{last_role}:")
                last = last_role[0]
                continue
            _, role, text = group[at]
            at += 1
            if e != "D":
                name = role if e == "K" else last_role
                rows_.append(f"{name}:{text}")
                last = name[0]
        turns = {r[0] for r in group if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        out[c] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(rows_).encode()).hexdigest())
    return out


def result(spark, rows, **bounds):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, cost int, audit string")
    found = conv.digests(conv.repair(conv.damaged(table), every=table.select("conv_id"), **bounds)).collect()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: tuple(r[c] for c in names) for r in found}


def hard_rows():
    rng = random.Random(7)
    roles = ["user", "assistant", "system", "tool", "", None, "ünder"]
    texts = ["Fine.", "fine", "", None, " \v\t", "One two!\n", "é?  ", "x" * 5000, "a.b", " "]
    rows = []
    for c in [*range(40), None]:
        for _ in range(rng.choice([1, 1, 2, 5, 9, 40, 90])):
            rows.append((c, rng.choice([None, *range(30)]), rng.choice(roles[: rng.choice([2, 3, 7])]), rng.choice(texts)))
    return rows + [(77, t, "user", "same text") for t in range(60)] + [(78, 5, "user", "same text")] * 60


@pytest.mark.parametrize("bounds", [{}, {"piece": 4, "hot_rows": 3}, {"piece": 32, "chars": 3000}])
def test_conversations_by_force(spark, bounds):
    rows = hard_rows()
    assert result(spark, rows, **bounds) == expected(rows)


def test_given_conversations_and_none(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(spark, rows) == expected(rows)
    assert result(spark, []) == {}
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert result(spark, [(dropped, 0, "user", "x")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
