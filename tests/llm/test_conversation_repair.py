"""Operator 11 against a search by whole labels, in pieces of every size, and odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from tickframe.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, codes string, cost string"
BLANK = re.compile("^[\x20\x09-\x0d]*$")


def cheapest(rows):
    """rows of (role, text, fault): cost, audit and repaired lines by a search over whole labels (cost, audit)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        right = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        given = right[-1]
        name = "user" if given == "u" else "assistant"
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                if role[:1] and role[0] in right:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, given, (*out, f"{name}:{text}")))
        heapq.heappush(heap, (cost + 3, audit + "I", i, given, (*out, f"{name}:")))
    raise AssertionError


def expected(table):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in table:
        by[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        by[conv] += [(turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in by.items():
        rows.sort()
        seen, faults = set(), []
        for *_, role, text in rows:
            body = text.strip(" \t\n\r\x0b\x0c")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for known, t, *_ in rows if known]
        cost, audit, lines = cheapest([(r[3], r[4], f) for r, f in zip(rows, faults, strict=True)])
        illegal = sum(a[3][:1] + b[3][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(rng, convs, longest):
    rows = []
    for conv in [*range(convs), None]:
        for _ in range(rng.randint(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ümlaut"])
            rows.append((conv, rng.choice([None, *range(longest)]), role, rng.choice(["a.", "b!", "c", "", None, " \t", "é?", "d. ", "x\ny."]), "z", "z"))
    return rows


@pytest.mark.parametrize(("size", "seed"), [(512, 1), (1, 2), (2, 3), (5, 4)])
def test_repairs_equal_a_search_by_labels(spark, size, seed):
    table = made(random.Random(seed), 40, 24)
    frame = spark.createDataFrame(table, SCHEMA).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(frame, repair.Repair(piece_rows=size)).collect()}
    want = expected(table)
    assert got.keys() == want.keys()
    for conv, row in want.items():
        assert got[conv] == row, conv


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(9)
    table = [(7, t, rng.choice(["user", "assistant"]), f"t{rng.randint(0, 300)}.", "", "") for t in range(3000)] + made(rng, 5, 6)
    frame = spark.createDataFrame(table, SCHEMA).repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(frame, repair.Repair(piece_rows=100)).collect()}
    assert got == expected(table)


def test_solve_finds_the_least_audit_between_all_states():
    rng = random.Random(3)
    for _ in range(400):
        codes = "".join(rng.choices("suaxSUAX-", k=rng.randint(0, 7)))
        rows = [({"s": "system", "u": "user", "a": "assistant", "x": "x", "-": "user"}[c.lower()], "t", "blank" if c == "-" else "truncated" if c.isupper() else None) for c in codes]
        assert repair.solve(codes, repair.START, None) == cheapest(rows)[:2]


def test_no_rows_and_long_texts(spark):
    assert repair.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    table = [(1, t, "user" if t % 2 == 0 else "assistant", "wort " * 50_000 + f"{t}.", "", "") for t in range(6)]
    frame = spark.createDataFrame(table, SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(frame, repair.Repair(piece_bytes=300_000)).collect()}
    assert got == expected(table)


def test_given_conversations(spark):
    from tickframe.llm.queries import op11_conversation_repair

    folder = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in op11_conversation_repair(spark, folder).collect()}
    assert got == expected(table)
