"""Conversation repair against a search over all edit lists, in one row and in pieces."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from corpusloom.llm import conversations

SCHEMA = "conv_id string, turn long, role string, text string, conv string, number int, kept boolean"
ROLES, TEXTS = ["system", "user", "assistant", "tool", "", None], ["Yes.", "Yes.", "no", "No! ", " \t", "", None, "Why?\n", "é.", "So?x"]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain(rows):
    """One conversation's damaged rows: the contract, by a search in the order of (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            break
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3, audit + "I", i, roles + role[0], (*out, f"{role}:")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, out))
            if faults[i] not in ("blank", "duplicate"):
                late = 3 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + late, audit + "K", i + 1, roles + (role[:1] or "-"), (*out, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    heapq.heappush(heap, (cost + late + 3, audit + "R", i + 1, roles + to[0], (*out, f"{to}:{text}")))
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


@pytest.mark.parametrize("rows_at_once", [2048, 1, 2])
def test_repair_by_search(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(conversations, "ROWS", rows_at_once)
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "c", None]) if k % 7 == 0 else f"v{k % 60}", r.choice([None, 0, 1, 2, 3, 7]), r.choice(ROLES[: 3 + k % 4]), r.choice(TEXTS[: 4 + k % 7])) for k in range(260)]
    of = {}
    for row in rows:
        of.setdefault(row[0], [])
    for row in damage(rows):
        of[row[0]].append(row)
    given = spark.createDataFrame([(*x, "clash", 1, False) for x in rows], SCHEMA)
    got = conversations.repair(conversations.damaged(given)).collect()
    assert {x["conv"]: tuple(x)[1:] for x in got} == {k: plain(v) for k, v in of.items()} and len(got) == len(of)


def test_repair_of_nothing_and_of_extremes(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damaged(none)).count() == 0
    ends = spark.createDataFrame([("x", t, "user", "a" * n, True) for t, n in ((-(1 << 63), 3), ((1 << 63) - 1, 1 << 20))], "conv string, turn long, role string, text string, kept boolean")
    got = conversations.repair(ends).first()
    assert (got["gaps"], got["truncated"], got["cost"], got["audit"]) == ((1 << 63) - 1, 2, 8, "DD")


def test_a_long_conversation_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "ROWS", 64)
    rows = [("hot", t, ("user", "assistant")[t % 2], f"Number {t}." if t % 5 else "Again.", "", 1, True) for t in range(3000)] + [("cold", 0, "user", "Hi.", "", 1, True)]
    got = {r["conv"]: tuple(r)[1:] for r in conversations.repair(conversations.damaged(spark.createDataFrame(rows, SCHEMA))).collect()}
    monkeypatch.setattr(conversations, "ROWS", 1 << 20)
    assert got == {r["conv"]: tuple(r)[1:] for r in conversations.repair(conversations.damaged(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(got["hot"][6].replace("I", "")) == len(damage([r[:4] for r in rows if r[0] == "hot"]))
