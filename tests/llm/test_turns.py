"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from evidencespark.llm import turns
from evidencespark.llm.common import table


def cheapest(rows):
    """(cost, audit) of (initial, must be deleted, truncated) rows: uniform-cost search by (cost, audit)."""
    heap, done = [(0, "", 0, "")], set()  # of two audits of one cost for the same rows none is a prefix of the other, so the first one popped is the least
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        wanted = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 5, audit + "I", i, wanted))
        if i < len(rows):
            initial, must, cut = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if not must:
                if state == "" and initial == "s":
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, "s"))
                same = initial == wanted
                heapq.heappush(heap, (cost + (not same) + 5 * cut, audit + "RK"[same], i + 1, wanted))


def slow(rows, faults=True):
    """{conv_id: row} of (conv_id, turn, role, text) rows."""
    text = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, body in rows:
        mine = convs.setdefault(conv, [])
        fault = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20 if faults else 99
        role, body = text(role), text(body)
        body = "" if fault == 1 else re.sub("[.!?]", "", body) if fault == 2 else body
        mine += [(turn is not None, turn or 0, "user" if fault == 4 else role, body)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort()
        seen, grid, counts = set(), [], [0, 0, 0]
        for _, _, role, body in mine:
            solid = re.findall(r"[^\x20\x09-\x0D]", body)
            kind = 0 if not solid else 1 if (role, body) in seen else 2 if solid[-1] not in ".!?" else 3
            seen.add((role, body))
            if kind < 3:
                counts[kind] += 1
            grid.append((role[:1], kind < 2, kind == 2))
        cost, audit = cheapest(grid)
        kept, at, needed = [], 0, "u"
        for e in audit:
            name = {"u": "user", "a": "assistant"}[needed]
            if e == "I":
                kept.append(name + ":")
            else:
                _, _, role, body = mine[at]
                at += 1
                if e == "D":
                    continue
                kept.append(f"{role if e == 'K' else name}:{body}")
                if e == "K" and role[:1] == "s":
                    continue
            needed = "a" if needed == "u" else "u"
        numbers = [t for known, t, _, _ in mine if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(grid, grid[1:]))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def results(frame):
    rows = frame.collect()
    got = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_alignment_is_the_cheapest_and_least():
    rng = random.Random(4)
    for _ in range(3000):
        rows = [(rng.choice("suaux "), rng.random() < 0.2, rng.random() < 0.25) for _ in range(rng.randint(0, 8))]
        rows = [(i, must, cut and not must) for i, must, cut in rows]
        assert turns.repair(rows)[:2] == cheapest(rows)


def test_the_query_on_its_table(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert results(turns.repair_conversations(table(spark, sf, "conversations"), faults=True)) == slow(rows)


@pytest.mark.parametrize("whole", [256, 5])
def test_edges(spark, whole):
    """Nulls in each column, ties, repeated rows, an empty role, a long text, clashing columns; also all as long conversations."""
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    rows = [(pick(None, 1, 2, 3), pick(None, 0, 1, 2, 3, 7, 9), pick(None, "", "user", "assistant", "system", "User", "bot"), pick(None, "", " \t", "Yes.", "no", "Long? " * 3, "x\n.")) for _ in range(160)]
    rows += [(5, 0, "user", "word " * 100_000), (5, 1, "assistant", "é\x1f"), (6, None, "user", "Hi."), (7, 4, "system", "A!"), (7, 4, "system", "A!")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"copies": F.lit(3), "conv": F.lit("c"), "fault": F.lit(0)})
    for faults in (False, True):
        assert results(turns.repair_conversations(frame, faults, whole)) == slow(rows, faults)
    assert turns.repair_conversations(frame.where("conv_id < 0")).count() == 0


def test_a_conversation_longer_than_a_task_should_hold(spark):
    """1,500 turns, also with one row repeated many times, in blocks: cost, audit and hash of the whole."""
    rng = random.Random(6)
    rows = [(1, i, rng.choice(("user", "assistant", "assistant", "system")), rng.choice(("Yes.", f"Number {i}.", f"cut {i}", "", f"End {i}!"))) for i in range(1500)]
    rows += [(1, 700, "user", "Again.")] * 200 + [(2, 1, "user", "Hi."), (2, 2, "assistant", "Yes.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert results(turns.repair_conversations(frame)) == slow(rows, False)


def test_dropped_conversations_keep_their_row(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = results(turns.repair_conversations(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string"), True))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
