"""Conversation repair against a cheapest-first search over whole scripts."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest

from mortar.llm import repair
from mortar.llm.common import table
from mortar.llm.queries import QUERIES
from tests.conftest import SF_SMALL

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def brute(rows, entry=0, goals=(0, 3), last=True):
    """Cheapest, then ASCII-least script by Dijkstra over (cost, script)."""
    heap, seen = [(0, "", 0, entry)], set()
    while heap:
        cost, script, i, q = heapq.heappop(heap)
        if i == len(rows) and q in goals:
            return cost, script
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i < len(rows) or last:
            for who in "ua":
                if (q, who) in NEXT:
                    heapq.heappush(heap, (cost + 3, script + "I", i, NEXT[q, who]))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 4, script + "D", i + 1, q))
            if fault != 1:
                more = 3 if fault == 2 else 0
                if (q, initial) in NEXT:
                    heapq.heappush(heap, (cost + more, script + "K", i + 1, NEXT[q, initial]))
                for who in "ua":
                    if (q, who) in NEXT:
                        heapq.heappush(heap, (cost + more + 3, script + "R", i + 1, NEXT[q, who]))
    return None


def expected(rows):
    """The contract's row for each conversation, from rows ``(conv, turn, role, text)``."""
    talks = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        show = [" " if v is None else v for v in (conv, turn, role, text)]
        kind, (role, text) = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20, show[2:]
        own = talks[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in talks.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, marks, faults = set(), [], collections.Counter()
        for _, role, text in own:
            shown = re.findall("[^\x20\x09-\x0D]", text)
            fault = 1 if not shown or (role, text) in seen else 2 if shown[-1] not in ".!?" else 0
            faults["blank" if not shown else "duplicate" if fault == 1 else "truncated" if fault else "fine"] += 1
            seen.add((role, text))
            marks.append((role[:1], fault))
        cost, script = brute(marks)
        turns = [t for t, _, _ in own if t is not None]
        at, q, lines = 0, 0, []
        for edit in script:
            force = "ua" [q == 2]
            if edit == "I":
                lines.append({"u": "user:", "a": "assistant:"}[force])
                q = NEXT[q, force]
                continue
            _, role, text = own[at]
            at += 1
            if edit == "K":
                q = NEXT[q, role[:1]]
                lines.append(f"{role}:{text}")
            elif edit == "R":
                q = NEXT[q, force]
                lines.append({"u": "user:", "a": "assistant:"}[force] + text)
        out[conv] = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     "blank": faults["blank"], "duplicate": faults["duplicate"], "truncated": faults["truncated"],
                     "illegal": sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(marks, marks[1:])),
                     "cost": cost, "audit": script, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out


def found(df):
    rows = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in df.collect()}
    return rows


def test_search_is_the_cheapest_and_least_script():
    random.seed(5)
    for _ in range(800):
        rows = [(random.choice("ssuuuaaa x"), random.choice([0, 0, 0, 1, 2])) for _ in range(random.randint(0, 9))]
        assert repair.cheapest(rows, 0, (0, 3), True) == brute(rows)
        costs, scripts, _ = repair.table_of(rows)
        for entry in range(4):
            for k in range(5):
                best = brute(rows, entry, (k,) if k < 4 else (0, 3), k == 4) or (repair.INFINITE, "")
                assert best == (costs[entry * 5 + k], scripts[entry * 5 + k])


def test_repair_of_the_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF_SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    df = QUERIES["op11_conversation_repair"](spark, SF_SMALL)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert found(df) == expected(rows)


SCHEMA = "conv_id long, turn long, role string, text string, conv string, salt int, digest string"


def edge_rows():
    random.seed(9)
    rows = [(None, 1, "user", "hi."), (None, None, None, None), (1, None, "user", None), (2, 3, "assistant", "a." * 40_000),
            (2, 3, "assistant", "a." * 40_000), (2, 9, "", "b"), (3, 0, "tool", " \t"), (4, -5, "user", "漢字。"), (4, 7, "user", "é.\u0085")]
    for turn in range(700):  # one conversation holds most rows
        rows.append((5, turn // 2, random.choice(["user", "assistant", "assistant", "system"]),
                     random.choice(["yes.", "no!", "cut", "", f"t{turn}?"])))
    rows += [(6, t, "user", "same.") for t in range(30)] + [(7, 1, "user", "same.")] * 25
    return [(*r, "x", 1, "y") for r in rows]


@pytest.mark.parametrize("piece_rows", [3, 512])
def test_repair_edges(spark, piece_rows):
    """Nulls everywhere, ties, repeats, a long text, a conversation cut into many pieces over many tasks, clashing columns."""
    rows = edge_rows()
    df = repair.repair(repair.damaged(spark.createDataFrame(rows, SCHEMA).repartition(5)), piece_rows=piece_rows)
    assert found(df) == expected([r[:4] for r in rows])


def test_repair_of_an_empty_table(spark):
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []
