from __future__ import annotations

import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from platewise.llm import conversation_repair as cr

WHITE = " \t\n\x0b\x0c\r"
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def fault_of(role, text, seen):
    bare = text.rstrip(WHITE)
    return "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""


def uniform_cost(rows):
    """Dijkstra over (cost, edits): the cheapest repair, of several the least string. Rows are (role, text, fault)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, edits, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, edits, out
        if (i, q) in done:
            continue
        done.add((i, q))
        to, name = (3, "assistant") if q == 2 else (2, "user")
        heapq.heappush(heap, (cost + 3, edits + "I", i, to, (*out, (name, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            late = 3 * (fault == "truncated")
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, q, out))
            if fault not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + 3 + late, edits + "R", i + 1, to, (*out, (name, text))))
                if (q, role[:1]) in KEEP:
                    heapq.heappush(heap, (cost + late, edits + "K", i + 1, KEEP[q, role[:1]], (*out, (role, text))))


def expected(rows):
    """Of (turn, role, text, present) rows of one conversation."""
    shown = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x, present in rows if present), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, judged = set(), []
    for _, role, text in shown:
        judged.append((role, text, fault_of(role, text, seen)))
        seen.add((role, text))
    turns = [t for t, _, _ in shown if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
    cost, edits, out = uniform_cost(judged)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    counts = [sum(f == kind for _, _, f in judged) for kind in ("blank", "duplicate", "truncated")]
    return (len(shown), gaps, *counts, illegal, cost, edits, sha)


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_uniform_cost(seed):
    rng = random.Random(seed)
    for _ in range(150):
        rows, codes = [], []
        for k in range(rng.randint(0, 9)):
            role, fault = rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["", "", "blank", "duplicate", "truncated"])
            rows.append((role, str(k), fault))
            codes.append({"s": 1, "u": 2, "a": 3}.get(role[0], 0) + {"": 0, "blank": 4, "duplicate": 8, "truncated": 16}[fault])
        cost, edits, _ = cr.cheapest(bytes(codes), 0, cr.END, True)
        assert (cost, edits) == uniform_cost(rows)[:2]


def test_segments_together_find_the_same_path():
    rng = random.Random(9)
    for _ in range(60):
        codes = bytes(rng.choice([1, 2, 3, 0]) + rng.choice([0, 0, 4, 16]) for _ in range(rng.randint(1, 14)))
        whole = cr.cheapest(codes, 0, cr.END, True)
        cuts = sorted(rng.sample(range(len(codes) + 1), min(2, len(codes))))
        parts = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)]
        after = [None]
        for part in reversed(parts[1:]):
            after.append(cr.costs_before(part, after[-1] or cr.END, after[-1] is None))
        state, edits = 0, ""
        for part, goal in zip(parts, reversed(after), strict=True):
            _, own, state = cr.cheapest(part, state, goal or cr.END, goal is None)
            edits += own
        assert edits == whole[1]


def run(spark, rows, partitions=3):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, present boolean").repartition(partitions)
    out = cr.repair(frame.withColumn("part", F.lit("x")), present=F.col("present")).collect()
    got = {r.conv_id: tuple(r)[1:] for r in out}
    assert len(got) == len(out)
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    assert got == {c: expected(r) for c, r in by.items()}
    return got


def test_conversations_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cr, "SEGMENT_ROWS", 3)
    rng = random.Random(2)
    rows = []
    for conv in range(60):
        for _ in range(rng.randint(0, 12)):
            text = rng.choice(["a.", "b!", "c", " ", "", "d?\n", "é.", "long text without an end", None])
            rows.append((conv, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", "", None]), text, rng.random() > 0.1))
    run(spark, rows)


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(4)
    rows = [(7, k, rng.choice(["user", "assistant"]), f"text {k}" + rng.choice([".", ""]), True) for k in range(500)]
    rows += [(c, k, "user" if k % 2 == 0 else "assistant", "fine.", True) for c in range(100, 120) for k in range(4)]
    got = run(spark, rows, 8)
    assert got[7][0] == 500 and len(got[7][7]) >= 500


def test_odd_conversations(spark):
    long = "word " * 500_000 + "end."
    rows = [
        (1, 0, "user", "x.", False), (None, 1, "user", "hello.", True), (None, 2, "assistant", long, True), (2, None, None, None, True), (3, 5, "user", "same.", True), (3, 5, "user", "same.", True),
        (4, None, "system", "s.", True), (4, None, "user", "q?", True), (4, 9, "assistant", "a!", True), (5, 1, "assistant", "a.", True), (6, 0, "system", "only.", True),
    ]
    got = run(spark, rows)
    assert got[1] == (0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[3][6:8] == (7, "KDI") and got[4][7] == "KKK" and got[6][6:8] == (4, "D")
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert cr.repair(empty).count() == 0
