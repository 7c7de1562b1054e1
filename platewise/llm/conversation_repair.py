"""Conversation structure repair by iterative-deepening A*.

Rows of a conversation stand by turn (nulls first), rows of one turn by role, then by text. A row's first fault counts: blank (no
character outside white space), duplicate (an earlier row has its role and text), truncated (its last such character
is none of ``.!?``). Edits make the initials of the roles an instance of ``(s?(ua)+)?``:

    D  delete, 4        I  insert an empty user or assistant row, 3
    K  keep, 0          R  give the row the role user or assistant, 3

Blank and duplicate rows must go; a truncated row that stays costs 3 more. Which role I and R give follows from the place, so a
string of initials is a whole repair. The cheapest repair is returned, of several the one whose string is least in ASCII order.

**Search** (:func:`cheapest`): depth first in the order D, I, K, R under a bound on the cost. The table of failed states keeps, for each
(row, automaton state), a proven least cost of what is left; it prunes, and gives the next bound. A bound never exceeds the cheapest cost,
so the first path that is accepted is the answer.

**Long conversations.** Rows are sorted over ranges of (conversation, turn, role, start of the text), so one conversation may span many
tasks, and cut into segments of at most 64 rows or ``SEGMENT_BYTES`` of text. From the last segment to the first, the search gives the cheapest cost of
all that follows from each of the four automaton states; from first to last, each segment then takes its least cheapest path to those costs.
Both passes are folds over sorted segments that carry a few numbers a conversation; the digest is fed row by row. A
conversation's audit string is as long as its repair, and its SHA-256 is sequential by nature: these alone pass through one task in order.

Defined cases: null roles and texts are one space, which no repair keeps as it is; an empty role is treated alike; null conv_ids are one conversation; repeated
rows are duplicates; rows that aren't ``present`` only make their conversation appear; conversations without present rows have zeros, an
empty audit and the digest of nothing; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.columns import join_counted
from platewise.llm.text_arrays import released
from platewise.session import Scratch

SEGMENT_ROWS = 64
SEGMENT_BYTES = 1 << 20
WHITE_SPACE = " \t\n\x0b\x0c\r"
# a row's code: the class of its initial, and its first fault
OTHER, SYSTEM, USER, ASSISTANT = range(4)
CLASS, BLANK, DUPLICATE, TRUNCATED = 3, 4, 8, 16
# automaton: nothing yet, after s, after u, after a
KEEPS = ((None, 1, 2, None), (None, None, 2, None), (None, None, None, 3), (None, None, 2, None))
GIVES = (2, 2, 3, 2)
FAR = 1 << 40
#: The cost of ending in each state.
END = (0, FAR, FAR, 0)
DELETE, INSERT, RENAME, UNFINISHED = 4, 3, 3, 3


def least_cost(code: int) -> int:
    """What a row costs at least, wherever it stands."""
    if code & (BLANK | DUPLICATE):
        return DELETE
    stays = (0 if code & CLASS else RENAME) + (UNFINISHED if code & TRUNCATED else 0)
    return min(DELETE, stays)


@lru_cache(maxsize=1 << 15)
def cheapest(codes: bytes, start: int, goal: tuple[int, ...], final: bool) -> tuple[int, str, int]:
    """(cost with what follows, edits, state at the end) of the least cheapest path over the rows.

    ``goal`` is the cost of what follows from each state; rows may be inserted after the last one if ``final``.
    """
    n = len(codes)
    rest = [min(goal) if not final else 0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + least_cost(codes[i])
    failed: dict[tuple[int, int], int] = {}

    def remaining(i: int, q: int) -> int:
        return max(rest[i], failed.get((i, q), 0))

    def edges(i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        if i < n:
            yield "D", DELETE, i + 1, q
        if i < n or final:
            yield "I", INSERT, i, GIVES[q]
        if i < n and not codes[i] & (BLANK | DUPLICATE):
            more = UNFINISHED if codes[i] & TRUNCATED else 0
            kept = KEEPS[q][codes[i] & CLASS]
            if kept is not None:
                yield "K", more, i + 1, kept
            yield "R", RENAME + more, i + 1, GIVES[q]

    def search(i: int, q: int, left: int) -> tuple[str, int] | None:
        if i == n and goal[q] <= left:
            return "", q
        for letter, cost, to, state in edges(i, q):
            if cost + remaining(to, state) <= left:
                found = search(to, state, left - cost)
                if found is not None:
                    return letter + found[0], found[1]
        costs = [cost + remaining(to, state) for _, cost, to, state in edges(i, q)]
        failed[i, q] = max(remaining(i, q), min(costs + [goal[q]] if i == n else costs))
        return None

    while True:
        bound = remaining(0, start)
        found = search(0, start, bound)
        if found is not None:
            return bound, *found


def costs_before(codes: bytes, goal: tuple[int, ...], final: bool) -> tuple[int, ...]:
    """The cheapest cost of the rows and all that follows, from each state."""
    return tuple(cheapest(codes, q, goal, final)[0] for q in range(len(GIVES)))


def replay(codes: bytes, edits: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The repaired rows."""
    out, i = [], 0
    for letter in edits:
        given = "assistant" if GIVES[state] == ASSISTANT else "user"
        if letter == "I":
            out.append((given, ""))
        elif letter == "K":
            out.append((roles[i], texts[i]))
        elif letter == "R":
            out.append((given, texts[i]))
        if letter in "IR":
            state = GIVES[state]
        elif letter == "K":
            state = KEEPS[state][codes[i] & CLASS]
        i += letter != "I"
    return out


def with_mask(codes: bytes, mask: int | None) -> bytes:
    """Codes with the duplicates of ``mask`` marked; a blank row stays blank, a duplicate isn't truncated."""
    if not mask:
        return codes
    return bytes(c if not mask >> i & 1 or c & BLANK else c & ~TRUNCATED | DUPLICATE for i, c in enumerate(codes))


# --- segments
SEGMENT = (
    "part int, seq long, codes binary, roles array<string>, texts array<string>, digests array<binary>, "
    "first_turn long, last_turn long, turns long, illegal long, first_class int, last_class int"
)
_NAMES = ["conv", *(f.split(" ")[0] for f in SEGMENT.split(", "))]
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _segments(kind: pa.DataType):
    types = [kind, pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.binary()), *[pa.int64()] * 4, pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        own: list[tuple] = []  # (turn, role, text, code, digest) of the open segment
        open_, conv, part, seq, size = False, None, 0, 0, 0

        def close() -> None:
            nonlocal own, seq, size
            turns = [r[0] for r in own if r[0] is not None]
            classes = [r[3] & CLASS for r in own]
            changes = sum(a != b for a, b in zip(turns, turns[1:], strict=False))
            illegal = sum(pair not in _LEGAL for pair in zip(classes, classes[1:], strict=False))
            done.append((
                conv, part, seq, bytes(r[3] for r in own), [r[1] for r in own], [r[2] for r in own], [r[4] for r in own], turns[0] if turns else None, turns[-1] if turns else None,
                changes + bool(turns), illegal, classes[0] if own else None, classes[-1] if own else None,
            ))
            seq, own, size = seq + 1, [], 0

        def written() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _NAMES)

        held = 0
        for batch in batches:
            for b_conv, b_part, turn, role, text, code, digest, present in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if open_ and (b_conv != conv or len(own) >= SEGMENT_ROWS or size >= SEGMENT_BYTES):
                    close()
                    if held >= SEGMENT_BYTES or len(done) >= 2000:
                        yield written()
                        held = 0
                open_, conv, part = True, b_conv, b_part
                if present:
                    own.append((turn, role, text, code, digest))
                    size += len(text)
                    held += len(text)
        if open_:
            close()
            yield written()

    return released(run)


def segments(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, present: Column) -> DataFrame:
    """The rows in order, at most 64 to a segment; (part, seq) orders the segments of a conversation."""
    role_, text_ = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    shown = rows.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), role_.alias("role"), text_.alias("text"), F.coalesce(present, F.lit(False)).alias("present"))
    bare = F.rtrim(F.col("text"), F.lit(WHITE_SPACE))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(F.length(bare) == 0, BLANK).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    whose = F.when(F.col("conv").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("conv").cast("string")))
    digest = F.unhex(F.sha2(F.concat(whose, F.lit(" "), F.length("role").cast("string"), F.lit(" "), F.col("role"), F.col("text")), 256))
    ordered = shown.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    picked = ordered.select("conv", F.spark_partition_id().alias("part"), "turn", "role", "text", (code + fault).cast("int").alias("code"), digest.alias("digest"), "present")
    kind = shown.schema["conv"].dataType.simpleString()
    return picked.mapInArrow(_segments(_arrow(kind)), f"conv {kind}, {SEGMENT}")


def _arrow(kind: str) -> pa.DataType:
    known = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}
    if kind not in known:
        raise TypeError(f"conversation ids of type {kind} are not supported")
    return known[kind]


def duplicates(cut: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, seq, mask): which rows of a segment have their role and text in an earlier row of the conversation."""
    each = cut.select("part", "seq", F.posexplode("digests").alias("pos", "digest"))
    place = F.struct("part", "seq", "pos")
    several = scratch.table(each.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"), "several")
    later = join_counted(each, several, "digest", "n").where(place != F.col("first"))
    return later.groupBy("part", "seq").agg(F.expr("bit_or(shiftleft(1L, pos))").alias("mask"))


# --- folds over sorted segments
COSTS = [f"after{q}" for q in range(len(GIVES))]


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from last to first: adds the cost of what follows from each state; null after the last segment."""
    later, ahead = False, None
    conv, codes = None, b""
    for batch in batches:
        after = []
        for b_conv, b_codes, mask in zip(batch.column("conv").to_pylist(), batch.column("codes").to_pylist(), batch.column("mask").to_pylist(), strict=True):
            ahead = costs_before(codes, ahead or END, ahead is None) if later and b_conv == conv else None
            after.append(ahead)
            later, conv, codes = True, b_conv, with_mask(b_codes, mask)
        costs = [pa.array([None if a is None else a[q] for a in after], pa.int64()) for q in range(len(GIVES))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "part", "seq", "mask")), *costs], ["conv", "part", "seq", "mask", *COSTS])


REPAIRED = "cr_rows long, cr_gaps long, cr_blank long, cr_duplicate long, cr_truncated long, cr_illegal long, cr_cost long, cr_audit string, cr_sha256 string"


class _Conversation:
    """What is known of a conversation after its first segments."""

    def __init__(self) -> None:
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.cost = self.state = 0
        self.first_turn = self.last_turn = self.last_class = None
        self.edits: list[str] = []
        self.sha, self.begun = hashlib.sha256(), False

    def add(self, s: dict, mask: int | None, after: tuple[int, ...] | None) -> None:
        codes = with_mask(s["codes"], mask)
        self.rows += len(codes)
        self.blank += sum(c & BLANK > 0 for c in codes)
        self.duplicate += sum(c & DUPLICATE > 0 for c in codes)
        self.truncated += sum(c & TRUNCATED > 0 for c in codes)
        self.illegal += s["illegal"]
        if codes:
            self.illegal += self.last_class is not None and (self.last_class, s["first_class"]) not in _LEGAL
            self.last_class = s["last_class"]
        if s["turns"]:
            self.turns += s["turns"] - (self.last_turn == s["first_turn"])
            self.first_turn = s["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = s["last_turn"]
        total, edits, state = cheapest(codes, self.state, after or END, after is None)
        self.cost += total - (after[state] if after else 0)
        for role, text in replay(codes, edits, self.state, s["roles"], s["texts"]):
            self.sha.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
            self.begun = True
        self.edits.append(edits)
        self.state = state

    def result(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return self.rows, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.edits), self.sha.hexdigest()


def _forward(kind: pa.DataType):
    names = ["conv", *(f.split(" ")[0] for f in REPAIRED.split(", "))]
    types = [kind, *[pa.int64()] * 7, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own, mask, after = None, None, None, None
        for batch in batches:
            done = []
            for s in batch.to_pylist():
                if own is None or s["conv"] != conv:
                    if own is not None:
                        done.append((conv, *own.result()))
                    conv, own = s["conv"], _Conversation()
                if s["codes"] is None:  # what the backward fold found stands before its segment
                    mask, after = s["mask"], None if s[COSTS[0]] is None else tuple(s[c] for c in COSTS)
                else:
                    own.add(s, mask, after)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
        if own is not None:
            last = (conv, *own.result())
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, types, strict=True)], names)

    return released(run)


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """One row a conversation: conv_id, rows, gaps, blank, duplicate, truncated and illegal counts, cost, audit, digest of the repaired rows.

    The result reads intermediate tables of the shared folder.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    cut = scratch.table(segments(rows, conv_id, turn, role, text, F.lit(True) if present is None else present), "segments")
    kind = cut.schema["conv"].dataType.simpleString()
    light = cut.select("conv", "part", "seq", "codes").join(duplicates(cut, scratch), ["part", "seq"], "left")
    backward = light.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.desc("part"), F.desc("seq")).select("conv", "part", "seq", "codes", "mask")
    known = backward.mapInArrow(released(_backward), f"conv {kind}, part int, seq long, mask long, {', '.join(f'{c} long' for c in COSTS)}")
    whole = cut.drop("digests").unionByName(known, allowMissingColumns=True)
    order = [F.asc_nulls_first("conv"), "part", "seq", F.col("codes").isNotNull()]
    out = whole.repartition("conv").sortWithinPartitions(*order).mapInArrow(_forward(_arrow(kind)), f"conv {kind}, {REPAIRED}")
    return out.withColumnRenamed("conv", conv_id)
