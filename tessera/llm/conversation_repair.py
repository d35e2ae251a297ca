"""Repair of conversations: the cheapest edits that leave turns of role initials (s?(ua)+)?, found by A* on the edit lattice.

A lattice node is (rows consumed, role state). Keeping a row is free, giving it another role costs 1, deleting it 2,
inserting an empty turn 5; a truncated row that stays costs 5 more, a blank or repeated one has to go. What is left
costs at least 2 for every row that has to go, and 2 for every truncated one (deleting it is its cheapest way): the
suffix sums of these are the heuristic, which is consistent. Nodes leave the heap by (cost + heuristic, audit), so the
first way out is the cheapest, and among those the one whose edits' initials are least.

Rows are shuffled once, by conversation, and stream through a task in order. Long conversations are searched in
segments, from every state that a segment can begin in; edits that all surviving ways share are final, and their rows
are hashed and forgotten. So a task holds one segment's rows, not a conversation's; the hash that a conversation is
reported by is sequential, so one conversation is one task's work.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What has been kept so far: nothing, a system turn, a user's, an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Rows searched together.
SEGMENT = 256
#: Structures of conversations (role initials and faults) whose repair a worker remembers.
REMEMBERED = 1 << 16
#: Rows held before a batch is sent.
FLUSHED = 4096

BLANK, DUPLICATE, CUT, SOUND = "bdt-"
_NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {("s", EMPTY): SYSTEM, ("u", EMPTY): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}


@lru_cache(REMEMBERED)
def cheapest_edits(initials: str, faults: str, begin: int, last: bool) -> dict[int, tuple[int, str]]:
    """{state: (cost, audit)} of the cheapest ways through these rows from state `begin`, ties to the least audit.

    With `last` the search ends at the first way out that leaves whole exchanges, and that is the only one returned.
    """
    n, exits, closed = len(faults), {}, set()
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (0 if faults[i] == SOUND else min(DELETE, TRUNCATED))
    heap = [(rest[0], "", 0, begin)]
    while heap:
        key, audit, i, state = heapq.heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        cost = key - rest[i]
        if i == n:
            if not last or state in (EMPTY, ASSISTANT):
                exits[state] = (cost, audit)
                if last:
                    return exits
        else:
            ways = [("D", DELETE, state)]
            if faults[i] in (SOUND, CUT):
                charge = TRUNCATED if faults[i] == CUT else 0
                ways.append(("R", REROLE + charge, _NEXT[state]))
                if (initials[i], state) in _KEPT:
                    ways.append(("K", charge, _KEPT[initials[i], state]))
            for letter, price, after in ways:
                if (i + 1, after) not in closed:
                    heapq.heappush(heap, (cost + price + rest[i + 1], audit + letter, i + 1, after))
        if (i, _NEXT[state]) not in closed:
            heapq.heappush(heap, (key + INSERT, audit + "I", i, _NEXT[state]))
    return exits


class _Conversation:
    """One conversation whose rows come in order; `emit(role, text)` gets each turn of the repaired one."""

    def __init__(self, emit: Callable[[str, str], None]):
        self.emit, self.audit, self.state, self.base = emit, [], EMPTY, 0
        self.rows: list[tuple[str, str]] = []  # those whose edit isn't final
        self.ways = {EMPTY: (0, "")}  # cost and the edits that aren't final
        self.initials, self.faults = [], []  # rows that aren't searched
        self.counts, self.illegal, self.before = dict.fromkeys((BLANK, DUPLICATE, CUT), 0), 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if fault != SOUND:
            self.counts[fault] += 1
        if turn is not None and (self.turns == 0 or turn != self.high):
            self.low, self.high, self.turns = (turn if self.turns == 0 else self.low), turn, self.turns + 1
        if len(self.faults) == SEGMENT:
            self._search(False)
        self.initials.append(initial or " ")
        self.faults.append(fault)
        self.rows.append((role, text))

    def _search(self, last: bool) -> None:
        found: dict[int, tuple[int, str]] = {}
        for begin, (cost, tail) in self.ways.items():
            for end, (more, audit) in cheapest_edits("".join(self.initials), "".join(self.faults), begin, last).items():
                way = (cost + more, tail + audit)
                found[end] = min(found.get(end, way), way)
        self.initials, self.faults = [], []
        if last:
            found = dict([min(found.items(), key=lambda x: x[1])])
        final = len(commonprefix([tail for _, tail in found.values()]))
        self._apply(next(iter(found.values()))[1][:final])
        self.ways = {end: (cost, tail[final:]) for end, (cost, tail) in found.items()}

    def _apply(self, letters: str) -> None:
        at = 0
        for letter in letters:
            role, text = ("", "") if letter == "I" else self.rows[at]
            at += letter != "I"
            if letter == "K":
                self.state = _KEPT[role[:1], self.state]
            elif letter in "RI":
                self.state = _NEXT[self.state]
                role = _NAMES[self.state]
            if letter != "D":
                self.emit(role, text)
        del self.rows[:at]
        self.audit.append(letters)

    def end(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit)."""
        self._search(True)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        cost = next(iter(self.ways.values()))[0]
        return gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT], self.illegal, cost, "".join(self.audit)


def damage(conversations: DataFrame) -> DataFrame:
    """`conversations` (conv_id, turn, role, text) with known faults, dealt by crc32 of `conv_id:turn` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its sentence ends away, 3 repeats it, 4 makes it a user's. Null values
    count as one space. A dropped row stays with `dropped` true, so that its conversation is known.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), (kind == 0).alias("dropped"), copies.alias("copies"))
    return rows.select("conv_id", "turn", F.when(~F.col("dropped"), F.col("role")).alias("role"), F.when(~F.col("dropped"), F.col("text")).alias("text"), "dropped", F.explode("copies").alias("copy")).drop("copy")


def ordered_faults(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, dropped, fault), by conversation in one partition and in order within it.

    The order is by turn, nulls first, then role, then text. `fault` is the first of blank (b), duplicate (d: role and
    text came before in the conversation), truncated (t: the last character that isn't white space is no sentence end).
    """
    dropped = F.col("dropped") if "dropped" in turns.columns else F.lit(False)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), dropped.alias("dropped")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn"))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.row_number().over(same) > 1, DUPLICATE)
    fault = fault.when(F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"), CUT).otherwise(SOUND)
    return rows.withColumn("fault", fault).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", F.col("fault") == DUPLICATE)


def _conversations(batches: Iterator[pa.RecordBatch], begin: Callable) -> Iterator:
    """Each conversation that begin(conv_id) returned, when all its rows have been added; None after every batch."""
    now, key = None, None
    for batch in batches:
        for conv, turn, role, text, dropped, fault in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if now is None or conv != key:
                if now is not None:
                    yield now
                now, key = begin(conv), conv
            if not dropped:
                now.add(turn, role, text, fault)
        yield None
    if now is not None:
        yield now


def repair_report(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one a conversation.

    Rows with a null conv_id are one conversation. A null role or text is one space; a null turn comes first and doesn't
    count for gaps; rows of one turn are in the order of role, then text; repeated rows are duplicates. A conversation
    all of whose rows are `dropped` has zeros, an empty audit and the hash of the empty text. Texts are hashed whole,
    whatever their length. An empty table gives no rows; other columns are not looked at.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    fields = f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"

    def begin(conv):
        digest, between = hashlib.sha256(), [""]

        def emit(role: str, text: str) -> None:
            digest.update(f"{between[0]}{role}:{text}".encode())
            between[0] = "\n"

        new = _Conversation(emit)
        new.conv, new.digest = conv, digest
        return new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for done in _conversations(batches, begin):
            if done is not None:
                out.append((done.conv, *done.end(), done.digest.hexdigest()))
            elif len(out) >= FLUSHED:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    schema = _arrow(fields)
    return ordered_faults(turns).mapInArrow(run, fields)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, position, role, text): the turns of every repaired conversation; cases as in `repair_report`."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    fields = f"conv_id {kind}, position bigint, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def begin(conv):
            position = itertools.count()
            return _Conversation(lambda role, text: out.append((conv, next(position), role, text)))

        for done in _conversations(batches, begin):
            if done is not None:
                done.end()
            elif len(out) >= FLUSHED:
                yield _batch(out, schema)
                out.clear()
        if out:
            yield _batch(out, schema)

    schema = _arrow(fields)
    return ordered_faults(turns).mapInArrow(run, fields)


def _arrow(fields: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(fields))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
