"""Conversations damaged by rule, their faults counted and repaired at least cost.

A repair walks an edit lattice: rows of a conversation by what the repaired roles may go
on with. A* finds the cheapest walk; what is left costs at least the deletions that are
due and a charge for each truncated row, summed up from the end, so that the estimate
never exceeds the truth and never falls faster than the cost grows. The queue goes by
(cost plus estimate, edits so far), so that of equally cheap repairs the first in ASCII
order comes out.

Rows are dealt by ranges of (conversation, turn), so that no conversation is one task's.
One that fits a task's range is repaired at once. Any other is a chain of segments: each
gives the best walk between every two states, a stream over these small tables chooses,
segments are rewritten where they lie, and a stream of their bytes gives the digest.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stage_table

#: White space, ends of sentences, and neighbours that roles may form by their initials.
SPACE, ENDS, LEGAL = " \t\n\x0b\x0c\r", ".!?", ("su", "ua", "au")
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What damage does to one in so many rows, by the remainder.
DAMAGE_OF, DROP, EMPTY, UNEND, REPEAT, REUSER = 20, 0, 1, 2, 3, 4
#: Rows and characters of a segment; parts that a text of many turns is dealt in.
SEGMENT_ROWS, SEGMENT_CHARS, SALTS = 256, 1 << 20, 16
#: States of the repaired roles: nothing yet, a system row, after a user row, after an assistant row; those that may end.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
_KEEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
GOOD, BLANK, DUPLICATE, CUT = range(4)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, times): conversations after damage, with how often a row stands there.

    Null roles and texts, and null ids and turns in what is hashed, are one space. A
    dropped row stays with times 0 and without words, so that its conversation is known.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn)).cast("binary")) % DAMAGE_OF
    role, text = shown(F.col("role")), shown(F.col("text"))
    text = F.when(fate.isin(DROP, EMPTY), "").when(fate == UNEND, F.translate(text, ENDS, "")).otherwise(text)
    role = F.when(fate == DROP, "").when(fate == REUSER, "user").otherwise(role)
    return conversations.select(conv.alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text"), F.when(fate == DROP, 0).when(fate == REPEAT, 2).otherwise(1).cast("long").alias("times"))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that are equal as one, before anything is shuffled."""
    for batch in batches:
        if batch.num_rows:
            keys = [n for n in batch.schema.names if n != "times"]
            found = pa.Table.from_batches([batch]).group_by(keys).aggregate([("times", "sum")]).rename_columns({"times_sum": "times"})
            yield from found.select(batch.schema.names).to_batches()


def _place(turn: Column) -> Column:
    """An order of turns, null first, that min understands."""
    return F.struct(turn.isNotNull().alias("known"), turn.alias("turn"))


def repeated_rows(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, mark) of rows whose role and text stand at an earlier turn of their conversation.

    Only marks of 16 bytes are dealt. A text of very many turns is dealt in SALTS parts
    by turn: its first turn is found part by part, then among the parts.
    """
    from pyspark.sql import Window

    narrow = rows.where((F.col("times") > 0) & (F.trim(F.translate("text", SPACE, " ")) != "")).select("conv", "turn", "role", "mark", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).alias("salt"))
    parts = narrow.groupBy("conv", "mark", "salt").agg(F.min(_place(F.col("turn"))).alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("conv", "mark")
    known = parts.withColumns({"first": F.min("first").over(whole), "n": F.sum("n").over(whole)}).where("n > 1").select(F.col("conv").alias("c"), F.col("mark").alias("m"), F.col("salt").alias("s"), "first")
    met = narrow.join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")) & (F.col("salt") == F.col("s")))
    return met.where(_place(F.col("turn")) > F.col("first")).select("conv", "turn", "role", "mark").distinct()


@dataclass
class Unit:
    """A row, or equal rows one behind the other; only the first of these can stay."""

    role: str
    text: str
    fault: int
    times: int

    @property
    def due(self) -> bool:
        return self.fault in (BLANK, DUPLICATE)

    @property
    def least(self) -> int:
        """What any repair pays for it."""
        return DELETE * self.times if self.due else (TRUNCATED if self.fault == CUT else 0) + DELETE * (self.times - 1)


def search(units: list[Unit], start: int, ends: tuple[int, ...], lead: bool) -> dict[int, tuple[int, str]]:
    """{end state: (cost, edits)} of the cheapest walks from start, by A*.

    Without lead nothing is inserted before the first row, as a segment leaves that to
    the one before it. With lead, a whole conversation, the first end that is met is the
    cheapest; a segment's are all found.
    """
    due = [0] * (len(units) + 1)
    for k in range(len(units) - 1, -1, -1):
        due[k] = due[k + 1] + units[k].least
    queue, closed, found = [(due[0], "", 0, start, 0)], set(), {}
    while queue:
        _, edits, at, state, cost = heapq.heappop(queue)
        if (at, state) in closed:
            continue
        closed.add((at, state))
        if at == len(units) and state in ends:
            found[state] = (cost, edits)
            if lead or len(found) == len(ends):
                break
        steps = []
        if lead or at:
            steps.append((INSERT, "I", at, _NEXT[state][1]))
        if at < len(units):
            unit = units[at]
            if unit.due:
                steps.append((unit.least, "D" * unit.times, at + 1, state))
            else:
                rest, more = "D" * (unit.times - 1), DELETE * (unit.times - 1)
                stays = more + (TRUNCATED if unit.fault == CUT else 0)
                kept = _KEEPS[state].get(unit.role[:1])
                if kept is not None:
                    steps.append((stays, "K" + rest, at + 1, kept))
                steps.append((stays + REROLE, "R" + rest, at + 1, _NEXT[state][1]))
                steps.append((more + DELETE, "D" + rest, at + 1, state))
        for price, edit, to, into in steps:
            if (to, into) not in closed:
                heapq.heappush(queue, (cost + price + due[to], edits + edit, to, into, cost + price))
    return found


def repair(units: list[Unit]) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair of a whole conversation."""
    return next(iter(search(units, START, FINAL, True).values()))


def rewrite(units: list[Unit], edits: str, state: int) -> tuple[bytes | None, int]:
    """(what edits leave as role:text lines, their cost); None where nothing stays."""
    lines, cost, at, left = [], 0, 0, units[0].times if units else 0
    for edit in edits:
        role, into = _NEXT[state]
        if edit == "I":
            lines.append(f"{role}:")
            state, cost = into, cost + INSERT
            continue
        while not left:
            at += 1
            left = units[at].times
        unit, left = units[at], left - 1
        if edit == "D":
            cost += DELETE
            continue
        if edit == "K":
            role, into = unit.role, _KEEPS[state][unit.role[:1]]
        lines.append(f"{role}:{unit.text}")
        state, cost = into, cost + (REROLE if edit == "R" else 0) + (TRUNCATED if unit.fault == CUT else 0)
    return "\n".join(lines).encode() if lines else None, cost


@dataclass
class Facts:
    """Counts over rows in order, which add up over neighbouring segments."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first_turn: int | None = None
    last_turn: int | None = None
    first_role: str | None = None
    last_role: str | None = None

    def row(self, unit: Unit, turn: int | None) -> None:
        rest = 0 if unit.fault == BLANK else unit.times - (unit.fault != DUPLICATE)
        initial = unit.role[:1]
        one = Facts(
            unit.times if unit.fault == BLANK else 0, rest, int(unit.fault == CUT), unit.times - 1, int(turn is not None), turn, turn, turn, turn, initial, initial
        )
        self.add(one)

    def add(self, other: Facts) -> None:
        """Put the facts of the rows that follow behind these."""
        if self.last_role is not None and other.first_role is not None:
            self.illegal += self.last_role + other.first_role not in LEGAL
        self.turns -= self.last_turn is not None and self.last_turn == other.first_turn
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.low = other.low if self.low is None else self.low if other.low is None else min(self.low, other.low)
        self.high = other.high if self.high is None else self.high if other.high is None else max(self.high, other.high)
        for name, later in (("turn", False), ("role", False)):
            if getattr(self, f"first_{name}") is None:
                setattr(self, f"first_{name}", getattr(other, f"first_{name}"))
            if getattr(other, f"last_{name}") is not None:
                setattr(self, f"last_{name}", getattr(other, f"last_{name}"))

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)


_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FACTS = "blank:long,duplicate:long,truncated:long,illegal:long,turns:long,low:long,high:long,first_turn:long,last_turn:long,first_role:string,last_role:string"
_KEY = "conv long, turn long, role string, mark binary, segment long"
_SEGMENT = (
    f"{_KEY}, result struct<{','.join(f.replace(' ', ':') for f in _RESULT.split(', '))}>, facts struct<{_FACTS}>,"
    " walks array<struct<entry:int,leave:int,cost:long,edits:string>>, units array<struct<role:string,text:string,fault:int,times:long>>"
)


def _result(conv: int | None, facts: Facts, cost: int, audit: str, digest: str) -> dict:
    return {"conv_id": conv, "gaps": facts.gaps, "blank": facts.blank, "duplicate": facts.duplicate, "truncated": facts.truncated, "illegal": facts.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}


@dataclass
class _Part:
    """The rows of a conversation that a task has read and not yet written."""

    conv: int | None
    key: dict = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)
    facts: Facts = field(default_factory=Facts)
    chars: int = 0


def _fault(text: str, again: bool) -> int:
    spoken = text.rstrip(SPACE)
    return BLANK if not spoken else DUPLICATE if again else GOOD if spoken[-1] in ENDS else CUT


def _segments(batches: Iterator[pa.RecordBatch], schema: pa.Schema, number: Callable[[], int]) -> Iterator[pa.RecordBatch]:
    """Results of conversations that lie within this task's range, and segments of all others."""
    out: list[dict] = []
    base, made = number() << 33, 0
    part: _Part | None = None
    is_open = True
    again: tuple | None = None
    last_key: tuple | None = None

    def close(whole: bool) -> None:
        nonlocal made
        if whole:
            cost, audit = repair(part.units)
            text, _ = rewrite(part.units, audit, START)
            row = {"conv": part.conv, "result": _result(part.conv, part.facts, cost, audit, hashlib.sha256(text or b"").hexdigest())}
        else:
            walks = [{"entry": s, "leave": t, "cost": c, "edits": e} for s in range(4) for t, (c, e) in search(part.units, s, tuple(range(4)), False).items()]
            units = [{"role": u.role, "text": "" if u.due else u.text, "fault": u.fault, "times": u.times} for u in part.units]
            row = {"conv": part.conv, **part.key, "segment": base + made, "facts": vars(part.facts), "walks": walks, "units": units}
            made += 1
        out.append(row)

    for batch in batches:
        for conv, turn, role, mark, kind, times, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = (conv, turn, role, mark)
            if kind == 0:
                again = key
                continue
            if part is None or part.conv != conv:
                if part is not None:
                    close(not is_open)
                    is_open = False
                part, last_key = _Part(conv), None
            if not part.key:
                part.key = {"turn": turn, "role": role, "mark": mark}
            if key == last_key and times:  # the rest of rows that other tasks' batches held
                unit = part.units[-1]
                more = Unit(unit.role, unit.text, BLANK if unit.fault == BLANK else DUPLICATE, times)
                part.facts.row(more, turn)
                unit.times += times
            elif times:
                unit = Unit(role, text, _fault(text, again == key), times)
                if len(part.units) >= SEGMENT_ROWS or part.chars >= SEGMENT_CHARS:
                    close(False)
                    is_open = True
                    part = _Part(conv, {"turn": turn, "role": role, "mark": mark})
                part.units.append(unit)
                part.facts.row(unit, turn)
                part.chars += len(text)
                last_key = key
        if len(out) >= 500:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    if part is not None:
        close(False)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


class _Chain:
    """The cheapest walk through a conversation's segments as they come; decided pieces leave at once.

    best[state] is (cost, edits since the last decision) of the walks that end there.
    """

    def __init__(self):
        self.best: dict[int, tuple[int, str]] = {}
        self.held: list[tuple[dict, dict[int, tuple[int, str]]]] = []
        self.check = 1

    def put(self, row: dict) -> list[dict]:
        fresh = not self.best
        before = {START: (0, ""), USER: (INSERT, "I"), ASSISTANT: (2 * INSERT, "II")} if fresh else self.best
        after: dict[int, tuple[int, str]] = {}
        ways: dict[int, tuple[int, str]] = {}
        for walk in row["walks"]:
            if walk["entry"] in before:
                cost, edits = before[walk["entry"]]
                now = (cost + walk["cost"], edits + walk["edits"])
                if walk["leave"] not in after or now < after[walk["leave"]]:
                    after[walk["leave"]] = now
                    ways[walk["leave"]] = (START, now[1]) if fresh else (walk["entry"], walk["edits"])
        self.best = after
        self.held.append((row, ways))
        if len(self.held) < self.check:
            return []
        out = self._decided(set(after))
        self.check = 1 if out else 2 * self.check
        return out

    def _decided(self, states: set[int]) -> list[dict]:
        """Pieces of the segments at whose end all walks to states meet."""
        for k in range(len(self.held) - 1, -1, -1):
            if len(states) == 1:
                return self._leave(k, next(iter(states)))
            states = {self.held[k][1][s][0] for s in states}
        return []

    def _leave(self, last: int, state: int) -> list[dict]:
        out = []
        for row, ways in reversed(self.held[: last + 1]):
            entry, piece = ways[state]
            out.append({"segment": row["segment"], "entry": entry, "piece": piece})
            state = entry
        size = sum(len(x["piece"]) for x in out)
        self.best = {s: (c, e[size:]) for s, (c, e) in self.best.items()}
        del self.held[: last + 1]
        return out[::-1]

    def end(self) -> list[dict]:
        if not self.held:
            return []
        state = min((s for s in FINAL if s in self.best), key=lambda s: self.best[s])
        return self._leave(len(self.held) - 1, state)


_PIECE = "segment long, entry int, piece string"


def _choose(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    chain, conv, begun = _Chain(), None, False
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if begun and row["conv"] != conv:
                out += chain.end()
                chain = _Chain()
            conv, begun = row["conv"], True
            out += chain.put(row)
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist(chain.end(), schema)


_DONE = f"{_KEY}, facts struct<{_FACTS}>, piece string, cost long, text binary"


def _rewrite(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            text, cost = rewrite([Unit(**u) for u in row.pop("units")], row["piece"], row.pop("entry"))
            out.append(row | {"text": text, "cost": cost})
        yield pa.RecordBatch.from_pylist(out, schema)


def _finish(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose rewritten segments come in order; one segment's text is held."""
    conv, begun = None, False
    facts, cost, pieces, digest, spoken = Facts(), 0, [], hashlib.sha256(), False
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if begun and row["conv"] != conv:
                out.append(_result(conv, facts, cost, "".join(pieces), digest.hexdigest()))
                facts, cost, pieces, digest, spoken = Facts(), 0, [], hashlib.sha256(), False
            conv, begun = row["conv"], True
            facts.add(Facts(**row["facts"]))
            cost += row["cost"]
            pieces.append(row["piece"])
            if row["text"] is not None:
                digest.update(b"\n" + row["text"] if spoken else row["text"])
                spoken = True
        yield pa.RecordBatch.from_pylist(out, schema)
    if begun:
        yield pa.RecordBatch.from_pylist([_result(conv, facts, cost, "".join(pieces), digest.hexdigest())], schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation after damage.

    conversations have conv_id, turn, role and text; other columns are left aside. Rows
    without an id are one conversation. Rows of one turn go by role, then by a digest of
    role and text; equal rows stand one behind the other. A conversation without rows
    after damage has zeros, no edits and the digest of nothing. Texts and conversations
    may have any length, but a conversation's edits must fit a string.
    """
    spoken = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = damage(conversations).withColumn("mark", F.unhex(F.md5(spoken.cast("binary"))))
    rows = rows.mapInArrow(_combine, rows.schema)
    key = ("conv", "turn", "role", "mark")
    marks = repeated_rows(rows).select(*key, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("times"), F.lit(None).cast("string").alias("text"))
    both = rows.select(*key, F.lit(1).alias("kind"), "times", "text").unionByName(marks)
    dealt = both.repartitionByRange(*key).sortWithinPartitions(*key, "kind")
    schemas = {ddl: _arrow(ddl) for ddl in (_SEGMENT, _PIECE, _DONE, _RESULT)}
    read = stage_table(dealt.mapInArrow(lambda batches: _segments(batches, schemas[_SEGMENT], _partition), _SEGMENT), "conversations")
    segments = read.where("result is null")
    ordered = segments.select("conv", "turn", "role", "mark", "segment", "walks").repartition("conv").sortWithinPartitions(*key)
    pieces = ordered.select("conv", "segment", "walks").mapInArrow(lambda batches: _choose(batches, schemas[_PIECE]), _PIECE)
    chosen = segments.drop("result", "walks").join(pieces, "segment").select(*key, "segment", "facts", "units", "entry", "piece")
    done = chosen.mapInArrow(lambda batches: _rewrite(batches, schemas[_DONE]), _DONE)
    joined = done.repartition("conv").sortWithinPartitions(*key).mapInArrow(lambda batches: _finish(batches, schemas[_RESULT]), _RESULT)
    return read.where("result is not null").select("result.*").unionByName(joined)
