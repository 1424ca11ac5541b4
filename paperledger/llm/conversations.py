"""Repair of conversations to alternating turns, as lightest derivations over repair items."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperledger.llm.common import BLANKS, written

#: Where a repaired prefix stands: nothing yet, or its last role.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = range(4), {START, ASSISTANT}
#: Rows of a part, the unit in which one conversation is dealt to several tasks.
PART = 256
#: Neighbouring spans that are joined to one at a time, so that no more than so many copies of their letters are held.
FAN = 16
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1

Moves = Callable[[int, int], Iterable[tuple[int, str, int, int]]]


def lightest(moves: Moves, goal: Callable[[int, int], bool], start: int = START, back: dict | None = None) -> Iterator[tuple[int, int, str]]:
    """``state, cost, audit`` of each goal item, in the order in which they are final; ``back`` is filled with each item's antecedent.

    An item ``(at, state)`` says that what lies before ``at`` is repaired and
    ends in ``state``. ``moves(at, state)`` are the deductions that have it as
    an antecedent, the other one being a fact about what lies at ``at``: their
    cost, letters and conclusion. The agenda is popped by cost, then position,
    then letters. Each deduction raises the cost or the position, and adds its
    letters behind those of its antecedent: of two derivations of one item with
    one cost neither's letters can begin with the other's (the rest would be
    free inserts), so a lighter antecedent always gives a lighter conclusion,
    and an item is final when it is popped first.
    """
    agenda, final = [(0, 0, "", start, (0, start))], {} if back is None else back
    while agenda:
        cost, at, audit, state, antecedent = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final[at, state] = antecedent
        if goal(at, state):
            yield state, cost, audit
        for more, letters, to, reached in moves(at, state):
            if (to, reached) not in final:
                heapq.heappush(agenda, (cost + more, to, audit + letters, reached, (at, state)))


def _turn_after(state: int) -> int:
    return ASSISTANT if state == USER else USER


def edits(initials: list[str], faults: list[str | None]) -> Moves:
    """The edits of rows with these role initials and faults."""
    keeps = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}

    def moves(at: int, state: int) -> Iterator[tuple[int, str, int, int]]:
        yield INSERT, "I", at, _turn_after(state)
        if at < len(faults):
            yield DELETE, "D", at + 1, state
            if faults[at] not in (BLANK, DUPLICATE):
                extra = UNFINISHED if faults[at] == TRUNCATED else 0
                yield REROLE + extra, "R", at + 1, _turn_after(state)
                if (initials[at], state) in keeps:
                    yield KEEP + extra, "K", at + 1, keeps[initials[at], state]

    return moves


def replay(rows: list[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str]]:
    """The repaired ``role, text`` that an audit makes of ``rows``."""
    at = 0
    for letter in audit:
        role, text = rows[at] if letter != "I" else (None, "")
        at += letter != "I"
        if letter == "D":
            continue
        if letter == "K":
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        else:
            state = _turn_after(state)
            role = "assistant" if state == ASSISTANT else "user"
        yield role, text


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with the faults that a hash of conversation and turn gives each row.

    Nulls of role and text become one blank. ``times`` is how often a row
    stands there: none, one, or two times.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))


def _same() -> Column:
    """One key for one role and text; it also orders different rows of one turn and role."""
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))


class _Part:
    """A run of rows of one conversation, in order."""

    def __init__(self, conv, key: tuple, number: int):
        self.conv, self.key, self.number = conv, key, number
        self.rows: list[tuple[str, str]] = []
        self.faults: list[str | None] = []
        self.turns: list[int | None] = []

    def add(self, turn, role: str, text: str, again: bool) -> None:
        body = text.strip(BLANKS)
        fault = BLANK if not body else DUPLICATE if again else TRUNCATED if body[-1] not in ".!?" else None
        self.rows.append((role, text))
        self.faults.append(fault)
        if not self.turns or self.turns[-1] != turn:
            self.turns.append(turn)

    def counts(self) -> dict:
        """What the rows show; parts of one conversation add up, and meet at their ends."""
        initials, turns = [r[:1] for r, _ in self.rows], [t for t in self.turns if t is not None]
        return {
            "rows": len(self.rows), **{kind: self.faults.count(kind) for kind in (BLANK, DUPLICATE, TRUNCATED)},
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "least": min(turns, default=None), "most": max(turns, default=None), "turns": len(turns),
            "initial": initials[0] if initials else "", "last": initials[-1] if initials else "",
        }

    def derive(self, start: int) -> Iterator[tuple[int, int, str]]:
        return lightest(edits([r[:1] for r, _ in self.rows], self.faults), lambda at, _: at == len(self.rows), start)


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = "rows long, least long, most long, turns long, initial string, last string"
_SPANS = "starts array<int>, ends array<int>, costs array<long>, audits array<string>, roles array<string>, texts array<string>"
_PART = f"conv_id long, whole boolean, {_RESULT}, key_turn long, key_role string, key_same string, number long, {_COUNTS}, {_SPANS}"
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = pa.schema([pa.field(name, _ARROW[kind]) for name, kind in (part.split() for part in schema.split(", "))])
    return pa.RecordBatch.from_pylist([{name: row.get(name) for name in fields.names} for row in rows], schema=fields)


def _digest(rows: Iterable[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in rows).encode("utf-8", "surrogatepass")).hexdigest()


def _finished(part: _Part) -> dict:
    """The result of a conversation that is one part."""
    counts = part.counts()
    _, cost, audit = next(x for x in part.derive(START) if x[0] in ENDS)
    gaps = counts["most"] - counts["least"] + 1 - counts["turns"] if counts["turns"] else 0
    return {"conv_id": part.conv, "whole": True, **counts, "gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": _digest(replay(part.rows, audit))}


def _unfinished(part: _Part) -> dict:
    """What other parts need to know of this one: the lightest edits from each state to each state."""
    spans = [(start, *found) for start in STATES for found in part.derive(start)]
    starts, ends, costs, audits = (list(x) for x in zip(*spans))
    return {"conv_id": part.conv, "whole": False, **part.counts(), "key_turn": part.key[0], "key_role": part.key[1], "key_same": part.key[2], "number": part.number,
            "starts": starts, "ends": ends, "costs": costs, "audits": audits, "roles": [r for r, _ in part.rows], "texts": [t for _, t in part.rows]}


def _parts(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, number, edge, before = [], None, 0, True, None

        def close(whole: bool) -> None:
            out.append(_finished(part) if whole else _unfinished(part))

        for batch in batches:
            columns = batch.to_pydict()
            for conv, turn, role, text, times, same, mark in zip(*(columns[c] for c in ("conv_id", "turn", "role", "text", "times", "same", "mark"))):
                key = (turn, role, same)
                if part is None or conv != part.conv:
                    if part is not None:
                        close(not edge)  # what begins a task's range may have begun in another one
                        edge = False
                    part, before = _Part(conv, key, number), None
                    number += 1
                if mark:
                    before = key
                    continue
                for _ in range(times):
                    if len(part.rows) == limit:
                        close(False)
                        edge, part = True, _Part(conv, key, number)
                        number += 1
                    part.add(turn, role, text, before == key)
                    before = key
            if len(out) >= 200:
                yield _batch(out, _PART)
                out = []
        if part is not None:
            close(False)
        if out:
            yield _batch(out, _PART)

    return run


#: For each state before a span: ``cost, letters, state after it`` and the spans below that were taken.
Span = dict[int, list[tuple[int, str, int, list]]]


def joined(spans: list[Span]) -> Span:
    """One span for a run of neighbouring spans: a deduction has an item and the span behind it as its antecedents."""
    moves = lambda at, state: ((cost, letters, at + 1, end) for cost, letters, end, _ in spans[at].get(state, ())) if at < len(spans) else ()
    out: Span = {}
    for start in STATES:
        back: dict = {}
        for end, cost, letters in list(lightest(moves, lambda at, _: at == len(spans), start, back)):
            taken, state = [], end
            for at in range(len(spans), 0, -1):
                before = back[at, state][1]
                taken.append((before, next(x for x in spans[at - 1][before] if x[2] == state)))
                state = before
            out.setdefault(start, []).append((cost, letters, end, taken[::-1]))
    return out


def _leaves(start: int, span: tuple) -> Iterator[tuple[int, str]]:
    """``state, letters`` of each part below a span."""
    if not span[3]:
        yield start, span[1]
    for before, taken in span[3]:
        yield from _leaves(before, taken)


def _join_parts(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    """Row 0: the result of one conversation; the others: the edits of each of its parts. Texts aren't here."""
    order = ["key_turn", "key_role", "key_same", "number"]
    parts = parts.sort_values(order, na_position="first", kind="stable").astype(object).where(parts.notna(), None).to_dict("records")
    level: list[Span] = []
    for part in parts:
        span: Span = {}
        for start, end, cost, letters in zip(part["starts"], part["ends"], part["costs"], part["audits"]):
            span.setdefault(int(start), []).append((int(cost), letters, int(end), []))
        level.append(span)
    while len(level) > FAN:
        level = [joined(level[k : k + FAN]) for k in range(0, len(level), FAN)]
    cost, audit, _, taken = best = min((x for x in joined(level)[START] if x[2] in ENDS), key=lambda x: x[:2])
    shown = [p for p in parts if p["rows"]]
    illegal = sum(p["illegal"] for p in shown) + sum((a["last"] + b["initial"]) not in LEGAL for a, b in zip(shown, shown[1:]))
    numbered = [p for p in shown if p["turns"]]
    turns = sum(p["turns"] for p in numbered) - sum(a["most"] == b["least"] for a, b in zip(numbered, numbered[1:]))
    gaps = numbered[-1]["most"] - numbered[0]["least"] + 1 - turns if numbered else 0
    rows = [{"gaps": gaps, **{c: sum(p[c] for p in parts) for c in (BLANK, DUPLICATE, TRUNCATED)}, "illegal": illegal, "cost": cost, "audit": audit}]
    for k, (part, (state, letters)) in enumerate(zip(parts, _leaves(START, best))):
        rows.append({"part": part["part"], "at": k, "state": state, "audit": letters})
    frame = pd.DataFrame(rows, columns=["conv_id", "gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost", "audit", "part", "at", "state"])
    frame["conv_id"] = parts[0]["conv_id"]
    return frame.astype({c: "Int64" for c in frame.columns if c != "audit"})


_JOINED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, part long, at long, state long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv_id, repaired_sha256`` of sorted parts, a part in memory at a time."""
    current, hashed, some, out = (), None, False, []
    for batch in batches:
        columns = batch.to_pydict()
        for conv, state, audit, roles, texts in zip(*(columns[c] for c in ("conv_id", "state", "audit", "roles", "texts"))):
            if (conv,) != current:
                if current:
                    out.append({"conv_id": current[0], "repaired_sha256": hashed.hexdigest()})
                current, hashed, some = (conv,), hashlib.sha256(), False
            for role, text in replay(list(zip(roles, texts)), audit, state):
                hashed.update(("\n" * some + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                some = True
    if current:
        out.append({"conv_id": current[0], "repaired_sha256": hashed.hexdigest()})
    if out:
        yield _batch(out, "conv_id long, repaired_sha256 string")


def repair(turns: DataFrame, part: int = PART) -> DataFrame:
    """Each conversation's faults and its cheapest repair.

    ``turns``: ``conv_id, turn, role, text, times`` of ``damaged``, or any table
    of these; ``times`` 0 only makes the conversation known. Returns
    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``, a row for each conversation, a null one included.

    Rows are taken by turn, nulls first; those of one turn by role and then by
    a hash of role and text, so equal rows stand side by side. A role's initial
    is its first character; an empty role has none and can't be kept.
    A conversation without rows has zeros and an empty audit. An empty table
    gives no row; other columns are ignored.

    Rows are sorted by ranges of conversation and turn, so one conversation
    may run over many tasks. A task finishes what begins and ends inside its
    range; the rest is cut into parts of at most ``part`` rows, of which only
    the lightest edits from each state to each state go on to be joined.
    """
    rows = turns.select("conv_id", "turn", "role", "text", "times", _same().alias("same"))
    # A row is a duplicate if its text stands at an earlier turn. Hashes alone decide that; a mark sorts just before such rows.
    place = F.struct(F.col("turn").isNotNull(), "turn")
    narrow = rows.where(F.col("times") > 0).select("conv_id", "turn", "role", "same", place.alias("place"))
    met = narrow.groupBy("conv_id", "same").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
    met = met.select(F.col("conv_id").alias("conv"), F.col("same").alias("met"), "first")
    later = narrow.join(met, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("same") == F.col("met"))).where("place > first")
    marks = later.select("conv_id", "turn", "role", F.lit("").alias("text"), F.lit(0).alias("times"), "same").distinct()
    both = rows.withColumn("mark", F.lit(False)).unionByName(marks.withColumn("mark", F.lit(True)))
    dealt = both.repartitionByRange("conv_id", "turn", "role", "same").sortWithinPartitions("conv_id", "turn", "role", "same", F.desc("mark"))
    found = written(dealt.mapInArrow(_parts(part), _PART).withColumn("part", F.monotonically_increasing_id()))

    result = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    whole = found.where("whole").select(*result, "repaired_sha256")
    parts = found.where("NOT whole")
    narrow = parts.drop("whole", "gaps", "cost", "audit", "repaired_sha256", "roles", "texts")
    plans = written(narrow.groupBy("conv_id").applyInPandas(_join_parts, _JOINED))
    pieces = parts.select("part", "roles", "texts").join(plans.where("part IS NOT NULL").select("conv_id", "part", "at", "state", "audit"), "part")
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at")
    hashes = ordered.mapInArrow(_digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "conv")
    summary = plans.where("part IS NULL").select(*result).join(hashes, F.col("conv_id").eqNullSafe(F.col("conv"))).drop("conv")
    return whole.unionByName(summary)
