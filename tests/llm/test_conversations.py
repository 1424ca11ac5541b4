import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from paperledger.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"
TURN_AFTER = {"": "u", "s": "u", "u": "a", "a": "u"}


def all_repairs(rows, faults):
    """Every edit sequence with at most two inserts in a row: cost, audit, repaired rows."""

    def go(i, last, inserts):
        if i == len(rows) and last in ("", "a"):
            yield 0, "", []
        if inserts < 2:
            role = TURN_AFTER[last]
            for cost, audit, out in go(i, role, inserts + 1):
                yield cost + 2, "I" + audit, [({"u": "user", "a": "assistant"}[role], ""), *out]
        if i == len(rows):
            return
        for cost, audit, out in go(i + 1, last, 0):
            yield cost + 3, "D" + audit, out
        if faults[i] in ("blank", "duplicate"):
            return
        extra, (role, text), must = faults[i] == "truncated", rows[i], TURN_AFTER[last]
        if role[:1] and (role[:1] == must or (role[:1] == "s" and last == "")):
            for cost, audit, out in go(i + 1, role[:1], 0):
                yield cost + extra, "K" + audit, [(role, text), *out]
        for cost, audit, out in go(i + 1, must, 0):
            yield cost + 2 + extra, "R" + audit, [({"u": "user", "a": "assistant"}[must], text), *out]

    return go(0, "", 0)


def brute(table):
    """The contract, row by row, on plain tuples (no conversation with two different rows of one turn and role)."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in [r for r in table if r[0] == conv]:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind == 1:
                text = ""
            if kind == 2:
                text = "".join(x for x in text if x not in ".!?")
            if kind == 4:
                role = "user"
            rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        faults, seen = [], set()
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, repaired = min(all_repairs([r[1:] for r in rows], faults), key=lambda x: x[:2])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)), cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def result(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


@pytest.fixture(scope="module")
def table():
    rng = random.Random(3)
    texts = ["Yes.", "No?", "and so", " ", None, "Is it!\n", "end . ", "longer text without an end"]
    rows = []
    for conv in [*range(60), None]:
        for turn in sorted(rng.sample(range(8), rng.randint(1, 4))):
            rows.append((conv, turn if rng.random() < 0.95 else None, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""]), rng.choice(texts)))
    unique = {(r[0], r[1], r[2]): r for r in rows}
    return list(unique.values())


@pytest.mark.parametrize("part", [1, 2, 256])
def test_repairs_equal_brute_force(spark, table, part):
    df = spark.createDataFrame(table, SCHEMA)
    assert result(c.repair(c.damaged(df), part)) == brute(table)


def test_repeated_rows_and_clashing_columns(spark, table):
    twice = [r for r in table for _ in range(1 + (r[0] or 0) % 2)][:70]
    df = spark.createDataFrame(twice, SCHEMA).withColumns({n: F.lit("clash") for n in ["same", "mark", "times", "kind", "part", "place", "first", "whole", "state"]})
    assert result(c.repair(c.damaged(df))) == brute(twice)


def test_nothing_gives_nothing(spark):
    assert c.repair(c.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_a_long_conversation_is_the_same_in_one_part_and_in_many(spark):
    rng = random.Random(8)
    rows = [(1, k, rng.choice(["user", "assistant", "assistant"]), rng.choice(["a.", "b", f"{k}!", "x" * 500])) for k in range(700)] + [(2, 0, "user", "hi.")]
    df = c.damaged(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    many, one = result(c.repair(df, 7)), result(c.repair(df, 10_000))
    assert many == one and len(many[1][6]) >= 600


def test_an_item_is_final_when_it_is_popped_first():
    # Both ways cost 4; the letters decide.
    found = next(x for x in c.lightest(c.edits(["a"], [None]), lambda at, state: at == 1 and state in c.ENDS))
    assert found == (c.ASSISTANT, 2, "IK")
    found = next(x for x in c.lightest(c.edits(["s", "s"], [None, None]), lambda at, state: at == 2 and state in c.ENDS))
    assert found == (c.ASSISTANT, 4, "KIR")
    assert list(c.replay([("system", "x"), ("system", "y")], "KIR")) == [("system", "x"), ("user", ""), ("assistant", "y")]
