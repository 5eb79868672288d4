"""Repair of conversations against a plain search over whole conversations, and against the SQL."""

import hashlib
import random
import zlib
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.llm.oracles import ORACLES
from cairn.llm.repair import Repair, repaired

SCHEMA = "conv_id long, turn long, role string, text string"
ON = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_ = (" " if v is None else v for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def plain_one(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    @lru_cache(None)
    def best(k, state, inserts=0):
        """(cost, audit, lines) of what is left; the last initial said is the state."""
        found = []
        if k == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            cost, audit, lines = best(k + 1, state)
            found.append((cost + 3, "D" + audit, lines))
            if faults[k] in ("", "truncated"):
                late = faults[k] == "truncated"
                initial = rows[k][2][:1]
                if initial == ON[state] or state == "" and initial == "s":
                    cost, audit, lines = best(k + 1, initial)
                    found.append((cost + late, "K" + audit, (f"{rows[k][2]}:{rows[k][3]}", *lines)))
                cost, audit, lines = best(k + 1, ON[state])
                found.append((cost + 2 + late, "R" + audit, (f"{NAMES[ON[state]]}:{rows[k][3]}", *lines)))
        if inserts < 3:
            rest = best(k, ON[state], inserts + 1)
            if rest:
                found.append((rest[0] + 2, "I" + rest[1], (f"{NAMES[ON[state]]}:", *rest[2])))
        return min(found) if found else None

    cost, audit, lines = best(0, "") if rows else (0, "", ())
    count = faults.count
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows):
    damaged = plain_damage(rows)
    return {conv: plain_one([r for r in damaged if r[0] == conv]) for conv in {r[0] for r in rows}}


def got(spark, rows, **how):
    return {r[0]: tuple(r)[1:] for r in repaired(spark.createDataFrame(rows, SCHEMA), **how).collect()}


def by_sql(rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    result = db.sql(ORACLES["op12_conversation_repair"])
    return {r[0]: r[1:] for r in result.fetchall()}


def random_rows(seed, conversations=40, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "", "ufo"])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, rng.choice(["Yes.", "No", "Is it?", "", None, " \t", "Go! ", "ß.", "a "])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_search_and_sql(spark, seed):
    rows = random_rows(seed)
    want = plain(rows)
    assert got(spark, rows) == want
    assert by_sql(rows) == want


def test_long_conversations_in_many_chunks(spark):
    rng = random.Random(7)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"t{k}.") for k in range(150)]
    rows += [(2, k, "system", f"t{k}.") for k in range(150)]  # never converges: chunks of one role swap two vectors
    rows += [(3, k, "user", f"t{k}") for k in range(151)]
    rows += [(4, k, "user", "same.") for k in range(60)] + [(4, 60 + k, "assistant", f"t{k}.") for k in range(60)]
    rows += [(5, 0, "system", "s.")] + [(5, k, ("assistant", "user")[k % 2], f"t{k}.") for k in range(1, 150)]
    rows += [(None, None, "user", "same.")] * 40 + random_rows(9, 5)
    want = plain(rows)
    assert got(spark, rows, how=Repair(piece=7)) == want
    assert got(spark, rows) == want


def test_awkward_rows(spark):
    rows = [
        (None, None, None, None), (1, None, None, None), (2, 0, "user", "x" * 200_000 + "."), (2, 1, "assistant", "y."), (3, -(2**62), "user", "a."),
        (3, 2**62, "assistant", "b."), (4, 0, "system", "only."), (5, 1, "user", "\x00."), (5, 1, "user", "\x00."), (5, 1, "assistant", "é\n."),
    ]
    assert got(spark, rows) == plain(rows)
    assert repaired(spark.createDataFrame([], SCHEMA)).collect() == []
    clash = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("key", "place", "chunk", "n", "code", "edit", "conv", "kind")))
    assert {r[0]: tuple(r)[1:] for r in repaired(clash).collect()} == plain(rows)
