"""Repair of conversations against a plain search for the least way."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tendril.llm.repair import damaged, repaired

SCHEMA = "conv_id long, turn long, role string, text string, audit string, place string"
BLANKS = " \t\n\x0b\x0c\r"


def least(rows):
    """(cost, edits, lines) of the cheapest repair, edits least in ASCII; rows are (role, text, must go, truncated)."""
    end = {"": (0, "", ()), "s": (10, "II", ("user:", "assistant:")), "u": (5, "I", ("assistant:",)), "a": (0, "", ())}
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    word = {"u": "user", "a": "assistant"}
    after = end
    for role, text, gone, cut in reversed(rows):
        more = 5 * cut
        here = {}
        for s in after:
            ways = [(after[s][0] + 2, "D" + after[s][1], after[s][2])]
            if not gone:
                to = after[due[s]]
                ways.append((to[0] + 1 + more, "R" + to[1], (f"{word[due[s]]}:{text}",) + to[2]))
                if role[:1] == due[s] or (s == "" and role[:1] == "s"):
                    to = after[role[:1]]
                    ways.append((to[0] + more, "K" + to[1], (f"{role}:{text}",) + to[2]))
            here[s] = min(ways)
        for _ in range(3):
            for s in here:
                to = here[due[s]]
                here[s] = min(here[s], (to[0] + 5, "I" + to[1], (word[due[s]] + ":",) + to[2]))
        after = here
    return after[""]


def plain(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        convs[conv].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, turns in convs.items():
        turns.sort()
        seen, faults, blank, duplicate, truncated = set(), [], 0, 0, 0
        for _, _, role, text in turns:
            core = text.strip(BLANKS)
            again = (role, text) in seen
            cut = bool(core) and not again and core[-1] not in ".!?"
            blank, duplicate, truncated = blank + (not core), duplicate + (bool(core) and again), truncated + cut
            faults.append((role, text, not core or again, cut))
            seen.add((role, text))
        initials = [t[2][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        numbers = {t[1] for t in turns if t[0]}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit, lines = least(faults)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        out.append((conv, gaps, blank, duplicate, truncated, illegal, cost, audit, "\n".join(lines) if lines else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,size", [(1, 256), (2, 3), (3, 1), (4, 7)])
def test_against_plain(spark, seed, size):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(25)]:
        n = rng.choice([1, 2, 3, 5, 8, 13, 40])
        for k in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", " \t", "", None, "a!", "b? ", "ü", f"{k}.", f"{k}", f"own {k}!"])
            rows.append((conv, rng.choice([k, k, k + 3, None]), role, text, "x", "y"))
    rows += rows[:7]
    got = repaired(spark.createDataFrame(rows, SCHEMA).repartition(5), size).collect()
    assert sorted(((*r[:-1], r.repaired or "") for r in got), key=repr) == plain(rows)


def test_one_long_conversation(spark):
    """One conversation of many chunks, with a stretch of blank rows that vectors pass through unchanged."""
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"text {k}" + rng.choice([".", ".", ""]), "", "") for k in range(900)]
    rows[300:420] = [(1, k, "user", " " * (k - 299), "", "") for k in range(300, 420)]
    rows += [(1, 1000 + k, "user", "The same again.", "", "") for k in range(50)] + [(2, 1, "system", "s.", "", "")]
    got = repaired(spark.createDataFrame(rows, SCHEMA), 32).collect()
    assert sorted(((*r[:-1], r.repaired or "") for r in got), key=repr) == plain(rows)


def test_many_equal_rows_and_none(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.lit(4).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    r = repaired(df).first()
    assert (r.duplicate, r.illegal, r.cost, r.audit, r.repaired) == (19_999, 19_999, 2 * 20_000, "D" * 20_000, "")
    assert repaired(df.limit(0)).count() == 0


def test_damage(spark):
    from zlib import crc32

    rows = [(c, t, "assistant", "One. Two! Three?", "", "") for c in range(20) for t in range(10)] + [(None, None, None, None, "", "")]
    got = defaultdict(list)
    for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got[(r.conv_id, r.turn)].append((r.role, r.text))
    for conv, turn, role, text, *_ in rows:
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: [], 1: [(role, "")], 2: [(role, re.sub("[.!?]", "", text))], 3: [(role, text)] * 2, 4: [("user", text)]}.get(kind, [(role, text)])
        assert got[(conv, turn)] == want
