"""Conversation repair against a search over every string of edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scoutframe.llm.conversation import damaged, lightest, repair_conversations, turns_digest

SCHEMA = "conv_id long, turn long, role string, text string, part int, block long, turns string, who string"
ROLES = ["user", "assistant", "system", "tool", "", None, "superuser"]
LINES = ["Hello there.", "And then?", "cut off", "", " \n\t", None, "Yes!", "naïve … end. ", "done. \n"]


def brute(turns):
    """(blank, duplicate, truncated, illegal, cost, audit, lines) by trying all edits with up to two insertions a gap."""
    faults, seen = [], set()
    for role, text in turns:
        told = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not told else "d" if (role, text) in seen else "t" if told[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    for letters in itertools.product(*["D" if f in ("b", "d") else "DKR" for f in faults]):
        for gaps in itertools.product(range(3), repeat=len(turns) + 1):
            audit = "".join("I" * g + x for g, x in zip(gaps, letters)) + "I" * gaps[-1]
            cost = sum({"D": 3, "K": 0, "R": 2, "I": 2}[x] for x in audit)
            cost += sum(f == "t" and x != "D" for f, x in zip(faults, letters))
            if best is not None and (cost, audit) >= best[:2]:
                continue
            out, at = [], 0
            for x in audit:
                role, text = ("", "") if x == "I" else turns[at]
                at += x != "I"
                if x == "K":
                    out.append((role[:1] or "?", f"{role}:{text}"))
                elif x in "RI":  # whichever role the place wants
                    want = "a" if out and out[-1][0] == "u" else "u"
                    out.append((want, f"{'user' if want == 'u' else 'assistant'}:{text}"))
            if re.fullmatch("(s?(ua)+)?", "".join(x for x, _ in out)):
                best = cost, audit, [line for _, line in out]
    pairs = zip(turns, turns[1:])
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs)
    return faults.count("b"), faults.count("d"), faults.count("t"), illegal, *best


def ordered(rows):
    def key(r):
        text = r[3]
        return (r[1] is not None, r[1] or 0, r[2].encode(), text[:200].encode(), hashlib.sha256(text.encode()).hexdigest())

    return sorted(((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows), key=key)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = ordered([r for r in rows if r[0] == conv])
        turns = {t for _, t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *brute([(r, x) for _, _, r, x in mine]))
    return out


def made_up(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(conversations), None]:
        for _ in range(rng.randint(1, most)):
            turn = rng.choice([None, 0, 1, 2, 5, 9])
            rows.append((conv, turn, rng.choice(ROLES[:3] * 2 + ROLES), rng.choice(LINES)))
    return rows + rows[:2]  # and whole rows repeated


@pytest.fixture(scope="module")
def rows():
    return made_up(3, 40, 4)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(3)


def collected(parts):
    found, lines = {}, {}
    for r in sorted(parts.collect(), key=lambda r: r.part):
        if r.part == 0:
            assert r.conv_id not in found
            found[r.conv_id] = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit)
        lines.setdefault(r.conv_id, []).extend(f"{t.role}:{t.text}" for t in r.turns)
    return {k: (*v, lines[k]) for k, v in found.items()}


@pytest.mark.parametrize("long_rows", [1024, 2, 1])
def test_repairs_equal_brute_force(spark, rows, long_rows):
    """Whole, and cut into blocks of two turns and of one."""
    parts = repair_conversations(frame(spark, rows), long_rows=long_rows)
    assert collected(parts) == expected(rows)
    if long_rows < 3:
        assert parts.agg(F.max("parts")).first()[0] > 1


@pytest.mark.parametrize("long_rows", [1024, 3])
def test_digest_is_that_of_all_lines(spark, rows, long_rows):
    got = {r.conv_id: r.repaired_sha256 for r in turns_digest(repair_conversations(frame(spark, rows), long_rows=long_rows)).collect()}
    assert got == {k: hashlib.sha256("\n".join(v[-1]).encode()).hexdigest() for k, v in expected(rows).items()}


def test_a_long_conversation_in_blocks_equals_the_whole(spark):
    rng = random.Random(8)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(LINES[:3]) + str(rng.randrange(90)) + ".") for i in range(700)]
    rows += [(7, 900, "user", "the same line.")] * 300  # copies of one turn, more than a block holds
    whole = collected(repair_conversations(frame(spark, rows)))
    blocks = repair_conversations(frame(spark, rows), long_rows=64)
    assert blocks.count() > 12
    assert collected(blocks) == whole
    assert whole[7][2] >= 299


def test_the_goal_is_popped_lightest_and_least():
    for seed in range(300):
        rng = random.Random(seed)
        n = rng.randint(0, 5)
        turns = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "c!", ""])) for _ in range(n)]
        seen, faults = set(), []
        for role, text in turns:
            faults.append(1 if not text else 2 if (role, text) in seen else 3 if text == "b" else 0)
            seen.add((role, text))
        assert lightest([r[:1] for r, _ in turns], faults)[None] == brute(turns)[4:6]


def test_empty_table_and_damage(spark):
    none = frame(spark, [(1, 1, "user", "x.")]).where("false")
    assert turns_digest(repair_conversations(none)).count() == 0
    rows = made_up(5, 60, 6)
    want = []
    for c, t, r, x in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x
        want += [(c, t, "user" if how == 4 else r, x)] * (0 if how == 0 else 2 if how == 3 else 1)
    got = [tuple(r) for r in damaged(frame(spark, rows)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
