"""Repairs against a search over all edits, and rows that the docstrings speak of."""

import functools
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lineloom.llm import conversation_repair as cr


def cheapest(turns):
    """(cost, audit, lines) by trying every edit, with up to three insertions in a row; turns: (role, text, fault)."""

    @functools.cache
    def rest(j, state, run):
        options = [(0, "", ())] if j == len(turns) and state in ("", "a") else []
        following = "a" if state == "u" else "u"
        name = {"u": "user", "a": "assistant"}[following]
        if run < 3:
            options += [(c + 5, "I" + a, (f"{name}:", *lines)) for c, a, lines in [rest(j, following, run + 1)] if c is not None]
        if j < len(turns):
            role, text, fault = turns[j]
            options += [(c + 2, "D" + a, lines) for c, a, lines in [rest(j + 1, state, 0)] if c is not None]
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                options += [(c + 1 + extra, "R" + a, (f"{name}:{text}", *lines)) for c, a, lines in [rest(j + 1, following, 0)] if c is not None]
                if role[:1] == following or (role[:1] == "s" and state == ""):
                    options += [(c + extra, "K" + a, (f"{role}:{text}", *lines)) for c, a, lines in [rest(j + 1, role[:1], 0)] if c is not None]
        return min(options, default=(None, "", ()))

    return rest(0, "", 0)


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", "uno", "User", " "]


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_random_conversations_in_blocks(monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    r = random.Random(block)
    for _ in range(400):
        turns = [(r.choice(ROLES), f"t{i}", r.choice([None, None, None, "truncated", "blank", "duplicate"])) for i in range(r.randint(0, 9))]
        own = cr.Repair()
        for i, turn in enumerate(turns):
            own.add(i, *turn)
        cost, audit, lines = cheapest(tuple(turns))
        assert own.result()[5:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), turns
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


def test_a_long_conversation_is_one_of_blocks(monkeypatch):
    r = random.Random(9)
    turns = [(r.choice(ROLES), "t", r.choice([None, "truncated", "blank"])) for _ in range(300)]
    got = []
    for block in (64, 300):
        monkeypatch.setattr(cr, "BLOCK", block)
        own = cr.Repair()
        for i, turn in enumerate(turns):
            own.add(i, *turn)
        got.append(own.result())
    assert got[0] == got[1] and len(got[0][6].replace("I", "")) == 300


def summary(rows):
    """The contract, row by row in Python."""
    rows = sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    seen, turns, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.strip(cr.BLANKS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        turns.append((role, text, fault))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = cheapest(tuple(turns))
    return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_tables(spark):
    r = random.Random(6)
    texts = ["Yes.", "No!", "Well", " ", "", "a.\n", "a. b\x0b", "\x1c", "Why? ", "..."]
    rows = [(r.choice([1, 2, 3, None, 5, 6]), r.choice([None, *range(9)]), r.choice([*ROLES, None]), r.choice([*texts, None])) for _ in range(60)]
    frame = spark.createDataFrame([(*x, "old", 1) for x in rows], "conv_id long, turn long, role string, text string, audit string, present int").repartition(5)
    got = {x["conv_id"]: tuple(x)[1:] for x in cr.repair(frame).collect()}
    want = {c: summary([(t, ro if ro is not None else " ", tx if tx is not None else " ") for own, t, ro, tx in rows if own == c]) for c in {x[0] for x in rows}}
    assert got == want
    assert cr.repair(frame.limit(0)).count() == 0


def test_repaired_turns_are_those_of_the_digest(spark):
    r = random.Random(8)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "No!", "Well", ""])) for c in [None, 1, 2, 3, 4] for t in range(7)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    repairs = cr.repair(frame)
    left = {}
    for x in cr.repaired_turns(frame, repairs).orderBy("conv_id", "place").collect():
        left.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    for x in repairs.collect():
        assert hashlib.sha256("\n".join(left.get(x.conv_id, [])).encode()).hexdigest() == x.repaired_sha256


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in [None, *range(5)]] + [(None, 1, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        bad = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = {1: "", 2: text.translate({ord(x): None for x in ".!?"})}.get(bad, text)
        want += [(str(c), str(t), "user" if bad == 4 else role, text, bad != 0)] * (2 if bad == 3 else 1)
    got = [(str(x.conv_id), str(x.turn), x.role, x.text, x.present) for x in cr.damaged(frame).collect()]
    assert sorted(got) == sorted(want)
    empty = cr.repair(cr.damaged(frame).withColumn("present", F.lit(False)), present=F.col("present"))
    assert empty.count() == 31 and empty.distinct().drop("conv_id").distinct().collect() == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
