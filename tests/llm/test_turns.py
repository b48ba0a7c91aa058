"""Repairs against all edit sequences, digests against texts, odd rows."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tablewright.llm import turns

RNG = np.random.default_rng(13)
SOUND = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        out.append("blank" if BLANK.fullmatch(text) else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_repair(rows):
    """The cheapest edits by looking at them in order of (cost, audit); roles so far tell which beginnings are hopeless."""
    kinds = faults(rows)
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, at, roles, kept = heapq.heappop(heap)
        if at == len(rows) and SOUND.fullmatch(roles):
            return cost, audit, list(kept)
        todo = []
        for initial, role in (("u", "user"), ("a", "assistant")):
            if audit[-2:] != "II":
                todo.append((5, "I", 0, initial, (role, "")))
            if at < len(rows) and kinds[at] not in ("blank", "duplicate"):
                todo.append((1 + 5 * (kinds[at] == "truncated"), "R", 1, initial, (role, rows[at][1])))
        if at < len(rows):
            todo.append((2, "D", 1, "", None))
            if kinds[at] not in ("blank", "duplicate") and rows[at][0][:1] in tuple("sua"):
                todo.append((5 * (kinds[at] == "truncated"), "K", 1, rows[at][0][0], rows[at]))
        for more, letter, step, initial, row in todo:
            after = roles + initial
            if SOUND.fullmatch(after) or SOUND.fullmatch(after + "a") or after == "s":
                heapq.heappush(heap, (cost + more, audit + letter, at + step, after, (*kept, row) if row else kept))
    raise AssertionError


def report(conv, rows):
    kinds = faults([r[1:] for r in rows])
    cost, audit, kept = best_repair([r[1:] for r in rows])
    known = sorted({t for t, _, _ in rows if t is not None})
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    body = "\n".join(f"{r}:{t}" for r, t in kept)
    return (conv, known[-1] - known[0] + 1 - len(known) if known else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())


def conversations(n=250):
    texts = ["Good day.", "And then?", "It broke off", " \t\n", "", "Yes!  ", "one.two", "…", "üñ 😀."]
    roles = ["user", "assistant", "system", "tool", "", "sys"]
    out = {}
    for c in range(n):
        size, turn, own = int(RNG.integers(1, 7)), int(RNG.integers(-2, 3)), []
        for _ in range(size):
            own.append((turn, str(RNG.choice(roles, p=[0.38, 0.34, 0.1, 0.08, 0.05, 0.05])), str(RNG.choice(texts))))
            turn += int(RNG.choice([1, 1, 1, 2, 5]))
        out[c] = own
    return out


def test_parse_equals_all_edits():
    for rows in conversations(400).values():
        code = bytes("sua".find(r[:1] or " ") + 1 | 4 * (k in ("blank", "duplicate")) | 8 * (k == "truncated") for (_, r, _), k in zip(rows, faults([x[1:] for x in rows])))
        assert turns.parse(code) == best_repair([x[1:] for x in rows])[:2]


def test_setting_aside_a_common_beginning_changes_nothing(monkeypatch):
    codes = [bytes(RNG.choice([1, 2, 3, 2, 3, 6, 10, 11], 400).astype(np.uint8)) for _ in range(20)]
    whole = [turns.parse(c) for c in codes]
    monkeypatch.setattr(turns, "STEP", 3)
    assert [turns.parse(c) for c in codes] == whole


def test_reports_and_digests(spark):
    convs = conversations()
    convs[9001] = [(t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3001)]
    convs[9002] = [(None, "user", "Hi."), (0, "assistant", "Ho.")]
    convs[9003] = [(None, " ", " "), (None, "user", "same.")]
    rows = [(c, *r) for c, own in convs.items() for r in own]
    rows += [(None, 1, "user", "No name."), (None, 2, "assistant", "Indeed.")]
    null = lambda c, t, r, x: (c, t, None if r == " " else r, None if x == " " else x)
    frame = spark.createDataFrame([null(*r) for r in rows], "conv_id long, turn long, role string, text string")
    frame = frame.selectExpr("*", "1 AS a", "'x' AS code", "2 AS audit", "3 AS place")
    reports = turns.repair_reports(frame)
    digests = turns.turn_digests(turns.repaired_turns(frame, reports)).collect()
    digests = {r.conv_id: r.sha256 for r in digests}
    got = sorted(((*r, digests.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in reports.collect()), key=str)
    convs[None] = [(1, "user", "No name."), (2, "assistant", "Indeed.")]
    long = {9001}
    want = sorted((report(c, own) for c, own in convs.items() if c not in long), key=str)
    assert [r for r in got if r[0] not in long] == want
    own = next(r for r in got if r[0] == 9001)  # the last question stays without an answer
    assert own[1:8] == (0, 0, 0, 0, 0, 2, "K" * 3000 + "D")


def test_damage_and_conversations_without_turns(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Turn {t}. Really?") for c in range(60) for t in range(3)] + [(7, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    hurt = turns.damaged(frame)
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in hurt.filter("not dropped").collect()), key=str)
    want = []
    for c, t, role, text in rows:
        role, text, fault = role or " ", text or " ", zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = "" if fault == 1 else re.sub(r"[.!?]", "", text) if fault == 2 else text
        want += [(c, t, "user" if fault == 4 else role, text)] * (fault != 0) * (2 if fault == 3 else 1)
    assert got == sorted(want, key=str)
    gone = turns.repair_reports(hurt.withColumn("dropped", F.lit(True)), ~F.col("dropped")).collect()
    assert sorted(tuple(r) for r in gone) == [(c, 0, 0, 0, 0, 0, 0, "") for c in range(60)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    reports = turns.repair_reports(none)
    assert reports.collect() == [] and turns.turn_digests(turns.repaired_turns(none, reports)).collect() == []
