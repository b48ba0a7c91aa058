"""Prefix tries against brute force, parentheses against a stack, edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tablewright.llm import prefix_trie as trie

RNG = np.random.default_rng(11)


def rebuild(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute_nodes(convs):
    """convs: (conv_id, turns) pairs; every node by looking at all beginnings."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(own) - 1) * n
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, ())))).encode()).hexdigest()
    return sorted((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], saved[p], digest(p)) for p, own in members.items())


def conversations():
    """Shared openings of several depths, copies, one opening that a third share, nulls, a long one, and an empty text."""
    rows = []
    for c in list(range(0, 130)) + [-3, -25, 400]:
        n = int(RNG.integers(1, 7))
        for t in range(n):
            text = f"hello again {RNG.integers(2)}" if t < 3 else f"word {RNG.integers(3)} more"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "the same" if c % 3 == 0 and t == 0 else text))
    rows += [(500, t, "user", f"t{t}") for t in range(300)] + [(501, t, "user", f"t{t}") for t in range(290)]
    rows += [(600, None, None, None), (600, 1, "user", None), (600, None, "user", ""), (None, 1, "user", "x"), (601, 0, "user", "😀 ü".encode("utf-16", "surrogatepass").decode("utf-16"))]
    return rows


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_trie_equals_brute_force(spark, shards):
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnsRenamed({}).selectExpr("*", "1 AS depth", "2 AS spine", "'x' AS words", "3 AS n")
    for build, want in ((lambda s: s, rows_as_they_are(rows)), (trie.rebuilt, rebuild(rows))):
        got = trie.prefix_trie(build(trie.sequences(frame)), shards)
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(brute_nodes(want.items()), key=str)


def rows_as_they_are(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in own.items()}


def test_empty_table_has_no_nodes(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.rebuilt(trie.sequences(none))).collect() == []


def test_find_close_equals_a_stack():
    for size in (1, 2, 63, 64, 65, 1000, 5000):
        for deep in (0.5, 0.9):
            bits, open_ = [1], 1
            while len(bits) < 2 * size - open_:
                if open_ == 1 or RNG.random() < deep:
                    bits.append(1)
                    open_ += 1
                else:
                    bits.append(0)
                    open_ -= 1
            bits += [0] * open_
            stack, want = [], {}
            for k, b in enumerate(bits):
                if b:
                    stack.append(k)
                else:
                    want[stack.pop()] = k
            own = trie.Parentheses(np.array(bits, np.int8))
            assert own.find_close().tolist() == [want[k] for k in own.opens.tolist()]


def test_common_turns():
    a, b = b"x" * 16 + b"y" * 16, b"x" * 16 + b"y" * 15 + b"z"
    assert [trie.common_turns(*p) for p in ((a, a), (a, b), (a, a[:16]), (a, b""), (b"", b""))] == [2, 1, 1, 0, 0]
