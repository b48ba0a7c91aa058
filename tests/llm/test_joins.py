"""Jaccard components, substring dedup, decontamination, fingerprints: brute force and edge cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, jaccard, substring, winnow
from tablewright.llm.common import held_out  # noqa: F401
from tablewright.llm.components import components
from tablewright.llm.sketch import Repeats, build_repeats, with_levels

RNG = np.random.default_rng(5)
WORDS = [f"w{i}" for i in range(400)]


def noisy(words: list[str], edits: int) -> list[str]:
    out = list(words)
    for _ in range(edits):
        out[RNG.integers(len(out))] = f"new{RNG.integers(10**6)}"
    return out


def corpus() -> list[tuple[int, str]]:
    """A large group of near copies, a chain of drifting copies, passages in many documents, exact copies, and others."""
    base, shared = list(RNG.choice(WORDS, 120)), list(RNG.choice(WORDS, 40))
    texts = [noisy(base, int(RNG.integers(0, 5))) for _ in range(60)]
    drift = list(RNG.choice(WORDS, 100))
    for _ in range(25):
        texts.append(drift)
        drift = noisy(drift, 2)
    texts += [list(RNG.choice(WORDS, int(RNG.integers(1, 80)))) + shared for _ in range(40)]
    texts += [list(RNG.choice(WORDS, int(RNG.integers(1, 12)))) for _ in range(60)]
    texts += [texts[0], texts[70], texts[100], texts[100]]
    order = RNG.permutation(len(texts))
    return [(int(i), " ".join(texts[k])) for i, k in enumerate(order)]


ROWS = corpus()


def shingles(text: str | None, size: int = 5) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize("known", [True, False])
def test_components_equal_brute_force(spark, monkeypatch, known):
    if not known:  # without a sketch every shingle counts as repeated
        monkeypatch.setattr(jaccard, "build_repeats", lambda *a: Repeats(21, [], []))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs).collect()}
    want = brute_components(ROWS)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 80


def small_sketches(monkeypatch):
    """Sketches that are asked, of many chunks and blocks."""
    for name, value in {"BLOCK_BITS": 8, "CHUNK": 700, "WIDE_BLOCK_BITS": 9}.items():
        monkeypatch.setattr(f"tablewright.llm.sketch.{name}", value)
    for user in (jaccard, substring):
        monkeypatch.setattr(user, "fits", lambda expected: False)


def test_components_by_a_sketch_that_answers(spark, edge, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(7)
    order = ["doc_id", "n_shingles", "component_id"]
    plain = [sorted(map(str, jaccard.similar_components(d).select(*order).collect())) for d in (docs, edge)]
    small_sketches(monkeypatch)
    assert [sorted(map(str, jaccard.similar_components(d).select(*order).collect())) for d in (docs, edge)] == plain


def test_levels_by_answers_equal_counts(spark, monkeypatch):
    small_sketches(monkeypatch)
    values = np.concatenate([RNG.integers(0, 3000, 4000), np.full(1500, 7), RNG.integers(10**6, 10**9, 500)])
    RNG.shuffle(values)
    rows = spark.createDataFrame([(i, values[a : a + n].tolist()) for i, (a, n) in enumerate(zip(range(0, 6000, 50), [50] * 120))], "key long, v array<long>")
    hashes = lambda b: [np.asarray(v, np.int64).astype(np.uint64) for v in b["v"]]
    use = lambda b, own, levels: pd.DataFrame({"v": np.concatenate(own).astype(np.int64), "level": np.concatenate(levels).astype(np.int64)})
    got = with_levels(rows, hashes, use, "v long, level long", 6000).collect()
    counts = Counter(values.tolist())
    assert Counter(r.v for r in got) == counts
    level = {r.v: r.level for r in got}
    assert len({(r.v, r.level) for r in got}) == len(level) and all(level[v] >= (n > 1) for v, n in counts.items())
    assert level[7] == 10 and np.mean([level[v] == 0 for v, n in counts.items() if n == 1]) > 0.6


def test_components_of_edge_rows(edge, none):
    rows = jaccard.similar_components(edge).collect()
    assert len(rows) == edge.count()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [got[k].n_shingles for k in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 3]
    assert {got[k].component_id for k in (5, 6)} == {5} and {got[k].component_id for k in (7, 8)} == {7}
    assert [got[k].component_id for k in (1, 2, 3, 4, 9)] == [1, 2, 3, 4, 9]
    assert jaccard.similar_components(none).count() == 0


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 120)] + [(300, 200), (5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 120)} == {100} and got[300] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_never_misses_a_repeat(spark, monkeypatch):
    monkeypatch.setattr("tablewright.llm.sketch.FLUSH", 500)
    values = RNG.integers(0, 5000, 20_000)
    rows = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(5)
    found = build_repeats(rows, lambda b: b["v"].to_numpy().astype(np.uint64), 20_000)
    counts = Counter(values.tolist())
    keys = np.array(sorted(counts), np.uint64)
    repeated, level = found(keys), found.level(keys)
    assert all(r for k, r in zip(keys, repeated) if counts[int(k)] > 1)
    single = [not r for k, r in zip(keys, repeated) if counts[int(k)] == 1]
    assert not single or np.mean(single) > 0.9
    assert all(2 ** int(v) <= 2 * counts[int(k)] + 20 for k, v in zip(keys, level) if v)
    assert Repeats(21, [], []).level(keys).tolist() == [1] * len(keys)


def brute_removal(rows, window=13):
    first: dict[tuple, int] = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, t in rows:
        w = (t or "").encode().split()
        gone = {p for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for p in range(i, i + window)}
        out[d] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    return out


def test_removal_by_a_sketch_that_answers(spark, edge, none, monkeypatch):
    small_sketches(monkeypatch)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(7)
    rows = substring.without_repeats(docs).select("doc_id", "dedup.*").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == brute_removal(ROWS)
    assert substring.without_repeats(edge).count() == edge.count() and substring.without_repeats(none).count() == 0


@pytest.mark.parametrize("limit", [substring.BROADCAST_BYTES, 0])
def test_removal_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(substring, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(substring, "FLUSH", 700)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(6)
    got = {r.doc_id: tuple(r.dedup) for r in substring.without_repeats(docs).collect()}
    assert got == brute_removal(ROWS)


def test_removal_of_edge_rows(edge, none):
    rows = substring.without_repeats(edge).collect()
    assert len(rows) == edge.count() and rows[0].__fields__[:3] == ["doc_id", "text", "lang"]
    got = {r.doc_id: r.dedup for r in rows if r.doc_id is not None}
    assert tuple(got[1]) == (0, 0, "") and tuple(got[3]) == (0, 0, "") and got[6].n_removed == 0
    assert got[7].n_removed == 0 and (got[8].n_words, got[8].n_removed, got[8].kept) == (60_001, 60_000, "end")
    assert substring.without_repeats(none).count() == 0


def colliding_texts() -> tuple[bytes, bytes]:
    """Two texts of 64 bytes with the same xxhash64: the second half undoes in each lane what the first half changed."""
    one, two, mask = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 2**64 - 1
    turn = lambda v: (v << 31 | v >> 33) & mask
    x, y = [], []
    for lane, seed in enumerate((42 + one + two, 42 + two, 42, 42 - one)):
        a, b = (turn((seed + w * two) & mask) * one & mask for w in (1000 + lane, 2000 + lane))
        x.append((1000 + lane, 7))
        y.append((2000 + lane, (7 + (a - b) * pow(two, -1, 2**64)) & mask))
    return tuple(b"".join(lane[half].to_bytes(8, "little") for half in (0, 1) for lane in t) for t in (x, y))


def test_texts_of_one_hash_are_no_copies(spark):
    texts = [(k, t.hex()) for k, t in enumerate(colliding_texts())]
    rows = spark.createDataFrame(texts, "key long, h string").selectExpr("key", "cast(unhex(h) AS string) AS text")
    assert rows.selectExpr("xxhash64(text) AS h").distinct().count() == 1 and rows.select("text").distinct().count() == 2
    assert substring._copies(rows).count() == 0
    assert substring._copies(rows.union(rows.selectExpr("key + 5", "text"))).count() == 2


def test_a_row_beside_a_copy_of_its_id_keeps_its_words(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, "more " * 5 + a + " " + b), (3, b), (4, a)], "doc_id long, text string")
    got = {(r.doc_id, r.dedup.n_words): r.dedup.n_removed for r in substring.without_repeats(docs).collect()}
    assert got == {(1, 30): 0, (2, 30): 30, (2, 65): 30, (3, 30): 30, (4, 30): 30}


def test_rows_of_one_id_lose_their_own_words_only(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (2, "x y z " + a), (2, b), (None, a), (None, b + " tail")], "doc_id long, text string")
    got = {(r.doc_id, r.dedup.n_words): r.dedup.n_removed for r in substring.without_repeats(docs).collect()}
    assert got == {(None, 60): 0, (None, 61): 0, (1, 60): 60, (2, 63): 60, (2, 60): 60}
    unnamed = spark.createDataFrame([(1, a), (2, "x y z " + a), (2, b)], "doc_id long, text string")
    assert {r.text: r.dedup.n_removed for r in substring.without_repeats(unnamed).collect()} == {a: 0, "x y z " + a: 60, b: 0}


def test_ranges_merge():
    assert substring._merged(np.array([3, 4, 30, 5, 18]), 13) == [3, 43]
    assert substring._merged(np.array([1, 20]), 13) == [1, 14, 20, 33]


ITEMS = [
    (1, "alpha beta gamma"), (2, "Alpha! BETA"), (3, "solo"), (4, " ".join(f"q{i}" for i in range(25))), (5, None), (6, " ... "),
    (4, " ".join(f"q{i}" for i in range(25))), (7, " ".join(f"q{i}" for i in range(10))), (None, "nameless one here"),
]
TEXTS = [
    (1, "x alpha, beta gamma y"), (2, "alpha beta"), (3, "nothing at all"), (4, None), (5, ""), (6, "q1 q2"),
    (7, "z " + " ".join(f"q{i}" for i in range(3, 20)) + " z solo"), (8, "BETA alpha beta alpha beta gamma"),
    (9, " ".join(f"q{i}" for i in range(9))), (10, "nameless One-here"), (11, " ".join(["alpha beta gamma"] * 300)), (12, "Ä alphä beta"),
]


def brute_hits(text, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    words, hit, ids = cut(text), set(), set()
    for item, t in items:
        own = cut(t)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[i : i + size]:
                    hit |= set(range(at, at + size))
                    ids.add("" if item is None else str(item))
    sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(words), len(hit), len(ids), sha, bool(hit)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, 0])
def test_contamination_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    docs, items = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for r in decontaminate.contamination(docs, items).collect():
        text = dict(TEXTS)[r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_hits(text, ITEMS), r.doc_id


def test_beyond_the_broadcast_no_words_of_a_text_are_shuffled_by_place(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, items = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = decontaminate.contamination(docs, items)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    by_hash = [plan[i + 1] for i, line in enumerate(plan) if "Exchange hashpartitioning(sh#" in line]
    whole = re.compile(r"(?<![(\w])ws#\d+[,\]]")
    assert len(by_hash) == 2 and any("pos#" in line for line in by_hash) and not any(map(whole.search, by_hash)), by_hash
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), decontaminate.words(F.col("text")).alias("ws"))
    at = decontaminate._positions(texts, [1, 2, 3])
    assert at.filter("sh IS NULL").count() == len(TEXTS)  # one place past the end for each text, whatever the sizes


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, 0])
def test_contamination_of_repeated_rows_and_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rows = [(1, "x alpha beta gamma"), (1, "x alpha beta gamma"), (1, "solo other"), (1, None), (None, None), (None, None), (None, "solo"), (None, "plain")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(docs, items).collect()
    tell = lambda values: Counter(values)
    assert tell((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == tell((d, *brute_hits(t, ITEMS)) for d, t in rows)


def test_contamination_of_edge_rows(spark, edge, none):
    items = spark.createDataFrame([(1, "two three four"), (2, "w5x5 w6x6 w7x7 w8x8")], "item_id long, text string")
    rows = decontaminate.contamination(edge, items).collect()
    assert len(rows) == edge.count()
    got = {r.doc_id: r.n_hit for r in rows}
    assert (got[1], got[5], got[6], got[7], got[9]) == (0, 3, 3, 4, 0)
    assert decontaminate.contamination(none, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(edge, items.limit(0)).collect())


def brute_fingerprint(grams: list[int], window: int) -> set[int]:
    """Positions by the definition; the hash is cut as the operator cuts it."""
    cut = [(g % 2**64) >> 25 for g in grams]
    if len(cut) < window:
        return {max(i for i, h in enumerate(cut) if h == min(cut))} if cut else set()
    return {max(i for i in range(j, j + window) if cut[i] == min(cut[j : j + window])) for j in range(len(cut) - window + 1)}


def test_fingerprint_positions(spark):
    texts = ["a b a b a b a b a b a b a b c d e f g h a b a b", "one two", "", " ".join(WORDS[:60]), "x " * 40, "中文字word"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r.id: r.fp for r in winnow.with_fingerprint(df, "text", "fp").collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[一-鿿]|[^\s一-鿿]+", t)
        grams = [words[k : k + winnow.GRAM] for k in range(len(words) - winnow.GRAM + 1)] or ([words] if words else [])
        hashes = [spark.sql(f"SELECT xxhash64({'array(' * (len(words) < winnow.GRAM)}{', '.join(repr(w) for w in g)}{')' * (len(words) < winnow.GRAM)})").first()[0] for g in grams]
        entries = [e.split(":") for e in got[i].split()]
        assert {int(p) for p, _ in entries} == brute_fingerprint(hashes, winnow.WINDOW)
        assert all(int(h, 16) == hashes[int(p)] % 2**64 for p, h in entries)


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_next_document_and_likeness(spark, parts):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in winnow.fingerprints(docs, parts=parts).collect()}
    assert len(got) == len(ROWS)
    prints = {}
    for i, (d, t) in enumerate(ROWS):
        after = ROWS[(i + 1) % len(ROWS)]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[1][:k]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        sets = [{e.split(":")[1] for e in x.split()} for x in (r.fingerprint, r.edited_fingerprint, got[after[0]].fingerprint)]
        for value, other in ((r.near_edited, sets[1]), (r.near_next, sets[2])):
            assert abs(value - (len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1.0)) < 1e-9
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint


def test_fingerprints_of_edge_rows(edge, none):
    rows = winnow.fingerprints(edge, parts=4).collect()
    assert len(rows) == edge.count()
    got = {r.doc_id: r for r in rows}
    assert got[1].fingerprint == got[2].fingerprint == got[3].fingerprint == "" and got[1].near_edited == 1.0
    assert got[7].near_next > 0.99 and got[5].fingerprint == got[6].fingerprint
    assert winnow.fingerprints(none).count() == 0
