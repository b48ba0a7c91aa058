"""Segmentation: brute force over all paths, the library's own N-best on a unigram model, round trips."""

from __future__ import annotations

import random
import struct

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tablewright.llm import segment
from tablewright.llm.pieces import SPACE, fields, read_model

MODEL = read_model()
OWN = segment.Segmenter(MODEL)


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def put(number: int, wire: int, value) -> bytes:
    head = varint(number << 3 | wire)
    return head + (varint(value) if wire == 0 else varint(len(value)) + value if wire == 2 else value)


def as_unigram() -> bytes:
    """The same model as a unigram one whose scores are ours."""
    out, at = b"", 0
    for number, wire, value in fields(MODEL):
        if number == 1:
            own = [(n, w, struct.pack("<f", OWN.scores[at]) if n == 2 else v) for n, w, v in fields(value)]
            value, at = b"".join(put(*f) for f in own), at + 1
        elif number == segment.TRAINER:
            own = [(n, w, v) for n, w, v in fields(value) if n != segment.KIND] + [(segment.KIND, 0, segment.UNIGRAM)]
            value = b"".join(put(*f) for f in own)
        out += put(number, wire, value)
    return out


def paths(unit: str) -> list:
    arcs, _ = OWN.lattice(unit)
    found = []

    def walk(at, score, ids):
        if at == len(unit):
            found.append((score, OWN._flat(ids)))
        for s, e, i, own in arcs:
            if s == at:
                walk(e, score + own, ids + [i])

    walk(0, 0.0, [])
    return sorted(found, key=lambda x: -x[0])


@pytest.mark.parametrize("text", ["hello there", "the the", "internation", "a", "aaaaaa", "x\ny", "中x", "▁a", "  b", "é\U0001f600"])
@pytest.mark.parametrize("n", [1, 2, 5, 12])
def test_n_best_equals_all_paths(text, n):
    every = paths(SPACE + text.replace(SPACE, segment.LITERAL_MARK).replace(" ", SPACE))
    units, scores, changes = OWN.encode(text, n)
    assert len(scores) == min(n, len(every))
    assert all(abs(a - b[0]) < 1e-9 for a, b in zip(scores, every))
    best = units
    found = [tuple(best)] + [tuple(segment.apply_changes(best, c)) for c in changes]
    score_of = {ids: s for s, ids in every}
    assert len(set(found)) == len(found)
    assert all(abs(score_of[ids] - s) < 1e-9 and OWN.decode(ids) == text for ids, s in zip(found, scores))


def test_search_completes_paths_best_first():
    for unit in ("▁undisputed", "▁notation", "▁re"):
        every = paths(unit)
        assert [round(s, 9) for s, _ in OWN.n_best(unit, 30)] == [round(s, 9) for s, _ in every[:30]]


def test_words_of_one_length_together_equal_one_by_one():
    rng = random.Random(2)
    units = list({SPACE * rng.randrange(3) + "".join(rng.choice("etaoinshé中ß'.,\n1A") for _ in range(rng.randrange(1, 30))) for _ in range(400)})
    for unit, (ids, score, gap) in OWN.viterbi_batch(units).items():
        one = OWN.viterbi(unit)
        assert ids == one[0] and abs(score - one[1]) < 1e-9 and (gap == one[2] or abs(gap - one[2]) < 1e-9)
        two = OWN.n_best(unit, 2)
        assert abs(two[0][0] - score) < 1e-9 and (len(two) < 2) == (gap == float("inf"))
        assert len(two) < 2 or abs(two[0][0] - two[1][0] - gap) < 1e-9


def test_library_finds_the_same_on_the_unigram_model(tmp_path):
    path = tmp_path / "unigram.model"
    path.write_bytes(as_unigram())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    for text in ("hello there my friend", "the quick brown fox jumps", "unbelievable interoperability", "Das ist eine Straße"):
        own = segment.Segmenter(as_unigram()).encode(text, 4)
        theirs = library.nbest_encode_as_ids(text, 4)
        score = lambda ids: sum(OWN.scores[i] for i in ids)
        assert all(abs(score(a) - b) < 1e-3 for a, b in zip(theirs, own[1]))


def test_columns(spark, edge):
    coded = edge.select("text", segment.encode_pieces(F.col("text"), MODEL).alias("p")).select("text", "p", segment.decode_pieces(F.col("p.ids"), MODEL).alias("back"))
    for r in coded.collect():
        assert r.back == (r.text or "")
        assert r.p.scores == sorted(r.p.scores, reverse=True) and len(r.p.changes) == len(r.p.scores) - 1
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>").select(segment.decode_pieces(F.col("ids"), MODEL)).collect()
    assert sorted(str(r[0]) for r in nulls) == ["", "None"]


def test_generations_forget_and_stay_right(monkeypatch):
    monkeypatch.setattr(segment, "REMEMBERED", 3)
    own = segment.Segmenter(MODEL)
    for text in ("one two three four", "five six one", "seven eight nine ten", "one"):
        own.entries([own.cut(text)])
        assert own.encode(text, 3) == OWN.encode(text, 3)
    assert len(own.young) <= 8
