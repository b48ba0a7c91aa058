"""Distinct counts and gaps from words of bits, against sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tablewright.plans import gaps, stats

RANDOM = random.Random(6)
EDGE = [0, -1, 1, 63, 64, 65, -63, -64, -65, 127, 128, 2**62, -(2**62), 2**63 - 1, -(2**63), 2**63 - 2]
CASES = {
    "edge": EDGE, "dense": list(range(-200, 300)), "steps": [k * 37 for k in range(400)], "ties": [RANDOM.randrange(50) for _ in range(500)],
    "far": [RANDOM.randrange(-(2**40), 2**40) for _ in range(300)], "one": [5], "full": list(range(64)) * 2,
}


@pytest.mark.parametrize("name", list(CASES))
def test_counts_and_gaps(spark, name):
    values = CASES[name] + [None, None]
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(5)
    assert stats.distinct_counts(df, ["x"]).first()["n_distinct"] == len(set(CASES[name]))
    r = gaps.adjacent_gaps(df, "x").first()
    own = sorted(CASES[name])
    diffs = [b - a for a, b in zip(own, own[1:])]
    assert (r["n_values"], r["n_distinct"], r["n_unit"]) == (len(own), len(set(own)), diffs.count(1))
    if diffs:
        assert abs(r["gap_std"] - np.std(np.array(diffs, float))) <= 1e-9 * max(1.0, np.std(np.array(diffs, float)))


def test_columns_without_values(spark):
    df = spark.createDataFrame([(None, 1)], "a long, b int")
    assert {r.column_name: r.n_distinct for r in stats.distinct_counts(df, ["a", "b"]).collect()} == {"a": 0, "b": 1}
    none = spark.createDataFrame([], "a long")
    assert gaps.adjacent_gaps(none, "a").first()["n_values"] == 0


def test_dense_keys_shuffle_a_row_a_word(spark):
    words = stats.value_words(spark.range(64_000).withColumnRenamed("id", "v"))
    assert words.count() == 1000
