"""Order keys of many groups found together, and quantiles from sketched ranges, against sorting."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import anomaly as N
from tablewright.plans import selection as S

RANDOM = random.Random(4)


def rows(n=4000):
    """Heavily tied dates, a tie-breaker with ties of its own, and one that identifies rows."""
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=RANDOM.choice([0, 0, 0, 0, 1, 2, 9]), microseconds=RANDOM.choice([0, 1]))
    out = [(None if RANDOM.random() < 0.1 else day(), RANDOM.randrange(3), i, None if RANDOM.random() < 0.3 else RANDOM.random()) for i in range(n)]
    RANDOM.shuffle(out)
    return out


@pytest.mark.parametrize("small", [S.SMALL_CELL, 60, 3])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_keys_of_groups(spark, monkeypatch, small, kind):
    monkeypatch.setattr(S, "SMALL_CELL", small)
    data = rows()
    df = spark.createDataFrame(data, "at timestamp_ntz, k int, id long, x double").withColumn("at", F.col("at").cast(kind)).repartition(5)
    groups = {"all": F.lit(True), "x": F.col("x").isNotNull(), "low": F.col("x") < 0.1, "none": F.col("id") < 0}
    found = S.grouped_cuts(df, ["at", "k", "id"], groups, lambda n: [0, n // 4, n // 2, n - 1] if n else [])
    keep = {"all": lambda r: True, "x": lambda r: r[3] is not None, "low": lambda r: r[3] is not None and r[3] < 0.1, "none": lambda r: False}
    for g, cuts in found.items():
        own = sorted(r[:3] for r in data if r[0] is not None and keep[g](r))
        ranks = [0, len(own) // 4, len(own) // 2, len(own) - 1] if own else []
        assert len(cuts) == len(ranks)
        for rank, key in zip(ranks, cuts):
            here = df.filter(groups[g]).filter(S.up_to(["at", "k", "id"], key))
            assert here.count() == rank + 1


def test_missing_order_values_stand_in_no_half(spark):
    df = spark.createDataFrame([(i if i % 4 else None, float(i), "ab"[i % 2]) for i in range(40)], "t long, x double, s string")
    halves = {r.half: r["count"] for r in N.half_split(df, ["t"]).groupBy("half").count().collect()}
    assert halves == {1: 15, 2: 15, None: 10}
    drift = N.numeric_drift(df, ["x"], ["t"]).first()
    own = sorted(i for i in range(40) if i % 4)
    assert (drift.mean_first, drift.mean_second) == (sum(own[:15]) / 15, sum(own[15:]) / 15)
    growth = N.quarter_growth(df, ["x"], ["t"]).first()
    assert (growth.first_mean, growth.last_mean) == (sum(own[:7]) / 7, sum(own[-7:]) / 7)


def test_least_rows_is_one_parameter_of_both_drifts(spark):
    df = spark.range(12).selectExpr("id", "cast(id AS double) AS x", "'a' AS s")
    assert N.numeric_drift(df, ["x"], ["id"]).count() == 0 and N.numeric_drift(df, ["x"], ["id"], least_rows=12).count() == 1
    assert N.categorical_drift(df, ["s"], ["id"]).count() == 1 and N.categorical_drift(df, ["s"], ["id"], least_rows=13).count() == 0


@pytest.mark.parametrize("off", [False, True])
def test_quantiles_from_sketched_ranges(spark, monkeypatch, off):
    monkeypatch.setattr(S, "DIRECT_VALUES", 10)
    monkeypatch.setattr(S, "SMALL_CELL", 40)
    if off:  # a sketch that is always wrong costs scans, not results
        whole = S._sketched
        monkeypatch.setattr(S, "_sketched", lambda *a: {k: e | {"brackets": [(e["hi"], e["hi"])] * len(e["brackets"])} for k, e in whole(*a).items()})
    values = [(RANDOM.choice([0.0, 1.0, -1.0, RANDOM.gauss(0, 1e6), float("nan"), None]), RANDOM.randrange(5), float("inf") if i % 3 else -float("inf"), None) for i in range(3000)]
    df = spark.createDataFrame(values, "a double, b int, c double, d double").repartition(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.column_name: (r.n, list(r.q)) for r in S.column_quantiles(df, ["a", "b", "c", "d"], probs).collect()}
    assert set(got) == {"a", "b", "c"}
    for i, c in enumerate("abc"):
        own = sorted(r[i] for r in values if r[i] is not None and r[i] == r[i])
        assert got[c][0] == len(own)
        for p, q in zip(probs, got[c][1]):
            at = p * (len(own) - 1)
            low, high = own[int(at)], own[min(int(at) + 1, len(own) - 1)]
            want = low if low == high or at == int(at) else low + (high - low) * (at - int(at))
            assert q == want or abs(q - want) <= 1e-9 * abs(want), (c, p)
