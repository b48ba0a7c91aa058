"""Exact quantiles and order cuts found by narrowing, against numpy."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.plans import selection as S
from tablewright.plans.gaps import adjacent_gaps

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture()
def narrow(monkeypatch):
    """Make every search go the long way, whatever the size."""
    monkeypatch.setattr(S, "DIRECT_VALUES", 0)
    monkeypatch.setattr(S, "SMALL_CELL", 200)
    monkeypatch.setattr(S, "CELLS", 256)


def shapes():
    rng = np.random.default_rng(7)
    return {
        "uniform": rng.uniform(-5, 5, 3000),
        "heavy_tail": np.exp(rng.normal(0, 8, 2000)),
        "third_on_one_value": np.where(rng.uniform(size=3000) < 0.34, 7.25, rng.normal(size=3000)),
        "constant": np.full(500, 3.0),
        "two": np.array([1.0, 2.0]),
        "one": np.array([4.5]),
        "huge": np.array([-1e308, 1e308, 0.0, 5.0, 1e-308] * 20),
        "integers": rng.integers(0, 10, 2000).astype(float),
    }


@pytest.mark.parametrize("name", list(shapes()))
def test_column_quantiles(spark, narrow, name):
    x = shapes()[name]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
    n, q = S.quantiles_on_driver(df, ["x"], PROBS)["x"]
    assert n == len(x)
    if name == "huge":
        assert q[0] == x.min() and q[-1] == x.max()
    else:
        np.testing.assert_allclose(q, np.quantile(x, PROBS), rtol=1e-12)


@pytest.mark.parametrize("states,chars", [(100_000, 10_000_000), (0, 10_000_000), (100_000, 3)])
def test_group_quantiles_with_hot_and_null_groups(spark, narrow, monkeypatch, states, chars):
    monkeypatch.setattr(S, "BROADCAST_STATES", states)
    monkeypatch.setattr(S, "BROADCAST_KEY_CHARS", chars)
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.normal(size=2000)]
    rows += [(None, float(v)) for v in rng.integers(0, 5, 300)]
    rows += [(f"g{i}", float(v)) for i in range(5) for v in rng.uniform(size=i * 30 + 1)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: r for r in S.group_quantiles(df, ["g"], [0.25, 0.5, 0.9]).collect()}
    want: dict = {}
    for g, v in rows:
        want.setdefault(g, []).append(v)
    assert got.keys() == want.keys()
    for g, values in want.items():
        assert got[g]["n"] == len(values)
        np.testing.assert_allclose(got[g]["q"], np.quantile(values, [0.25, 0.5, 0.9]), rtol=1e-12)


def test_direct_and_narrowed_agree(spark, monkeypatch):
    df = spark.range(5000).select((F.pmod(F.hash("id"), F.lit(997)) / 3).alias("x"))
    direct = S.quantiles_on_driver(df, ["x"], PROBS)
    monkeypatch.setattr(S, "DIRECT_VALUES", 10)
    monkeypatch.setattr(S, "SMALL_CELL", 50)
    narrowed = S.quantiles_on_driver(df, ["x"], PROBS)
    np.testing.assert_allclose(direct["x"][1], narrowed["x"][1], rtol=1e-12)


def test_column_without_values_has_no_quantiles(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert set(S.quantiles_on_driver(df, ["a", "b"], [0.5])) == {"b"}


@pytest.mark.parametrize("small_cell", [50, 50_000])
def test_order_cuts_break_ties(spark, monkeypatch, small_cell):
    monkeypatch.setattr(S, "SMALL_CELL", small_cell)
    monkeypatch.setattr(S, "CELLS", 64)
    start = dt.datetime(2024, 1, 1)
    rng = np.random.default_rng(5)
    hours = np.where(rng.uniform(size=900) < 0.4, 100, rng.integers(0, 300, 900))  # 4 in 10 share one time
    rows = [(start + dt.timedelta(hours=int(h), microseconds=7), int(i)) for i, h in enumerate(hours)]
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.createDataFrame(rows, "ts timestamp, id long").select(F.col("ts").cast(kind).alias("ts"), "id")
        ordered = sorted(rows)
        ranks = [0, 449, 899]
        n, keys = S.order_cuts(df, ["ts", "id"], lambda n: ranks)
        assert n == 900
        for rank, key in zip(ranks, keys):
            assert df.filter(S.up_to(["ts", "id"], key)).count() == rank + 1
            assert df.filter(S.from_on(["ts", "id"], key)).count() == len(ordered) - rank


def test_order_by_text_is_refused(spark):
    with pytest.raises(ValueError):
        S.order_cuts(spark.createDataFrame([("a",)], "t string"), ["t"], lambda n: [0])


@pytest.mark.parametrize("values", [
    list(range(100)), [5] * 30, [1, 3, 3, 10, 2**40, -7, 2**45 + 1, -(2**50)],
    [2**20 - 1, 2**20, 2**20 + 1], [9],
    [-(2**63), 2**63 - 1, 0],
])
def test_adjacent_gaps(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(3)
    r = adjacent_gaps(df, "v").first()
    gaps = [b - a for a, b in zip(sorted(values), sorted(values)[1:])]
    assert (r["n_values"], r["n_distinct"]) == (len(values), len(set(values)))
    assert r["n_unit"] == sum(g == 1 for g in gaps)
    if gaps and max(gaps) < 2**60:
        assert r["gap_mean"] == pytest.approx(np.mean(gaps))
        assert r["gap_std"] == pytest.approx(np.std(gaps), rel=1e-6, abs=1e-6)
