"""Quantiles and order cuts where values are infinite, NaN, or whole numbers beyond doubles, and groups differ in size."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.plans import selection


@pytest.fixture(autouse=True)
def small_limits(monkeypatch):
    monkeypatch.setattr(selection, "DIRECT_VALUES", 500)
    monkeypatch.setattr(selection, "SMALL_CELL", 50)


def test_infinities_and_nan(spark):
    base = spark.range(4000).select((F.col("id") * 0.5 - 300).alias("x"))
    extra = spark.createDataFrame([(float("inf"),)] * 3 + [(float("-inf"),)] * 2 + [(float("nan"),)] * 7 + [(None,)], "x double")
    values = np.sort(np.concatenate(([-np.inf] * 2, np.arange(4000) * 0.5 - 300, [np.inf] * 3)))
    n, q = selection.quantiles_on_driver(base.union(extra), ["x"], [0.0, 0.25, 0.5, 0.75, 1.0])["x"]
    assert n == 4005 and q == [values[int(p * 4004)] for p in (0, 0.25, 0.5, 0.75, 1)]


def test_wide_and_tiny_ranges(spark):
    values = [float(2.0**k) for k in range(-1070, 1020, 3)] + [5e-324] * 30 + [1e-323] * 30
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    n, q = selection.quantiles_on_driver(rows, ["x"], [0.0, 0.5, 1.0])["x"]
    assert q == [5e-324, sorted(values)[(n - 1) // 2] if n % 2 else pytest.approx(np.median(values)), max(values)]


def test_one_hot_group_among_small_ones(spark):
    small = spark.range(300).select((F.col("id") % 30).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    hot = spark.range(3000).select(F.lit("hot").alias("g"), (F.col("id") * 7 % 3001).cast("double").alias("v"))
    none = spark.range(900).select(F.lit(None).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    got = {r.g: (r.n, r.q) for r in selection.group_quantiles(small.union(hot).union(none), ["g"], [0.5]).collect()}
    assert len(got) == 32 and got[None] == (900, [449.5])
    assert got["hot"] == (3000, [float(np.median(np.arange(3000) * 7 % 3001))])
    assert got["4"] == (10, [139.0])


def test_neighbouring_whole_numbers_beyond_doubles(spark):
    rows = spark.range(2000).select((F.lit(2**60) + F.col("id") % 2).alias("k"), F.col("id"))
    n, (cut,) = selection.order_cuts(rows, ["k", "id"], lambda n: [n // 2 - 1])
    assert n == 2000 and rows.filter(selection.up_to(["k", "id"], cut)).count() == 1000


def test_whole_range_of_longs(spark):
    rows = spark.createDataFrame([(-(2**63),), (2**63 - 1,)] + [(k * 2**52 - 2**62,) for k in range(1500)], "k long")
    want = sorted(r.k for r in rows.collect())
    n, (cut,) = selection.order_cuts(rows, ["k"], lambda n: [700])
    assert rows.filter(selection.up_to(["k"], cut)).agg(F.max("k")).first()[0] == want[700]
