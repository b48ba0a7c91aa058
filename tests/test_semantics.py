"""The places where missing values, division, parsing and ties are easy to get wrong."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions import names, semantics as S
from tablewright.plans import stats


def one(df):
    return df.first()[0]


def test_nan_is_missing(spark):
    df = S.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double"))
    r = df.agg(F.count("x"), F.avg("x"), F.count_distinct("x")).first()
    assert tuple(r) == (1, 1.0, 1)


def test_sum_of_nothing_is_zero_but_mean_is_missing(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert tuple(df.agg(S.total(F.col("x")), F.avg("x")).first()) == (0.0, None)


@pytest.mark.parametrize("text,value", [
    ("5", 5.0), (" -1.5e3 ", -1500.0), (".5", 0.5), ("5.", 5.0), ("5d", None), ("abc", None), ("", None), ("1,000", None),
])
def test_parse_number(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(S.parse_number(F.col("t")))) == value


@pytest.mark.parametrize("text,value", [
    ("2024-01-31", "2024-01-31 00:00:00"), ("2024-01-31 10:11:12", "2024-01-31 10:11:12"),
    ("2024-01-31T10:11:12", "2024-01-31 10:11:12"), ("2024/01/31", "2024-01-31 00:00:00"),
    ("1/31/2024", "2024-01-31 00:00:00"), ("31-Jan-2024", "2024-01-31 00:00:00"),
    ("Jan 31, 2024", "2024-01-31 00:00:00"), ("2024-13-01", None), ("12345", None), ("soon", None),
])
def test_parse_timestamp(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(S.parse_timestamp(F.col("t")).cast("string"))) == value


def test_division_by_zero_is_missing_or_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert one(df.select(S.ratio(F.col("a"), F.col("b")))) is None
    assert one(df.select(S.percent(F.col("a"), F.col("b")))) == 0.0


@pytest.mark.parametrize("values", [[1.0, 2.0, 10.0, 4.0], [5.0, 5.0, 5.0], [1.0, 2.0], [1.0, None, 7.0, 9.0, 30.0]])
def test_skewness_matches_pandas(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got, want = one(df.agg(S.adjusted_skewness(F.col("x")))), pd.Series(values, dtype=float).skew()
    assert got is None if pd.isna(want) else got == pytest.approx(want)


def test_unknown_aggregate_is_refused():
    with pytest.raises(ValueError):
        S.aggregate_named("exec")


@pytest.mark.parametrize("n,text", [
    (1_234_567.0, "1.2M"), (2_000_000_000.0, "2.0B"), (1500.0, "1.5K"), (12.0, "12"), (12.345, "12.35"), (-1500.0, "-1.5K"),
])
def test_short_number(spark, n, text):
    assert one(spark.createDataFrame([(n,)], "n double").select(S.short_number(F.col("n")))) == text


@pytest.mark.parametrize("name,is_id", [
    ("id", True), ("order_id", True), ("OrderID", True), ("postal code", True), ("l_linenumber", True), ("phone", True),
    ("revenue", False), ("quantity", False), ("width", False), ("l_orderkey", False),
])
def test_id_names(name, is_id):
    assert names.looks_like_id(name) is is_id


def test_column_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "`a.b c` int, `d` string")
    rows = {r["column_name"]: r for r in stats.column_stats(df).collect()}
    assert rows["a.b c"]["total"] == 3.0 and rows["d"]["n_missing"] == 1


def test_duplicates_count_null_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a"), (None, "a"), (None, None)], "a int, b string")
    assert tuple(stats.duplicate_counts(df).first()) == (5, 2)


def test_duplicates_tell_nulls_in_different_columns_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "a string, b string")
    assert stats.duplicate_counts(df).first()["n_duplicates"] == 0


def test_long_texts_count_by_their_whole_content(spark):
    base = "x" * 5000
    df = spark.createDataFrame([(base + "1",), (base + "2",), (base + "1",)], "t string")
    assert stats.distinct_counts(df, ["t"]).first()["n_distinct"] == 2
    assert stats.duplicate_counts(df).first()["n_duplicates"] == 1


def test_zero_and_negative_zero_are_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "x double")
    assert stats.distinct_counts(df, ["x"]).first()["n_distinct"] == 2


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "bbaacd"], "t string")
    assert [r["value"] for r in stats.top_values(df, ["t"], 3).orderBy("place").collect()] == ["a", "b", "c"]


@pytest.mark.parametrize("limit", [500_000, 1, 0])
@pytest.mark.parametrize("collide", [False, True])
def test_duplicates_are_exact_however_hashes_fall(spark, monkeypatch, limit, collide):
    monkeypatch.setattr(stats, "BROADCAST_HASHES", limit)
    if collide:  # every row hashes alike
        monkeypatch.setattr(stats.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    rows = [("hot", None, 1.5)] * 40 + [(f"t{i}" * 50, i, None) for i in range(20)] + [("t3" * 50, 3, None), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, k int, x double").repartition(4)
    assert tuple(stats.duplicate_counts(df).first()) == (63, 39 + 1 + 1)
    got = [tuple(r) for r in stats.without_duplicates(df).collect()]
    assert len(got) == len(set(got)) == len(set(rows)) and set(got) == set(rows)


def test_rows_of_maps_and_arrays_can_repeat(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, [1]), ({"b": 2, "a": 1}, [1]), ({"a": 1}, [2])], "m map<string,int>, a array<int>")
    assert stats.duplicate_counts(df).first()["n_duplicates"] == 1


def test_frequent_long_texts_come_back_whole(spark):
    a, b = "x" * 3000 + "1", "x" * 3000 + "2"
    df = spark.createDataFrame([(a, 1), (a, 2), (b, 2), ("short", 2)], "t string, n int")
    got = {(r["column_name"], r["value"]): (r["n"], r["place"]) for r in stats.top_values(df, ["t", "n"], 3).collect()}
    assert got[("t", a)] == (2, 1) and got[("t", "short")] == (1, 2) and got[("t", b)] == (1, 3) and got[("n", "2")] == (3, 1)
