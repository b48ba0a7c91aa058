from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablewright.operators import profile as P
from tablewright.operators import roles as R


def role(spark, values, kind, name="x"):
    df = spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")
    return R.classify(df).rows[0][3]


def profile_type(spark, values, kind, name="x"):
    df = spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")
    return P.profile_types(df).first()["profile_type"]


@pytest.mark.parametrize("values,kind,want", [
    ([1, 2, 3], "long", "numeric"),
    ([True, False, True], "boolean", "boolean"),
    ([dt.datetime(2024, 1, d) for d in (1, 2, 3)], "timestamp", "datetime"),
    (["A", "B", "A", "C"], "string", "categorical"),
    (["x" * 60 + str(i) for i in range(100)], "string", "text"),
    ([f"ORD-{i:05d}" for i in range(200)], "string", "identifier"),
    ([None, None], "string", "text"),
])
def test_profile_types(spark, values, kind, want):
    assert profile_type(spark, values, kind) == want


@pytest.mark.parametrize("values,kind,name,want", [
    (list(range(100)), "long", "x", "id"),                       # consecutive
    ([i * 1000 for i in range(100)], "long", "x", "id"),         # all distinct, non-negative
    ([i - 50 for i in range(100)], "long", "x", "id"),           # consecutive, partly negative
    ([(i - 50) * 1000 for i in range(100)], "long", "x", "measure"),
    ([i - i % 6 // 5 for i in range(100)], "long", "x", "id"),   # a few repeats, evenly spaced
    ([i % 10 for i in range(100)], "long", "x", "measure"),
    ([float(i) for i in range(100)], "double", "x", "measure"),
    ([1.0, 1.0], "double", "customer_id", "id"),
    ([1, 2, 3], "long", "x", "measure"),
    ([None, None], "long", "x", "measure"),
    ([f"v{i}" for i in range(60)], "string", "x", "high_cardinality"),
    (["a", "b"] * 5, "string", "x", "dimension"),
    ([True], "boolean", "user_id", "boolean"),
    ([[1], [2]], "array<int>", "x", "other"),
])
def test_roles(spark, values, kind, name, want):
    assert role(spark, values, kind, name) == want


def test_dimension_bounds(spark):
    def dims(n):
        df = spark.range(200).select(F.concat(F.lit("v"), F.col("id") % n).alias("t"))
        return R.classify(df).dimensions

    assert dims(1) == [] and dims(2) == ["t"] and dims(50) == ["t"] and dims(51) == []


def test_date_like_text_looks_at_all_values(spark):
    rows = [(i, "2024-01-01" if i < 50 else "later") for i in range(60)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    assert tuple(R.date_like_text(df).first()) == ("t", 60, False)
    assert tuple(R.date_like_text(df.filter("k < 50")).first()) == ("t", 50, True)
    assert R.date_like_text(df.select("k")).count() == 0


def test_missing_counts_in_profile(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, None)], "a double, b string")
    missing = {r["column_name"]: r["n_missing"] for r in P.column_profile(df).collect()}
    assert missing == {"a": 1, "b": 1}


def test_profile_report_covers_every_column(spark):
    df = spark.range(100).select(
        (F.col("id") * 1.5).alias("revenue"), F.concat(F.lit("k"), F.col("id") % 3).alias("category"),
        (F.col("id") % 2 == 0).alias("is_active"), F.array("id").alias("nested"),
    )
    rows = {r["column_name"]: r for r in P.profile_report(df).collect()}
    assert set(rows) == {"revenue", "category", "is_active", "nested"}
    assert rows["revenue"]["profile_type"] == "numeric" and rows["revenue"]["median"] == 74.25
    assert rows["category"]["top_values"][0]["n"] == 34


def test_empty_table(spark):
    df = spark.createDataFrame([], "a long, b string")
    assert [r[3] for r in R.classify(df).rows] == ["measure", "dimension"]
    assert P.dataset_profile(df).first()["n_duplicates"] == 0
