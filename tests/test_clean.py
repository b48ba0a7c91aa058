from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import clean as C


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_standard_names(spark):
    df = spark.createDataFrame([(1, 2)], "` Order-ID ` int, `Total ($)` int")
    assert C.standardize_names(df).columns == ["order_id", "total"]


def test_names_that_would_clash_are_refused(spark):
    with pytest.raises(ValueError):
        C.standardize_names(spark.createDataFrame([(1, 2)], "`a-b` int, `a b` int"))


def test_fill_missing(spark):
    df = spark.createDataFrame(
        [(1, 1, 2.0, "b", True, None), (2, None, None, "a", None, None), (3, 4, 6.0, None, True, None),
         (4, 8, 7.0, "a", False, None), (5, None, 8.0, "b", True, None)],
        "k int, whole int, x double, t string, f boolean, empty string",
    )
    out, log = C.fill_missing(df)
    got = {r["k"]: r for r in out.collect()}
    assert got[2]["whole"] == 4.0 and got[2]["x"] == 6.5
    assert got[3]["t"] == "a"  # two each of a and b: the smaller
    assert got[2]["f"] is True and got[1]["empty"] == "Unknown"
    assert log["x"] == "median (6.5000)" and log["t"] == "mode (a)" and log["empty"] == "Unknown"


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_forward_fill_across_partitions(spark, parts):
    start = dt.datetime(2024, 1, 1)
    at = [None] * 4 + [start if i % 97 == 0 else (start + dt.timedelta(days=i) if i % 5 == 0 and not 100 < i < 700 else None) for i in range(1000)]
    data = [(i, t, f"row {i}") for i, t in enumerate(at)]
    df = spark.createDataFrame(data, "k long, t timestamp_ntz, note string").repartition(parts)
    got = rows(C.forward_fill(df, ["t"], ["k"]), "k")
    want = pd.Series(at, dtype="datetime64[us]").ffill()
    assert [None if pd.isna(w) else w.to_pydatetime() for w in want] == [r[1] for r in got]
    assert [r[2] for r in got] == [d[2] for d in data]


def test_forward_fill_of_several_columns(spark):
    df = spark.createDataFrame([(1, 5.0, "a"), (2, None, None), (3, None, "c"), (4, 9.0, None)], "k int, x double, t string")
    assert rows(C.forward_fill(df, ["x", "t"], ["k"]), "k") == [(1, 5.0, "a"), (2, 5.0, "a"), (3, 5.0, "c"), (4, 9.0, "c")]


def test_normalize_types_needs_every_value(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-01", "1", None), (" 2.5", "2024/02/03", "x", None), (None, None, "3", None)],
        "n string, d string, mixed string, empty string",
    )
    out, log = C.normalize_types(df)
    assert dict(out.dtypes) == {"n": "double", "d": "timestamp", "mixed": "string", "empty": "string"}
    assert log == {"n": "text to number", "d": "text to timestamp"}


def test_parse_dates_needs_more_than_half_of_all_rows(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-01"), ("2024-01-02", None), (None, None), ("2024-01-03", None)], "a string, b string")
    out, hits = C.parse_dates(df)
    assert dict(out.dtypes) == {"a": "timestamp", "b": "string"} and hits == {"a": 0.75}


def test_clean_keeps_order_of_steps(spark):
    df = spark.createDataFrame(
        [(1.0, "5"), (1.0, "5"), (None, None), (3.0, None)], "`X Y` double, `N` string"
    )
    out, log = C.clean(df)
    assert rows(out, "x_y") == [(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)]
    assert [(r["operation"], r["rows_removed"]) for r in log.orderBy("step").collect()] == [
        ("standardize_column_names", 0), ("remove_duplicates", 1), ("fill_missing_values", 0),
        ("normalize_data_types", 0), ("remove_invalid_rows", 0),
    ]
    first, _ = C.clean(df, drop_all_null_first=True)
    assert rows(first, "x_y") == [(1.0, 5.0), (3.0, 5.0)]


def test_derived_columns(spark):
    df = spark.createDataFrame(
        [(1, 2.0, dt.datetime(2024, 1, 1)), (None, None, dt.datetime(2024, 3, 3)), (4, None, None)], "a int, b double, t timestamp"
    )
    got = C.add_derived_columns(df).orderBy(F.col("a").asc_nulls_last()).collect()
    assert [(r["_row_total"], r["_row_mean"]) for r in got] == [(3.0, 1.5), (4.0, 4.0), (0.0, None)]
    assert [r["t_dayofweek"] for r in got] == [0, None, 6]  # Monday is 0


def test_clean_with_columns_parquet_cannot_hold(spark):
    df = spark.sql("SELECT * FROM VALUES (1, NULL), (1, NULL), (2, NULL) AS t(k, nothing)")
    out, log = C.clean(df)
    assert rows(out, "k") == [(1, None), (2, None)]
