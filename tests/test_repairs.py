"""Repeatable appends, renames by values, dates in many shapes, exact whole numbers, NaN as missing."""

from __future__ import annotations

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from tablewright.functions import semantics as S
from tablewright.operators import catalog as G
from tablewright.operators import clean as C
from tablewright.operators import roles as R
from tablewright.plans import stats
from tablewright.sources import commits, layers


def log(spark, n=6):
    return spark.range(n).selectExpr("id", "timestamp'2024-01-01' + make_dt_interval(cast(id AS int)) AS ts")


def test_a_load_that_fails_or_runs_twice_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    commits.write_attempt(log(spark).withColumn("day", F.to_date("ts")), path, "007", ["day"])  # fails before it is listed
    assert commits.committed(spark, path).count() == 0
    G.append_log(log(spark), path, "007")
    G.append_log(log(spark), path, "007")
    G.append_log(log(spark, 2), path, "a/b c")
    rows = commits.read_loads(spark, path)
    assert {r.load: r["count"] for r in rows.groupBy("load").count().collect()} == {"007": 6, "a/b c": 2}
    # two attempts that were both listed: the first counts
    commits.commit(spark, path, "007", commits.write_attempt(log(spark, 3).withColumn("day", F.to_date("ts")), path, "007", ["day"]), 3)
    assert commits.read_loads(spark, path).filter("load = '007'").count() == 6
    assert not commits.append_load(log(spark), path, "007")


def test_two_loads_of_one_second_both_stay(spark, tmp_path):
    root, at = str(tmp_path / "lake"), dt.datetime(2024, 1, 1, 0, 0, 0, 5)
    a, b = (layers.store_bronze(spark.range(n), root, "d", at + dt.timedelta(microseconds=n)) for n in (3, 4))
    assert a != b and layers.load_bronze(spark, root, "d").count() == 7
    layers.store_bronze(spark.range(9), root, "d", at + dt.timedelta(microseconds=3))  # done again
    assert {r.load_ts: r.row_count for r in layers.list_bronze(spark, root).collect()} == {a: 9, b: 4}


def test_renames_are_found_by_values(spark):
    old = spark.range(2000).selectExpr("id AS order_id", "id * 7 AS amount", "cast(id % 50 AS string) AS state", "cast(null AS int) AS gone", "id AS same", "id % 2 = 0 AS flag")
    new = spark.range(1000, 2400).selectExpr("id AS number", "id * 7 + 3 AS cost", "cast(id % 50 AS string) AS area", "cast(id % 40 AS string) AS zone", "id AS same", "id % 2 = 1 AS yes")
    found = {(r.old_name, r.new_name): r.similarity for r in G.matched_renames(G.column_signatures(old), G.column_signatures(new), 0.2).collect()}
    assert set(found) == {("order_id", "number"), ("state", "area"), ("flag", "yes")} and found["state", "area"] == 1.0
    assert 0.2 <= found["order_id", "number"] <= 0.65  # 1000 of 2400 values are shared


def test_many_columns_make_no_pairs(spark):
    side = lambda p: spark.createDataFrame([(f"{p}{i}", "bigint", [hash((p, i, s)) % 2**62 for s in range(G.SLOTS)]) for i in range(500)], "column_name string, data_type string, signature array<bigint>")
    assert G.matched_renames(side("a"), side("b")).count() == 0


@pytest.mark.parametrize("text,value", [
    ("2024-03-05 10:11", "2024-03-05 10:11:00"), ("2024-03-05T10:11:12.5", "2024-03-05 10:11:12.5"), ("2024-03-05 10:11:12,25", "2024-03-05 10:11:12.25"),
    ("2024-03-05T10:11:12Z", "2024-03-05 10:11:12"), ("2024-03-05T10:11:12.123456+02:00", "2024-03-05 08:11:12.123456"), ("2024-03-05 10:11 -0130", "2024-03-05 11:41:00"),
    ("3/5/2024 9:07", "2024-03-05 09:07:00"), ("3/5/2024 19:07:08", "2024-03-05 19:07:08"), ("13/5/2024 9:07", None), ("2024-03-05 25:00", None), ("2024-03-05T", None), ("2024-03-05 10:11+", None),
])
def test_times_of_day(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(S.parse_timestamp(F.col("t")).cast("string")).first()[0] == value


def test_day_first_only_where_a_day_says_so(spark):
    rows = [("1/2/2024", "1/2/2024", "1/13/2024"), ("3/4/2024", "31/4/2024".replace("31", "30"), "2/2/2024"), (None, "2/3/2024 10:00", "3/3/2024")]
    df = spark.createDataFrame(rows, "either string, day string, month string")
    out, log = C.normalize_types(df)
    assert log == {"either": "text to timestamp", "day": "text to timestamp, day first", "month": "text to timestamp"}
    first = out.first()
    assert (first.either, first.day, first.month) == (dt.datetime(2024, 1, 2), dt.datetime(2024, 2, 1), dt.datetime(2024, 1, 13))
    dates, shares = C.parse_dates(df)
    assert dates.first().day == dt.datetime(2024, 2, 1) and shares["day"] == 1.0
    assert all(r.is_datetime for r in R.date_like_text(df).collect())


def test_whole_numbers_are_exact(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, 1, 1.0), (2**62, None, 2.0), (2**62, 3, None)], "a long, b int, x double")
    got = {r.column_name: tuple(r)[1:] for r in stats.whole_numbers(df).collect()}
    assert got == {"a": (3, decimal.Decimal(2**63 + big), big, 2**62), "b": (2, decimal.Decimal(4), 1, 3)}


def test_nan_is_missing_in_statistics(spark):
    r = stats.column_stats(spark.createDataFrame([(1.0,), (float("nan"),), (None,), (4.0,)], "x double")).first()
    assert (r.n_valid, r.n_missing, r.mean, r.maximum) == (2, 2, 2.5, 4.0)


def test_unfilled_dates_are_logged(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, None)], "k int, d date")
    assert C.fill_missing(df)[1] == {"d": "left missing, as no order is given"} and C.fill_missing(df, ["k"])[1] == {"d": "forward fill"}
