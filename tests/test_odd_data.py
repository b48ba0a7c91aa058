"""Data off the usual path: maps and binaries, infinities, zero totals, long texts, bare tables, hot keys."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablewright.operators import aggregate as A
from tablewright.operators import anomaly as N
from tablewright.operators import charts as V
from tablewright.operators import clean as C
from tablewright.operators import insight as I
from tablewright.plans import joins


def test_maps_and_binaries_are_cleaned(spark):
    rows = [({"a": 1, "b": 2}, b"x", 1)] * 3 + [({"b": 2}, b"y", 2), (None, None, None)]
    df = spark.createDataFrame(rows, "m map<string,int>, b binary, n int")
    assert C.drop_duplicates(df).count() == 3
    out, log = C.clean(df)
    assert out.count() in (2, 3) and log.filter("operation = 'remove_duplicates'").first()["rows_removed" if "rows_removed" in log.columns else log.columns[2]] == 2


def test_histogram_with_infinities(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10)] + [(float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "x double")
    rows = V.histogram(df, "x", 3).orderBy("bin").collect()
    assert [r["n"] for r in rows] == [4, 3, 5] and rows[0]["lower"] == 0.0 and rows[-1]["upper"] == 9.0


def test_zero_totals_say_nothing(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", -5.0), ("c", 0.0)], "k string, v double")
    assert I.top_drivers(df, "k", "v").count() == 0 and I.weak_segments(df, "k", "v").count() == 0


def test_performance_gaps_name_long_groups(spark):
    long, other = "x" * 80, "y" * 70
    df = spark.createDataFrame([(long, 100.0), (other, 1.0)], "k string, v double")
    row = N.performance_gaps(df, ["k"], ["v"]).first()
    assert {long, other} <= set(row.asDict().values())


def test_suggestions_on_bare_tables(spark):
    assert A.suggested_kpis(spark.createDataFrame([(True,)], "b boolean")).count() == 0


def test_gold_tables_keep_both_dates(spark):
    df = spark.sql("SELECT DATE'2024-01-01' + CAST(id AS INT) * 20 AS made, DATE'2023-01-01' + CAST(id AS INT) * 15 AS sent, id % 3 * 1.5 AS amount FROM range(40)")
    assert {"monthly_amount_by_made", "monthly_amount_by_sent"} <= set(A.gold_tables(df))


@pytest.mark.parametrize("own_source", [True, False])
def test_hot_and_missing_keys_pass_no_exchange(spark, monkeypatch, own_source):
    monkeypatch.setattr(joins, "BROADCAST_KEYS", 0)
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    source = None if own_source else rows.filter("v < 10")
    out = joins.attach_aggregates(rows, "k", {"total": F.sum("v")}, source=source)
    got = {r["v"]: r["total"] for r in out.collect()}
    assert len(got) == 3000 and got[2] is None and got[1] == 1
    assert got[3] == sum(range(0, 3000 if own_source else 10, 3)) and (got[2998] == 2998) == own_source
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and plan.count("broadcast") >= 2
