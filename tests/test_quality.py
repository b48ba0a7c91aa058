from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import anomaly as N
from tablewright.operators import insight as I
from tablewright.operators import quality as Q
from tablewright.plans.outliers import iqr_outliers
from tablewright.plans.stats import column_stats, duplicate_counts, text_variants


def with_missing(spark, missing, n=100):
    return spark.range(n).select(F.when(F.col("id") >= missing, F.col("id")).alias("x"), "id")


@pytest.mark.parametrize("missing,severity", [(0, None), (1, "info"), (20, "info"), (21, "warning"), (50, "warning"), (51, "critical")])
def test_null_bands(spark, missing, severity):
    alerts = Q.null_alerts(column_stats(with_missing(spark, missing))).collect()
    assert [a["severity"] for a in alerts] == ([severity] if severity else [])
    if severity:
        assert alerts[0]["message"] == f"x: missing in {missing}.0 of 100 rows" and alerts[0]["value"] == missing


@pytest.mark.parametrize("copies,severity", [(0, None), (1, "warning"), (10, "warning"), (11, "critical")])
def test_duplicate_bands(spark, copies, severity):
    df = spark.range(100).select(F.greatest(F.col("id"), F.lit(copies)).alias("x"))
    alerts = Q.duplicate_alerts(duplicate_counts(df)).collect()
    assert [(a["severity"], a["value"]) for a in alerts] == ([(severity, float(copies))] if severity else [])


@pytest.mark.parametrize("numeric,found", [(30, False), (31, True), (99, True), (100, False)])
def test_mixed_types(spark, numeric, found):
    df = spark.range(100).select(F.when(F.col("id") < numeric, F.col("id").cast("string")).otherwise("x").alias("t"))
    assert (Q.mixed_type_alerts(column_stats(df, text=True)).count() == 1) is found


def test_outliers_need_ten_values_and_spread(spark):
    def outliers(values):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        return [r["n_outliers"] for r in iqr_outliers(df, ["x"]).collect()]

    assert outliers([1, 2, 3, 4, 5, 6, 7, 8, 100]) == []
    assert outliers([1, 2, 3, 4, 5, 6, 7, 8, 9, 100]) == [1]
    assert outliers([5] * 50 + [1000]) == []


def test_variants(spark):
    df = spark.createDataFrame([("North",), ("north ",), ("NORTH",), ("South",), (None,)], "t string")
    assert tuple(text_variants(df, ["t"]).first()) == ("t", 4, 2)


def test_scores_of_a_clean_table(spark):
    facts = Q.table_facts(spark.range(100).select(F.col("id").alias("x"), F.concat(F.lit("t"), "id").alias("t")), variants=True)
    score = Q.quality_score(facts).first()
    assert (score["overall_score"], score["total_checks"], score["failed_checks"]) == (100.0, 10, 0)
    card = Q.scorecard(facts).first()
    assert (card["overall"], card["completeness"], card["validity"]) == (100.0, 100.0, 100.0)
    assert {r["status"] for r in Q.quality_rules(facts).collect()} == {"PASS"}


def test_score_does_not_fall_below_zero(spark):
    df = spark.range(20).select(*[F.lit(None).cast("double").alias(f"c{i}") for i in range(8)])
    facts = Q.table_facts(df)
    assert Q.quality_score(facts).first()["overall_score"] == 0.0
    assert {r["score"] for r in Q.quality_by_column(facts).collect()} == {85.0}
    report = Q.quality_report(facts).first()
    assert len(report["alerts"]) == 9 and len(report["column_scores"]) == 8


def test_diagnosis(spark):
    df = spark.range(10).select(F.lit(5).alias("same"), F.lit(None).cast("string").alias("none"), "id")
    issues = Q.diagnose_issues(column_stats(df, text=True), duplicate_counts(df))
    assert {(r["issue"], r["column_name"], r["severity"]) for r in issues.collect()} == {
        ("missing_values", "none", "critical"), ("zero_variance", "same", "info"), ("empty_column", "none", "critical")
    }
    assert Q.health_score(issues).first()["health_score"] == 100 - 20 - 20 - 1


def test_zscore_outlier_rows(spark):
    df = spark.createDataFrame([(i, 10.0) for i in range(100)] + [(100, 1000.0)], "k int, val double")
    assert [(r["k"], r["column_name"]) for r in N.zscore_outliers(df, ["val"], ["k"]).collect()] == [(100, "val")]
    flat = spark.createDataFrame([(i, 5.0) for i in range(100)], "k int, val double")
    assert N.zscore_outliers(flat, ["val"], ["k"]).count() == 0
    assert I.zscore_counts(flat, ["val"]).count() == 0


def test_drift_by_row_order(spark):
    df = spark.range(40).select("id", F.when(F.col("id") < 20, 10.0).otherwise(15.0).alias("x"),
                                F.when(F.col("id") < 20, "a").otherwise("b").alias("t"))
    df = df.repartition(5)
    r = N.numeric_drift(df, ["x"], ["id"]).first()
    assert (r["mean_first"], r["mean_second"], r["change_pct"], r["drift"]) == (10.0, 15.0, 50.0, "Significant")
    c = N.categorical_drift(df, ["t"], ["id"]).first()
    assert (c["categories"], c["max_shift"], c["status"]) == (2, 100.0, "Drifted")
    assert N.numeric_drift(df.limit(19), ["x"], ["id"]).count() == 0


def test_odd_row_count_puts_the_middle_row_second(spark):
    halves = N.half_split(spark.range(7).repartition(3), ["id"]).groupBy("half").count().collect()
    assert {r["half"]: r["count"] for r in halves} == {1: 3, 2: 4}


@pytest.mark.parametrize("n", [2, 3, 7, 8, 101])
def test_quarter_growth_matches_pandas(spark, n):
    pdf = pd.DataFrame({"t": pd.date_range("2024-01-01", periods=n), "x": [(i * 37) % 11 + 1.0 for i in range(n)]})
    pdf.loc[pdf.index % 5 == 3, "x"] = None
    df = spark.createDataFrame([(t.to_pydatetime(), None if pd.isna(x) else x) for t, x in pdf.itertuples(index=False)], "t timestamp, x double")
    kept = pdf.dropna()
    k = max(1, len(kept) // 4)
    a, b = kept.head(k)["x"].mean(), kept.tail(k)["x"].mean()
    r = N.quarter_growth(df.repartition(4), ["x"], ["t"]).first()
    assert (r["first_mean"], r["last_mean"]) == (pytest.approx(a), pytest.approx(b))
    assert r["growth_pct"] == pytest.approx((b - a) / abs(a) * 100)


def test_signed_and_absolute_variation(spark):
    df = spark.createDataFrame([(-1.0,), (-2.0,), (-30.0,)], "x double")
    assert N.variation(df, ["x"]).first()["stability"] == "Stable"  # a negative mean gives a negative ratio
    assert N.variation(df, ["x"], absolute_mean=True).first()["stability"] == "Volatile"


def test_performance_gap(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 4.0), ("c", 4.0), (None, 900.0)], "g string, x double")
    r = N.performance_gaps(df, ["g"], ["x"]).first()
    assert (r["top_key"], r["top_mean"], r["bottom_key"], r["gap"]) == ("b", 4.0, "a", 4.0)


def test_reports_name_their_facts(spark):
    df = spark.range(200).select(
        F.to_timestamp(F.lit("2024-01-01")).alias("day0"), (F.col("id") % 7 * 10.5).alias("revenue"),
        (F.col("id") % 7 * 21.0 + 1).alias("cost"), F.when(F.col("id") % 10 == 0, None).otherwise(F.concat(F.lit("r"), F.col("id") % 3)).alias("region"),
        F.col("id").alias("row_id"),
    )
    said = {}
    for r in I.explain_report(df, tie_break=["row_id"]).collect():
        said.setdefault(r["section"], []).append(r["text"])
    assert said["overview"][0] == "rows of table: 200"
    assert any(t.startswith("total of revenue: ") for t in said["key_insights"])
    assert said["correlations"][0] == "r of revenue, cost: 1"
    assert "missing_pct to fill of region: 10" in said["recommendations"]
    assert I.rule_insights(df).filter("section = 'correlation'").count() == 1
    assert I.fallback_insights(df).filter("section = 'missing'").count() == 1
