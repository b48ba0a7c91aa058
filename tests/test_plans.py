"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tablewright.operators import aggregate as A
from tablewright.operators import anomaly as N
from tablewright.operators import charts as V
from tablewright.operators import search as X
from tablewright.plans import stats

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def read_schema(text: str) -> set[str]:
    return {c.split(":")[0] for m in re.findall(r"ReadSchema: struct<(.*)>", text) for c in m.split(",")}


def test_grouped_sum_reads_two_columns_and_takes_top(spark):
    p = plan(A.top_groups(spark.read.parquet(f"{SF}/lineitem.parquet"), "l_returnflag", "l_extendedprice"))
    assert read_schema(p) == {"l_returnflag", "l_extendedprice"}
    assert "TakeOrderedAndProject" in p and "partial_sum" in p


def test_filters_reach_the_scan(spark):
    p = plan(A.filter_in(spark.read.parquet(f"{SF}/orders.parquet"), {"o_orderstatus": ["F", "P"]}))
    assert "PushedFilters: [In(o_orderstatus" in p


def test_statistics_are_one_scan(spark):
    p = plan(stats.column_stats(spark.read.parquet(f"{SF}/orders.parquet")))
    assert p.count("Scan parquet") == 2  # tree line and detail of a single scan


def test_top_values_limit_before_the_shuffle(spark):
    p = plan(stats.top_values(spark.read.parquet(f"{SF}/part.parquet"), ["p_size", "p_retailprice"], 5))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_drift_scans_once_after_the_cut_is_known(spark):
    p = plan(N.numeric_drift(spark.read.parquet(f"{SF}/events.parquet"), ["value"], ["ts", "event_id"]))
    assert "Window" not in p and p.count("Scan parquet") == 2


def test_vector_search_keeps_the_best_per_task(spark):
    p = plan(X.vector_topk(spark.read.parquet(f"{SF}/embeddings.parquet"), "embedding", "vec_id", [0.1] * 64))
    assert "TakeOrderedAndProject" in p and "Exchange" not in p and "Python" not in p


def test_no_cross_joins(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    frames = [
        V.histogram(li, "l_tax"), V.grouped_bar(li, "l_returnflag", "l_tax", "l_linestatus"), A.share_of_total(li, "l_returnflag", "l_tax"),
        A.monthly_resample(li, "l_shipdate", "l_tax"), N.dominant_categories(li, ["l_returnflag"]),
        li.select(F.col("l_tax")),
    ]
    frames.append(A.correlation_matrix(li, ["l_tax", "l_discount"]))
    for f in frames:
        p = plan(f)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_resampled_months_are_one_scan(spark):
    p = plan(A.monthly_resample(spark.read.parquet(f"{SF}/orders.parquet"), "o_orderdate", "o_totalprice"))
    assert p.count("Scan parquet") == 2
