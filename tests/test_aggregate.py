from __future__ import annotations


import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import aggregate as A
from tablewright.operators import charts as V
from tablewright.operators import features as X
from tablewright.plans import joins, selection


@pytest.fixture(scope="module")
def sales(spark):
    rng = np.random.default_rng(11)
    n = 600
    pdf = pd.DataFrame({
        "customer": np.where(rng.uniform(size=n) < 0.4, "hot", [f"c{i}" for i in rng.integers(0, 40, n)]),
        "region": rng.choice(["N", "S", "E", "W"], n),
        "sales": np.round(rng.normal(100, 30, n), 2),
        "units": rng.integers(1, 15, n).astype(float),
        "at": pd.Timestamp("2023-01-15") + pd.to_timedelta(rng.integers(0, 300, n), unit="D"),
    })
    pdf.loc[rng.uniform(size=n) < 0.1, "region"] = None
    pdf.loc[rng.uniform(size=n) < 0.1, "sales"] = np.nan
    pdf.loc[rng.uniform(size=n) < 0.05, "customer"] = None
    data = [
        (c if isinstance(c, str) else None, r if isinstance(r, str) else None, None if pd.isna(s) else float(s), float(u), t.to_pydatetime())
        for c, r, s, u, t in pdf.itertuples(index=False)
    ]
    df = spark.createDataFrame(data, "customer string, region string, sales double, units double, at timestamp_ntz").repartition(5)
    return df.cache(), pdf


@pytest.mark.parametrize("func", ["sum", "mean", "count", "min", "max", "median"])
@pytest.mark.parametrize("direct", [10**6, 0])
def test_aggregate_by_matches_pandas(sales, monkeypatch, func, direct):
    monkeypatch.setattr(selection, "DIRECT_VALUES", direct)
    df, pdf = sales
    got = {r["region"]: r["sales"] for r in A.aggregate_by(df, "region", "sales", func).collect()}
    want = pdf.groupby("region", dropna=False)["sales"].agg(func)
    assert len(got) == len(want) == 5
    for k, v in want.items():
        assert got[k if isinstance(k, str) else None] == pytest.approx(v)


def test_top_groups_keep_or_drop_the_missing_group(sales):
    df, _ = sales
    assert A.top_groups(df, "region", "sales").count() == 5
    assert A.top_groups(df, "region", "sales", keep_null=False).count() == 4
    assert A.top_groups(df, "region", "sales", top_n=2).columns == ["region", "sales_sum"]


def test_group_of_missing_values_sums_to_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0)], "g string, v double")
    assert {tuple(r) for r in A.top_groups(df, "g", "v").collect()} == {("a", 0.0), ("b", 1.0)}
    assert {tuple(r) for r in A.aggregate_by(df, "g", "v", "median").collect()} == {("a", None), ("b", 1.0)}


def test_monthly_resample_matches_pandas(sales):
    df, pdf = sales
    gaps = df.filter(~F.month("at").isin(4, 5))
    kept = pdf[~pdf["at"].dt.month.isin([4, 5])]
    got = [(r["month"], round(r["total"], 4)) for r in A.monthly_resample(gaps, "at", "sales").collect()]
    want = kept.set_index("at").resample("ME")["sales"].sum()
    assert got == [(k.strftime("%Y-%m"), round(v, 4)) for k, v in want.items()]
    change = A.trend_change(A.monthly_resample(gaps, "at", "sales")).first()
    assert change["change_pct"] == pytest.approx((want.iloc[-1] - want.iloc[0]) / abs(want.iloc[0]) * 100)


def test_correlation_matrix(sales, spark):
    df, pdf = sales
    rows = {r["column_name"]: r for r in A.correlation_matrix(df, ["sales", "units"]).collect()}
    assert rows["sales"]["units"] == pytest.approx(pdf["sales"].corr(pdf["units"])) == pytest.approx(rows["units"]["sales"])
    assert rows["sales"]["sales"] == 1.0
    assert A.correlation_matrix(df, ["sales"]).count() == 0
    assert A.feature_importance(df, "nonexistent", ["sales", "units"]).count() == 0
    assert [r["column_name"] for r in A.feature_importance(df, "sales", ["sales", "units"]).collect()] == ["units"]


def test_correlation_of_difficult_columns(spark):
    rng = np.random.default_rng(4)
    n = 400
    pdf = pd.DataFrame({
        "far": 1e9 + rng.normal(size=n), "tiny": rng.normal(size=n) * 1e-9, "tenth": 0.1, "gap": rng.normal(size=n), "empty": np.nan,
    })
    pdf["line"] = 3 * pdf["gap"] - 2
    pdf.loc[rng.uniform(size=n) < 0.5, "gap"] = np.nan
    pdf["half"] = np.where(pdf["gap"].isna(), rng.normal(size=n), 7.0)  # constant wherever gap is present
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)],
                               ", ".join(f"{c} double" for c in pdf.columns)).repartition(3)
    r = {(p["column_a"], p["column_b"]): p["r"] for p in A.correlation_pairs(df, list(pdf.columns)).collect()}
    for a, b in (("far", "tiny"), ("far", "gap"), ("gap", "line"), ("line", "half"), ("tiny", "half")):
        assert r[a, b] == pytest.approx(pdf[a].corr(pdf[b]), abs=1e-6)
    for pair in (("far", "tenth"), ("tenth", "gap"), ("gap", "empty"), ("gap", "half")):
        assert r[pair] is None


def test_gold_tables(sales):
    df, pdf = sales
    tables = A.gold_tables(df)
    assert {"sales_by_region", "avg_units_by_region", "sales_by_customer", "monthly_sales_by_at", "numeric_summary"} <= set(tables)
    got = {r["region"]: r["sales_sum"] for r in tables["sales_by_region"].collect()}
    for k, v in pdf.groupby("region", dropna=False)["sales"].sum().items():
        assert got[k if isinstance(k, str) else None] == pytest.approx(v)
    months = [r["sales_sum"] for r in tables["monthly_sales_by_at"].collect()]
    assert months == sorted(months, reverse=True)


def test_growth_needs_a_nonzero_start(spark):
    df = spark.createDataFrame([(1, None), (2, 0.0), (3, 5.0)], "k int, v double")
    assert A.growth_rate(df, "v", ["k"]).count() == 0
    assert A.growth_rate(df.filter("k <> 2").unionByName(spark.createDataFrame([(2, 4.0)], "k int, v double")), "v", ["k"]).first()["growth_pct"] == 25.0


def test_kpi_delta_counts_both_in_one_scan(sales):
    df, pdf = sales
    r = A.kpi_delta(df, ["sales"], F.col("region") == "N").first()
    assert r["total"] == pytest.approx(pdf[pdf["region"] == "N"]["sales"].sum())
    assert r["base_total"] == pytest.approx(pdf["sales"].sum())


def test_filters_compare_as_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, t string")
    assert [r["n"] for r in A.filter_in(df, {"n": ["1", "2"], "t": ["b"]}).collect()] == [2]
    assert A.filter_in(df, {"n": []}).count() == 3


def test_sample_is_bounded_and_complete_for_small_tables(spark):
    assert A.sample_rows(spark.range(300), 500).count() == 300
    assert A.sample_rows(spark.range(20000), 500).count() == 500


@pytest.mark.parametrize("broadcast,hot_share", [(10**6, 1000), (0, 10**6), (0, 10), (0, 1)])
def test_features_match_pandas(sales, monkeypatch, broadcast, hot_share):
    monkeypatch.setattr(joins, "BROADCAST_KEYS", broadcast)
    monkeypatch.setattr(joins, "HOT_SHARE", hot_share)  # all keys hot, one hot, none
    df, pdf = sales
    out, described = X.compute_features(df)
    assert out.count() == len(pdf)
    got = out.toPandas()
    sums = pdf.groupby("customer")["sales"].sum()
    share = pdf.groupby("region")["sales"].sum() / pdf["sales"].sum() * 100
    freq = pdf.groupby("customer")["units"].count()
    for r in got.itertuples():
        if isinstance(r.customer, str):
            assert r.customer_lifetime_value == pytest.approx(sums[r.customer]) and r.purchase_frequency == freq[r.customer]
        else:
            assert pd.isna(r.customer_lifetime_value) and pd.isna(r.purchase_frequency)
        if isinstance(r.region, str):
            assert r.region_share_pct == pytest.approx(share[r.region])
    z = (pdf["sales"] - pdf["sales"].mean()) / pdf["sales"].std()
    assert sorted(got["sales_zscore"].dropna()) == pytest.approx(sorted(z.dropna()))
    assert [r["name"] for r in described.collect()] == [
        "customer_lifetime_value", "customer_share_pct", "region_share_pct", "purchase_frequency", "sales_zscore", "units_zscore"
    ]


def test_histogram_covers_every_value(sales):
    df, pdf = sales
    bins = V.histogram(df, "sales", 10).orderBy("bin").collect()
    counts, edges = np.histogram(pdf["sales"].dropna(), 10)
    assert [b["n"] for b in bins] == list(counts)
    assert [b["lower"] for b in bins] == pytest.approx(list(edges[:-1]))
    flat = V.histogram(df.select(F.lit(3.0).alias("x")), "x", 5).orderBy("bin").collect()
    assert [b["n"] for b in flat] == [600, 0, 0, 0, 0]


def test_chart_line_by_number_and_grouped_bar(sales):
    df, _ = sales
    assert [r["x"] for r in V.line(df, "units", "sales").collect()] == sorted({float(i) for i in range(1, 15)})
    assert {r["customer"] for r in V.grouped_bar(df, "customer", "sales", "region", top_n=3).collect()} == {
        r["customer"] for r in V.bar(df, "customer", "sales", top_n=3).collect()
    }


def test_suggested_kpis(spark):
    df = spark.createDataFrame([(10.0, 1, "x", "EU", "p")], "revenue double, units int, customer string, region string, product string")
    got = {(r["kpi"], r["key"]): r["value"] for r in A.suggested_kpis(df).collect()}
    assert got == {("Total revenue", None): 10.0, ("Average revenue", None): 10.0, ("Total units", None): 1.0,
                   ("revenue by customer", "x"): 10.0, ("revenue by region", "EU"): 10.0, ("Top product", "p"): 1.0}


def test_extreme_rows(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 5.0), (4, -1.0)], "k int, v double")
    assert A.row_at_extreme(df, "v", ["k"]).first()["k"] == 1
    assert A.row_at_extreme(df, "v", ["k"], largest=False).first()["k"] == 4
    assert [r["k"] for r in A.first_rows(df, 2, ["k"], last=True).collect()] == [4, 3]
