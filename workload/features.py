"""Engineered features on rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import features as X
from workload.common import rounded, sql_view, table, view

_SALES = [
    "o_orderkey",
    "CASE WHEN o_orderpriority <> '3-MEDIUM' THEN concat('C', CAST(o_custkey AS STRING)) END AS customer",
    "o_orderstatus AS status",
    "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS sales",
    "CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS units",
]
_T = f"({sql_view('orders', _SALES)})"


def feature_clv(spark, d):
    return rounded(X.lifetime_value(view(spark, d, "orders", _SALES), "customer", "sales"), 2, "customer_lifetime_value")


def feature_share(spark, d):
    return rounded(X.share_features(view(spark, d, "orders", _SALES), ["customer", "status"], "sales"), 6, "customer_share_pct", "status_share_pct")


def feature_frequency(spark, d):
    return X.purchase_frequency(view(spark, d, "orders", _SALES), "customer", "units")


def zscore(spark, d):
    out = X.zscores(table(spark, d, "events").select("event_id", "value"), ["value"])
    return rounded(out, 6, "value_zscore")


def features_all(spark, d):
    out = X.compute_features(view(spark, d, "orders", _SALES))[0]
    added = [c for c in out.columns if c not in ("o_orderkey", "customer", "status", "sales", "units")]
    return rounded(out.select("o_orderkey", *added), 4, *[c for c in added if c != "purchase_frequency"])


def feature_list(spark, d):
    out = X.compute_features(view(spark, d, "orders", _SALES))[1]
    return out.select("name", "description", F.array_join("source_columns", ",").alias("source_columns"), "type")


QUERIES = {
    "feature_clv": feature_clv,
    "feature_share": feature_share,
    "feature_frequency": feature_frequency,
    "zscore": zscore,
    "features_all": features_all,
    "feature_list": feature_list,
}

_CLV = "CASE WHEN customer IS NOT NULL THEN coalesce(sum(sales) OVER (PARTITION BY customer), 0) END"
_FREQ = "CASE WHEN customer IS NOT NULL THEN count(units) OVER (PARTITION BY customer) END"


def _share(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN coalesce(sum(sales) OVER (PARTITION BY {c}), 0) / (SELECT sum(sales) FROM {_T}) * 100 END"


SQL = {
    "feature_clv": f"SELECT *, round({_CLV}, 2) AS customer_lifetime_value FROM {_T}",
    "feature_share": f"SELECT *, round({_share('customer')}, 6) AS customer_share_pct, round({_share('status')}, 6) AS status_share_pct FROM {_T}",
    "feature_frequency": f"SELECT *, {_FREQ} AS purchase_frequency FROM {_T}",
    "zscore": "SELECT event_id, value, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events), 6) "
              "AS value_zscore FROM events",
    "features_all": f"""
SELECT o_orderkey, round({_CLV}, 4) AS customer_lifetime_value, round({_share('customer')}, 4) AS customer_share_pct,
       round({_share('status')}, 4) AS status_share_pct, {_FREQ} AS purchase_frequency,
       round((sales - avg(sales) OVER ()) / stddev_samp(sales) OVER (), 4) AS sales_zscore,
       round((units - avg(units) OVER ()) / stddev_samp(units) OVER (), 4) AS units_zscore
FROM {_T}""",
    "feature_list": f"""
SELECT * FROM (VALUES
  ('customer_lifetime_value', 'sum(sales) by customer', 'sales,customer', 'aggregation'),
  ('customer_share_pct', 'percent of sum(sales) by customer', 'sales,customer', 'share'),
  ('status_share_pct', 'percent of sum(sales) by status', 'sales,status', 'share'),
  ('purchase_frequency', 'count(units) by customer', 'units,customer', 'frequency'),
  ('sales_zscore', 'deviations of sales from its mean', 'sales', 'normalization'),
  ('units_zscore', 'deviations of units from its mean', 'units', 'normalization')
) AS v(name, description, source_columns, type)
WHERE (SELECT stddev_samp(sales) > 0 AND stddev_samp(units) > 0 AND sum(sales) > 0 FROM {_T})""",
}
