"""Grouped aggregates, KPIs, rankings, trends, shares, correlations and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import aggregate as A
from tablewright.operators import insight as I
from tablewright.operators import profile as P
from workload.common import GAPPY_LINEITEM, REPEATED_LINEITEM, rounded, sql_view, table, view

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_GAPPY = f"({sql_view('lineitem', GAPPY_LINEITEM)})"


def gold_sum_by_dim(spark, d):
    return rounded(A.top_groups(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"), 2, "l_extendedprice_sum")


def gold_mean_by_dim(spark, d):
    out = A.top_groups(view(spark, d, "lineitem", GAPPY_LINEITEM), "l_returnflag", "l_extendedprice", "mean")
    return rounded(out, 4, "l_extendedprice_mean")


def gold_monthly(spark, d):
    return rounded(A.top_months(table(spark, d, "lineitem"), "l_shipdate", "l_extendedprice"), 2, "l_extendedprice_sum")


def gold_tables(spark, d):
    """Every grouped table of the set in one frame: table, key, value."""
    out = None
    for name, t in A.gold_tables(table(spark, d, "orders")).items():
        if name == "numeric_summary":
            continue
        key, value = t.columns
        rows = t.select(F.lit(name).alias("table_name"), F.col(key).alias("key"), F.round(value, 4).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _gold_sql():
    parts = []
    for dim in ("o_orderstatus", "o_orderpriority"):
        for m in ("o_custkey", "o_totalprice"):
            for prefix, fn in (("", "sum"), ("avg_", "avg")):
                parts.append(
                    f"SELECT '{prefix}{m}_by_{dim}' AS table_name, {dim} AS key, round(CAST({fn}({m}) AS DOUBLE), 4) AS value "
                    f"FROM orders GROUP BY {dim}"
                )
    for m in ("o_custkey", "o_totalprice"):
        parts.append(
            f"SELECT * FROM (SELECT 'monthly_{m}_by_o_orderdate' AS table_name, strftime(o_orderdate, '%Y-%m') AS key, "
            f"round(CAST(sum({m}) AS DOUBLE), 4) AS value FROM orders GROUP BY 2)"
        )
    return " UNION ALL ".join(parts)


def _agg(func):
    def run(spark, d):
        out = A.aggregate_by(view(spark, d, "lineitem", GAPPY_LINEITEM), "l_returnflag", "l_tax", func)
        return out if func == "count" else rounded(out, 4, "l_tax")

    return run


_AGG_SQL = {"sum": "coalesce(sum(l_tax), 0)", "mean": "avg(l_tax)", "count": "count(l_tax)", "min": "min(l_tax)",
            "max": "max(l_tax)", "median": "median(l_tax)"}


def business_metrics(spark, d):
    out = A.business_metrics(table(spark, d, "lineitem"))
    return rounded(out, 2, "total", "minimum", "maximum")


def numeric_summary(spark, d):
    return rounded(A.numeric_summary(view(spark, d, "lineitem", GAPPY_LINEITEM), _MEASURES), 2, "total")


def kpis(spark, d):
    return rounded(A.kpis(view(spark, d, "lineitem", GAPPY_LINEITEM), _MEASURES), 2, "value")


def top_category(spark, d):
    return A.top_category(table(spark, d, "part"), ["p_brand", "p_type", "p_name"])


def growth_rate(spark, d):
    out = A.growth_rate(table(spark, d, "events"), "value", ["ts", "event_id"])
    return rounded(out, 4, "growth_pct")


def top_items(spark, d):
    return rounded(A.top_items(table(spark, d, "orders"), "o_custkey", "o_totalprice"), 2, "o_totalprice_sum")


def bottom_items(spark, d):
    return rounded(A.top_items(table(spark, d, "orders"), "o_custkey", "o_totalprice", ascending=True), 2, "o_totalprice_sum")


def profile_numeric(spark, d):
    return P.numeric_profile(view(spark, d, "lineitem", GAPPY_LINEITEM))


def profile_columns(spark, d):
    return P.column_profile(view(spark, d, "lineitem", GAPPY_LINEITEM)).drop("data_type")


def profile_top_values(spark, d):
    return P.frequent_values(table(spark, d, "part"), ["p_brand", "p_type", "p_size"], 10)


def profile_dataset(spark, d):
    return P.dataset_profile(view(spark, d, "lineitem", REPEATED_LINEITEM))


def profile_report(spark, d):
    return P.profile_report(table(spark, d, "orders"))


def categorical_kpis(spark, d):
    out = P.categorical_profile(table(spark, d, "part"), ["p_brand", "p_type"])
    return out.select(
        "column_name", "n_distinct", "mode",
        F.array_join(F.transform("top", lambda t: F.concat_ws("=", t["value"], t["n"].cast("string"))), ";").alias("top"),
    )


def sample_values(spark, d):
    return P.sample_values(view(spark, d, "orders", [
        "o_orderkey", "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice"
    ]), "o_totalprice", ["o_orderkey"])


def value_counts(spark, d):
    return A.value_counts(table(spark, d, "part"), "p_name")


def group_sum_mean_count(spark, d):
    out = A.group_sum_mean_count(view(spark, d, "lineitem", GAPPY_LINEITEM), "l_returnflag", "l_tax")
    return rounded(out, 4, "sum", "mean")


def ranking_multi(spark, d):
    return A.ranking(table(spark, d, "part"), "p_brand", ["p_retailprice", "p_size", "p_partkey"])


def ranking_second(spark, d):
    return A.second_ranking(view(spark, d, "lineitem", GAPPY_LINEITEM), "l_returnflag", "l_tax")


def kpi_delta(spark, d):
    out = A.kpi_delta(table(spark, d, "lineitem"), _MEASURES, F.col("l_returnflag").isin("R", "A"))
    return rounded(out, 4, "total", "mean", "base_total", "base_mean", "delta_pct")


def kpi_cards(spark, d):
    cards = [("Mean quantity", "l_quantity", "mean"), ("Largest price", "l_extendedprice", "max"), ("Lines", "l_tax", "count")]
    return rounded(A.kpi_cards(table(spark, d, "lineitem"), cards, F.col("l_returnflag") == "R"), 4, "value", "base", "delta_pct")


def monthly_trend(spark, d):
    out = A.monthly_trend(view(spark, d, "lineitem", GAPPY_LINEITEM), "l_shipdate", "l_extendedprice")
    return rounded(out, 2, "l_extendedprice_sum")


_SUMMERLESS = ["o_totalprice", "CASE WHEN month(o_orderdate) NOT IN (6, 7) THEN o_orderdate END AS o_orderdate"]
_RESAMPLED = f"""
m AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS t
      FROM ({sql_view('orders', _SUMMERLESS)}) WHERE o_orderdate IS NOT NULL GROUP BY 1),
spine AS (SELECT unnest(generate_series((SELECT min(m) FROM m), (SELECT max(m) FROM m), INTERVAL 1 MONTH)) AS m),
r AS (SELECT strftime(spine.m, '%Y-%m') AS month, coalesce(m.t, 0) AS total FROM spine LEFT JOIN m ON spine.m = m.m)"""


def monthly_resample(spark, d):
    return rounded(A.monthly_resample(view(spark, d, "orders", _SUMMERLESS), "o_orderdate", "o_totalprice"), 2, "total")


def trend_change(spark, d):
    series = A.monthly_resample(view(spark, d, "orders", _SUMMERLESS), "o_orderdate", "o_totalprice")
    return rounded(A.trend_change(series), 2, "first_total", "last_total", "change_pct")


def describe(spark, d):
    return P.describe(table(spark, d, "customer"))


def scalar_aggs(spark, d):
    out = A.scalar_aggregates(view(spark, d, "lineitem", GAPPY_LINEITEM), "l_tax")
    return rounded(out, 4, "mean", "sum", "min", "max", "std", "median")


def unique_values(spark, d):
    return A.unique_values(table(spark, d, "part"), "p_brand")


def missing_by_column(spark, d):
    return A.missing_by_column(view(spark, d, "lineitem", GAPPY_LINEITEM))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey"]


def corr_matrix(spark, d):
    out = A.correlation_matrix(view(spark, d, "lineitem", GAPPY_LINEITEM), _CORR)
    return rounded(out, 4, *_CORR)


def corr_pairs(spark, d):
    return rounded(A.correlation_pairs(view(spark, d, "lineitem", GAPPY_LINEITEM), _CORR), 4, "r")


def feature_importance(spark, d):
    return A.feature_importance(table(spark, d, "part"), "p_retailprice", ["p_partkey", "p_size", "p_retailprice"])


def share_of_total(spark, d):
    return rounded(A.share_of_total(view(spark, d, "lineitem", GAPPY_LINEITEM), "l_returnflag", "l_extendedprice"), 4, "total", "share_pct")


_SALES = [
    "o_totalprice AS sales_amount", "concat('C', CAST(o_custkey AS STRING)) AS customer", "o_orderpriority AS region",
    "o_orderstatus AS product", "o_custkey AS units",
]


def suggested_kpis(spark, d):
    return rounded(A.suggested_kpis(view(spark, d, "orders", _SALES)), 2, "value")


def fmt_number(spark, d):
    return I.formatted_totals(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_orderkey"])


QUERIES = {
    "gold_sum_by_dim": gold_sum_by_dim,
    "gold_mean_by_dim": gold_mean_by_dim,
    "gold_monthly": gold_monthly,
    "gold_tables": gold_tables,
    **{f"agg_{f}": _agg(f) for f in _AGG_SQL},
    "business_metrics": business_metrics,
    "numeric_summary": numeric_summary,
    "kpis": kpis,
    "top_category": top_category,
    "growth_rate": growth_rate,
    "top_items": top_items,
    "bottom_items": bottom_items,
    "profile_numeric": profile_numeric,
    "profile_columns": profile_columns,
    "profile_top_values": profile_top_values,
    "profile_dataset": profile_dataset,
    "profile_report": profile_report,
    "categorical_kpis": categorical_kpis,
    "sample_values": sample_values,
    "value_counts": value_counts,
    "group_sum_mean_count": group_sum_mean_count,
    "ranking_multi": ranking_multi,
    "ranking_second": ranking_second,
    "kpi_delta": kpi_delta,
    "kpi_cards": kpi_cards,
    "monthly_trend": monthly_trend,
    "monthly_resample": monthly_resample,
    "trend_change": trend_change,
    "describe": describe,
    "scalar_aggs": scalar_aggs,
    "unique_values": unique_values,
    "missing_by_column": missing_by_column,
    "corr_matrix": corr_matrix,
    "corr_pairs": corr_pairs,
    "feature_importance": feature_importance,
    "share_of_total": share_of_total,
    "suggested_kpis": suggested_kpis,
    "fmt_number": fmt_number,
}


def _per_column(source: str, columns, select: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {select.replace('$', c)} FROM {source}" for c in columns
    )


def _corr_cell(a: str, b: str) -> str:
    return "1.0" if a == b else f"round(corr({a}, {b}), 4)"


_ALL_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_MEASURES]
_GAPPY_NUMBERS = ["l_orderkey", *_MEASURES]
_PROFILE = (
    "count($) AS n_valid, round(avg($), 4) AS mean, round(CAST(quantile_cont($, 0.5) AS DOUBLE), 4) AS median, "
    "round(stddev_samp($), 4) AS std, round(CAST(min($) AS DOUBLE), 4) AS minimum, round(CAST(max($) AS DOUBLE), 4) AS maximum, "
    "round(CAST(quantile_cont($, 0.25) AS DOUBLE), 4) AS q25, round(CAST(quantile_cont($, 0.75) AS DOUBLE), 4) AS q75"
)
_DESCRIBE = _PROFILE.replace("n_valid", "count").replace("median", "q50").replace("minimum", "min").replace("maximum", "max")
_SHORT = (
    "CASE WHEN abs(t) >= 1e9 THEN printf('%.1fB', t / 1e9) WHEN abs(t) >= 1e6 THEN printf('%.1fM', t / 1e6) "
    "WHEN abs(t) >= 1e3 THEN printf('%.1fK', t / 1e3) WHEN t = floor(t) THEN printf('%d', CAST(t AS BIGINT)) "
    "ELSE printf('%.2f', t) END"
)

SQL = {
    "gold_sum_by_dim": "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice_sum FROM lineitem "
                       "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "gold_mean_by_dim": f"SELECT l_returnflag, round(avg(l_extendedprice), 4) AS l_extendedprice_mean FROM {_GAPPY} "
                        "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "gold_monthly": "SELECT strftime(l_shipdate, '%Y-%m') AS month, round(sum(l_extendedprice), 2) AS l_extendedprice_sum "
                    "FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "gold_tables": _gold_sql(),
    **{
        f"agg_{f}": f"SELECT l_returnflag, " + (e if f == "count" else f"round({e}, 4)") + f" AS l_tax FROM {_GAPPY} GROUP BY 1"
        for f, e in _AGG_SQL.items()
    },
    "business_metrics": _per_column("lineitem", _ALL_NUMBERS,
        "round(CAST(sum($) AS DOUBLE), 2) AS total, round(avg($), 4) AS mean, round(CAST(median($) AS DOUBLE), 4) AS median, "
        "round(stddev_samp($), 4) AS std, round(CAST(min($) AS DOUBLE), 2) AS minimum, round(CAST(max($) AS DOUBLE), 2) AS maximum"),
    "numeric_summary": _per_column(_GAPPY, _MEASURES,
        "round(sum($), 2) AS total, round(avg($), 2) AS mean, round(median($), 2) AS median, round(stddev_samp($), 2) AS std"
    ).replace("AS column_name", "AS metric"),
    "kpis": f"SELECT 'Total Records' AS kpi, CAST(count(*) AS DOUBLE) AS value FROM {_GAPPY} UNION ALL SELECT 'Total Columns', 7.0 "
            + " ".join(f"UNION ALL SELECT 'Total {m}', round(sum({m}), 2) FROM {_GAPPY} UNION ALL SELECT 'Avg {m}', round(avg({m}), 2) FROM {_GAPPY}"
                       for m in _MEASURES),
    "top_category": " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM part GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)"
        for c in ("p_brand", "p_type", "p_name")
    ),
    "growth_rate": """
SELECT 'value' AS column_name, a AS first_value, b AS last_value, round((b - a) / abs(a) * 100, 4) AS growth_pct
FROM (SELECT (SELECT value FROM events ORDER BY ts, event_id LIMIT 1) AS a,
             (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS b)""",
    "top_items": "SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice_sum FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "bottom_items": "SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice_sum FROM orders GROUP BY 1 ORDER BY 2, 1 LIMIT 10",
    "profile_numeric": _per_column(_GAPPY, _GAPPY_NUMBERS, _PROFILE),
    "profile_columns": _per_column(_GAPPY, [*_GAPPY_NUMBERS, "l_returnflag", "l_shipdate"],
        "count($) AS n_valid, count(*) - count($) AS n_missing, round((count(*) - count($)) * 100.0 / count(*), 2) AS missing_pct, "
        "count(DISTINCT $) AS n_distinct, round(count(DISTINCT $) * 100.0 / count(*), 2) AS distinct_pct"),
    "profile_top_values": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, value, n, place FROM (SELECT CAST({c} AS STRING) AS value, count(*) AS n, "
        f"CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS STRING)) AS INTEGER) AS place FROM part GROUP BY {c}) WHERE place <= 10"
        for c in ("p_brand", "p_type", "p_size")
    ),
    "profile_dataset": f"""
WITH t AS ({sql_view('lineitem', REPEATED_LINEITEM)}), u AS (SELECT DISTINCT * FROM t)
SELECT (SELECT count(*) FROM t) AS n_rows, CAST(5 AS BIGINT) AS n_columns,
       (SELECT count(*) FROM t) - (SELECT count(*) FROM u) AS n_duplicates,
       round(((SELECT count(*) FROM t) - (SELECT count(*) FROM u)) * 100.0 / (SELECT count(*) FROM t), 2) AS duplicate_pct,
       CAST(3 AS BIGINT) AS n_numeric, CAST(2 AS BIGINT) AS n_text, CAST(0 AS BIGINT) AS n_datetime,
       CAST(0 AS BIGINT) AS n_incomplete, CAST(0 AS BIGINT) AS n_missing""",
    "categorical_kpis": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, (SELECT count(DISTINCT {c}) FROM part) AS n_distinct, "
        f"first(v ORDER BY place) AS mode, string_agg(v || '=' || n, ';' ORDER BY place) AS top "
        f"FROM (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS place FROM part GROUP BY {c}) "
        f"WHERE place <= 10"
        for c in ("p_brand", "p_type")
    ),
    "sample_values": "SELECT o_totalprice FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderkey LIMIT 5",
    "value_counts": "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "group_sum_mean_count": f"SELECT l_returnflag, round(coalesce(sum(l_tax), 0), 4) AS sum, round(avg(l_tax), 4) AS mean, "
                            f"count(l_tax) AS count FROM {_GAPPY} WHERE l_returnflag IS NOT NULL GROUP BY 1",
    "ranking_multi": "SELECT p_brand, " + ", ".join(
        f"round(CAST(sum({m}) AS DOUBLE), 2) AS sum_{m}, round(avg({m}), 2) AS mean_{m}"
        for m in ("p_retailprice", "p_size", "p_partkey")
    ) + ", count(*) AS n FROM part GROUP BY 1 ORDER BY sum_p_retailprice DESC, 1 LIMIT 10",
    "ranking_second": f"SELECT l_returnflag, round(coalesce(sum(l_tax), 0), 2) AS sum, round(avg(l_tax), 2) AS mean, count(l_tax) AS count "
                      f"FROM {_GAPPY} WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "kpi_delta": " UNION ALL ".join(
        f"SELECT '{m}' AS column_name, round(a, 4) AS total, round(am, 4) AS mean, round(b, 4) AS base_total, round(bm, 4) AS base_mean, "
        f"round((a - b) / abs(b) * 100, 4) AS delta_pct FROM (SELECT sum({m}) FILTER (WHERE l_returnflag IN ('R', 'A')) AS a, "
        f"avg({m}) FILTER (WHERE l_returnflag IN ('R', 'A')) AS am, sum({m}) AS b, avg({m}) AS bm FROM lineitem)"
        for m in _MEASURES
    ),
    "kpi_cards": " UNION ALL ".join(
        f"SELECT '{label}' AS label, round(CAST(a AS DOUBLE), 4) AS value, round(CAST(b AS DOUBLE), 4) AS base, "
        f"round((a - b) * 100.0 / abs(b), 4) AS delta_pct FROM (SELECT {fn} FILTER (WHERE l_returnflag = 'R') AS a, {fn} AS b FROM lineitem)"
        for label, fn in (("Mean quantity", "avg(l_quantity)"), ("Largest price", "max(l_extendedprice)"), ("Lines", "count(l_tax)"))
    ),
    "monthly_trend": f"SELECT strftime(l_shipdate, '%Y-%m') AS month, round(sum(l_extendedprice), 2) AS l_extendedprice_sum "
                     f"FROM {_GAPPY} WHERE l_shipdate IS NOT NULL GROUP BY 1",
    "monthly_resample": f"WITH {_RESAMPLED} SELECT month, round(total, 2) AS total FROM r",
    "trend_change": f"""
WITH {_RESAMPLED}, e AS (SELECT min(month) AS a, max(month) AS b FROM r)
SELECT a AS first_month, b AS last_month, round(x.total, 2) AS first_total, round(y.total, 2) AS last_total,
       round((y.total - x.total) / abs(x.total) * 100, 2) AS change_pct
FROM e JOIN r x ON x.month = a JOIN r y ON y.month = b""",
    "describe": _per_column("customer", ["c_custkey", "c_nationkey", "c_acctbal"], _DESCRIBE),
    "scalar_aggs": f"""
SELECT 'l_tax' AS column_name, count(*) AS n_rows, count(l_tax) AS count, round(avg(l_tax), 4) AS mean, round(sum(l_tax), 4) AS sum,
       round(min(l_tax), 4) AS min, round(max(l_tax), 4) AS max, round(stddev_samp(l_tax), 4) AS std,
       count(DISTINCT l_tax) AS n_distinct, round(median(l_tax), 4) AS median FROM {_GAPPY}""",
    "unique_values": "SELECT DISTINCT p_brand FROM part",
    "missing_by_column": "SELECT * FROM (" + _per_column(_GAPPY, ["l_discount", "l_tax", "l_returnflag", "l_shipdate"],
                                                         "count(*) - count($) AS n_missing") + ") WHERE n_missing > 0",
    "corr_matrix": " UNION ALL ".join(
        f"SELECT '{a}' AS column_name, " + ", ".join(f"{_corr_cell(a, b)} AS {b}" for b in _CORR) + f" FROM {_GAPPY}"
        for a in _CORR
    ),
    "corr_pairs": " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) AS r FROM {_GAPPY}"
        for i, a in enumerate(_CORR) for b in _CORR[i + 1:]
    ),
    "feature_importance": _per_column("part", ["p_partkey", "p_size"], "round(abs(corr($, p_retailprice)), 4) AS importance"),
    "share_of_total": f"""
SELECT l_returnflag, round(sum(l_extendedprice), 4) AS total,
       round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem) * 100, 4) AS share_pct
FROM {_GAPPY} WHERE l_returnflag IS NOT NULL GROUP BY 1""",
    "suggested_kpis": f"""
WITH t AS ({sql_view('orders', _SALES)})
SELECT 'Total sales_amount' AS kpi, 'aggregate' AS kind, CAST(NULL AS STRING) AS key, round(sum(sales_amount), 2) AS value FROM t
UNION ALL SELECT 'Average sales_amount', 'aggregate', NULL, round(avg(sales_amount), 2) FROM t
UNION ALL SELECT 'Total units', 'aggregate', NULL, round(CAST(sum(units) AS DOUBLE), 2) FROM t
UNION ALL SELECT 'sales_amount by customer', 'grouped', customer, round(sum(sales_amount), 2) FROM t GROUP BY customer
UNION ALL SELECT 'sales_amount by region', 'grouped', region, round(sum(sales_amount), 2) FROM t GROUP BY region
UNION ALL SELECT 'Top product', 'ranking', product, n FROM
  (SELECT product, CAST(count(*) AS DOUBLE) AS n FROM t GROUP BY product ORDER BY 2 DESC, 1 LIMIT 10)""",
    "fmt_number": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{'$' if 'price' in c else ''}' || {_SHORT} AS total FROM (SELECT CAST(sum({c}) AS DOUBLE) AS t FROM lineitem)"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_orderkey")
    ),
}
