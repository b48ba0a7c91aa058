"""The data behind charts."""

from __future__ import annotations

from tablewright.operators import charts as V
from workload.common import GAPPY_LINEITEM, rounded, sql_view, table, view

_GAPPY = f"({sql_view('lineitem', GAPPY_LINEITEM)})"
_FIVE = ", ".join(
    f"round(quantile_cont(l_extendedprice, {p}), 4) AS {n}"
    for p, n in ((0.0, "minimum"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "maximum"))
)
_BOX = ("minimum", "q1", "median", "q3", "maximum")


def chart_bar(spark, d):
    return rounded(V.bar(view(spark, d, "lineitem", GAPPY_LINEITEM), "l_returnflag", "l_extendedprice"), 2, "l_extendedprice_sum")


def chart_bar_mean(spark, d):
    return rounded(V.bar(table(spark, d, "part"), "p_brand", "p_retailprice", "mean", 15), 4, "p_retailprice_mean")


def chart_bar_median(spark, d):
    return rounded(V.bar(table(spark, d, "part"), "p_brand", "p_retailprice", "median", 12), 4, "p_retailprice_median")


def treemap(spark, d):
    return rounded(V.treemap(table(spark, d, "part"), "p_brand", "p_retailprice"), 2, "p_retailprice_sum")


def grouped_topn(spark, d):
    return rounded(V.grouped_bar(table(spark, d, "part"), "p_brand", "p_retailprice", "p_type", top_n=5), 2, "p_retailprice_sum")


def chart_line(spark, d):
    return rounded(V.line(table(spark, d, "orders"), "o_orderdate", "o_totalprice"), 2, "o_totalprice_sum")


def chart_line_number(spark, d):
    return rounded(V.line(table(spark, d, "part"), "p_size", "p_retailprice", "mean"), 4, "p_retailprice_mean")


def scatter_sample(spark, d):
    return V.scatter(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


def chart_pie(spark, d):
    return V.pie(table(spark, d, "orders"), "o_orderpriority", 3)


def box_summary(spark, d):
    return rounded(V.box(table(spark, d, "lineitem"), "l_extendedprice"), 4, *_BOX)


def box_by_group(spark, d):
    return rounded(V.box(view(spark, d, "lineitem", GAPPY_LINEITEM), "l_extendedprice", "l_returnflag"), 4, *_BOX)


def histogram(spark, d):
    return rounded(V.histogram(table(spark, d, "events"), "value", 30), 6, "lower", "upper")


def heatmap(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    return rounded(V.heatmap(table(spark, d, "lineitem"), names), 2, *names)


def time_series(spark, d):
    return V.time_series(view(spark, d, "lineitem", GAPPY_LINEITEM), "l_shipdate", "l_tax")


QUERIES = {
    "chart_bar": chart_bar,
    "chart_bar_mean": chart_bar_mean,
    "chart_bar_median": chart_bar_median,
    "treemap": treemap,
    "grouped_topn": grouped_topn,
    "chart_line": chart_line,
    "chart_line_number": chart_line_number,
    "scatter_sample": scatter_sample,
    "chart_pie": chart_pie,
    "box_summary": box_summary,
    "box_by_group": box_by_group,
    "histogram": histogram,
    "heatmap": heatmap,
    "time_series": time_series,
}

SQL = {
    "chart_bar": f"SELECT l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice_sum FROM {_GAPPY} WHERE l_returnflag IS NOT NULL "
                 "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "chart_bar_mean": "SELECT p_brand, round(avg(p_retailprice), 4) AS p_retailprice_mean FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "chart_bar_median": "SELECT p_brand, round(median(p_retailprice), 4) AS p_retailprice_median FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
    "treemap": "SELECT p_brand, round(sum(p_retailprice), 2) AS p_retailprice_sum FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
    "grouped_topn": "SELECT p_brand, p_type, round(sum(p_retailprice), 2) AS p_retailprice_sum FROM part WHERE p_brand IN "
                    "(SELECT p_brand FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, 1 LIMIT 5) GROUP BY 1, 2",
    "chart_line": "SELECT strftime(o_orderdate, '%Y-%m') AS x, round(sum(o_totalprice), 2) AS o_totalprice_sum FROM orders GROUP BY 1",
    "chart_line_number": "SELECT p_size AS x, round(avg(p_retailprice), 4) AS p_retailprice_mean FROM part GROUP BY 1",
    "chart_pie": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "box_summary": f"SELECT 'l_extendedprice' AS column_name, count(l_extendedprice) AS n, {_FIVE} FROM lineitem",
    "box_by_group": f"SELECT l_returnflag, count(l_extendedprice) AS n, {_FIVE} FROM {_GAPPY} WHERE l_returnflag IS NOT NULL GROUP BY 1",
    "histogram": """
WITH e AS (SELECT min(value) AS a, (max(value) - min(value)) / 30 AS w FROM events),
 c AS (SELECT least(29, CAST(floor((value - a) / w) AS INTEGER)) AS bin, count(*) AS n FROM events, e GROUP BY 1)
SELECT CAST(s.bin AS INTEGER) AS bin, round(a + s.bin * w, 6) AS lower, round(a + (s.bin + 1) * w, 6) AS upper, coalesce(n, 0) AS n
FROM e, (SELECT unnest(range(30)) AS bin) s LEFT JOIN c ON c.bin = s.bin""",
    "heatmap": " UNION ALL ".join(
        f"SELECT '{a}' AS column_name, " + ", ".join(
            ("1.0" if a == b else f"round(corr({a}, {b}), 2)") + f" AS {b}" for b in ("l_quantity", "l_extendedprice", "l_discount")
        ) + " FROM lineitem" for a in ("l_quantity", "l_extendedprice", "l_discount")
    ),
    "time_series": f"SELECT l_shipdate, l_tax FROM {_GAPPY} WHERE l_shipdate IS NOT NULL AND l_tax IS NOT NULL",
}
