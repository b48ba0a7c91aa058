"""Cleaning, derived columns and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import aggregate as A
from tablewright.operators import clean as C
from workload.common import GAPPY_LINEITEM, REPEATED_LINEITEM, TEXT_ORDERS, rounded, sql_view, table, view

_TO_CLEAN = [
    "l_quantity AS `L Quantity`",
    "nullif(l_discount, 0) AS `L-Discount (rate)`",
    "CASE WHEN l_quantity > 35 THEN l_returnflag END AS `Return Flag`",
    "CAST(l_linenumber AS STRING) AS `Line No.`",
    "CASE WHEN l_tax > 0 THEN CAST(CAST(l_shipdate AS DATE) AS STRING) END AS ShipDay",
]
_CLEAN_SQL = """
WITH raw AS (
  SELECT DISTINCT l_quantity, nullif(l_discount, 0) AS l_discount_rate,
         CASE WHEN l_quantity > 35 THEN l_returnflag END AS return_flag,
         l_linenumber AS line_no, CASE WHEN l_tax > 0 THEN CAST(l_shipdate AS DATE) END AS shipday
  FROM lineitem),
 s AS (SELECT median(l_discount_rate) AS m FROM raw),
 f AS (SELECT return_flag AS mode FROM raw WHERE return_flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 g AS (SELECT shipday AS day FROM raw WHERE shipday IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 done AS (SELECT l_quantity, coalesce(l_discount_rate, s.m) AS l_discount_rate,
                 coalesce(return_flag, f.mode) AS return_flag, CAST(line_no AS DOUBLE) AS line_no,
                 coalesce(shipday, g.day) AS shipday
          FROM raw, s, f, g)
"""


def std_names(spark, d):
    loud = table(spark, d, "orders").selectExpr(
        "o_orderkey AS `Order Key`", "o_totalprice AS `  Total-Price ($)`", "o_orderstatus AS STATUS"
    )
    return C.standardize_names(loud)


def dedup(spark, d):
    return C.drop_duplicates(view(spark, d, "lineitem", REPEATED_LINEITEM))


def fill_missing(spark, d):
    gappy = view(spark, d, "lineitem", [c for c in GAPPY_LINEITEM if "l_shipdate" not in c])
    return rounded(C.fill_missing(gappy)[0], 6, "l_discount", "l_tax")


def normalize_types(spark, d):
    out = C.normalize_types(view(spark, d, "orders", TEXT_ORDERS))[0]
    return out.withColumns({c: F.col(c).cast("date") for c in ("date_text", "some_dates")})


_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
# Order dates as text: with times of several shapes, with the day first, and in the order nothing tells apart.
_DATED = [
    "o_orderkey",
    f"CASE o_orderkey % 4 WHEN 0 THEN concat({_DAY}, 'T10:30:15.25') WHEN 1 THEN concat({_DAY}, ' 10:30') "
    f"WHEN 2 THEN concat({_DAY}, 'T12:30:00+02:00') ELSE concat({_DAY}, 'T23:59:59Z') END AS stamped",
    f"concat(substr({_DAY}, 9, 2), '/', substr({_DAY}, 6, 2), '/', substr({_DAY}, 1, 4)) AS day_first",
    f"concat(substr({_DAY}, 6, 2), '/', substr({_DAY}, 9, 2), '/', substr({_DAY}, 1, 4), ' 7:05') AS month_first",
    "concat('note ', o_orderpriority) AS words",
]


def mixed_dates(spark, d):
    out, _ = C.normalize_types(view(spark, d, "orders", _DATED))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("stamped", "day_first", "month_first")})


def mixed_dates_log(spark, d):
    log = C.normalize_types(view(spark, d, "orders", _DATED))[1]
    return spark.createDataFrame(sorted(log.items()), "column_name string, change string")


def unfilled_dates(spark, d):
    """What a fill without an order says of each column."""
    log = C.fill_missing(view(spark, d, "lineitem", ["l_orderkey", "CASE WHEN l_linestatus = 'O' THEN l_shipdate END AS shipped"]))[1]
    return spark.createDataFrame(sorted(log.items()), "column_name string, filled string")


def drop_all_null(spark, d):
    return C.drop_all_null(view(spark, d, "lineitem", ["nullif(l_discount, 0) AS l_discount", "nullif(l_tax, 0) AS l_tax"]))


def _cleaned(spark, d):
    return C.clean(view(spark, d, "lineitem", _TO_CLEAN))


def silver_clean(spark, d):
    return rounded(_cleaned(spark, d)[0].withColumn("shipday", F.col("shipday").cast("date")), 6, "l_discount_rate")


def silver_log(spark, d):
    return _cleaned(spark, d)[1].select("step", "operation", "rows_removed", F.array_join(F.array_sort(F.map_keys("detail")), ",").alias("columns"))


def ffill(spark, d):
    gappy = table(spark, d, "events").selectExpr(
        "event_id", "CASE WHEN event_type <> 'error' AND value > 20 THEN ts END AS seen_at", "event_type"
    )
    return C.forward_fill(gappy, ["seen_at"], ["event_id"])


def derived_columns(spark, d):
    gappy = view(spark, d, "orders", [
        "o_orderkey", "o_custkey", "CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS o_totalprice", "o_orderdate"
    ])
    return rounded(C.add_derived_columns(gappy), 4, "_row_total", "_row_mean")


def transform_metrics(spark, d):
    out = C.transform(table(spark, d, "orders").drop("o_orderpriority"))[1]
    return rounded(out, 2, "total", "minimum", "maximum")


def dim_filter(spark, d):
    return A.filter_in(table(spark, d, "orders"), {"o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "5-LOW"]})


def row_at_max(spark, d):
    return A.row_at_extreme(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"])


def row_at_min(spark, d):
    return A.row_at_extreme(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"], largest=False)


def nlargest(spark, d):
    return A.top_rows(table(spark, d, "lineitem"), "l_extendedprice", 10, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def nsmallest(spark, d):
    return A.top_rows(table(spark, d, "lineitem"), "l_extendedprice", 10, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], largest=False)


def first_rows(spark, d):
    return A.first_rows(table(spark, d, "orders"), 5, ["o_orderkey"])


def last_rows(spark, d):
    return A.first_rows(table(spark, d, "orders"), 5, ["o_orderkey"], last=True)


QUERIES = {
    "std_names": std_names,
    "dedup": dedup,
    "fill_missing": fill_missing,
    "normalize_types": normalize_types,
    "drop_all_null": drop_all_null,
    "silver_clean": silver_clean,
    "silver_log": silver_log,
    "ffill": ffill,
    "derived_columns": derived_columns,
    "transform_metrics": transform_metrics,
    "mixed_dates": mixed_dates,
    "mixed_dates_log": mixed_dates_log,
    "unfilled_dates": unfilled_dates,
    "dim_filter": dim_filter,
    "row_at_max": row_at_max,
    "row_at_min": row_at_min,
    "nlargest": nlargest,
    "nsmallest": nsmallest,
    "first_rows": first_rows,
    "last_rows": last_rows,
}

_D = "CAST(o_orderdate AS DATE)"
SQL = {
    "mixed_dates": f"""
SELECT o_orderkey, {_D} + CASE o_orderkey % 4 WHEN 0 THEN INTERVAL '10 hours 30 minutes 15.25 seconds' WHEN 3 THEN INTERVAL '23 hours 59 minutes 59 seconds'
       ELSE INTERVAL '10 hours 30 minutes' END AS stamped, CAST({_D} AS TIMESTAMP) AS day_first,
       {_D} + INTERVAL '7 hours 5 minutes' AS month_first, concat('note ', o_orderpriority) AS words FROM orders""",
    "mixed_dates_log": f"""
SELECT * FROM (VALUES ('day_first', 'text to timestamp, day first'), ('month_first', 'text to timestamp'), ('stamped', 'text to timestamp')) AS v(column_name, change)
WHERE (SELECT max(day({_D})) > 12 FROM orders)""",
    "unfilled_dates": "SELECT 'shipped' AS column_name, 'left missing, as no order is given' AS filled WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_linestatus <> 'O')",
    "std_names": "SELECT o_orderkey AS order_key, o_totalprice AS total_price, o_orderstatus AS status FROM orders",
    "dedup": f"SELECT DISTINCT {', '.join(REPEATED_LINEITEM)} FROM lineitem",
    "fill_missing": f"""
WITH t AS ({sql_view('lineitem', [c for c in GAPPY_LINEITEM if 'l_shipdate' not in c])}),
 m AS (SELECT median(l_discount) AS d, median(l_tax) AS x FROM t),
 f AS (SELECT l_returnflag AS mode FROM t WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT l_orderkey, l_quantity, l_extendedprice, round(coalesce(l_discount, m.d), 6) AS l_discount,
       round(coalesce(l_tax, m.x), 6) AS l_tax, coalesce(l_returnflag, f.mode) AS l_returnflag FROM t, m, f""",
    "normalize_types": f"""
SELECT CAST(order_text AS DOUBLE) AS order_text, CAST(date_text AS DATE) AS date_text,
       CAST(some_dates AS DATE) AS some_dates, priority_text FROM ({sql_view('orders', TEXT_ORDERS)})""",
    "drop_all_null": "SELECT * FROM (SELECT nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem) "
                     "WHERE l_discount IS NOT NULL OR l_tax IS NOT NULL",
    "silver_clean": _CLEAN_SQL + "SELECT * REPLACE (round(l_discount_rate, 6) AS l_discount_rate) FROM done",
    "silver_log": _CLEAN_SQL + """
SELECT 1 AS step, 'standardize_column_names' AS operation, CAST(0 AS BIGINT) AS rows_removed,
       'L Quantity,L-Discount (rate),Line No.,Return Flag,ShipDay' AS columns
UNION ALL SELECT 2, 'remove_duplicates', (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM raw), ''
UNION ALL SELECT 3, 'fill_missing_values', 0, 'l_discount_rate,return_flag,shipday'
UNION ALL SELECT 4, 'normalize_data_types', 0, 'line_no,shipday'
UNION ALL SELECT 5, 'remove_invalid_rows', 0, ''""",
    "ffill": """
SELECT event_id, event_type, last_value(seen_at IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen_at
FROM (SELECT event_id, event_type, CASE WHEN event_type <> 'error' AND value > 20 THEN ts END AS seen_at FROM events)""",
    "derived_columns": """
SELECT o_orderkey, o_custkey, p AS o_totalprice, o_orderdate,
       round(o_orderkey + o_custkey + coalesce(p, 0), 4) AS _row_total,
       round((o_orderkey + o_custkey + coalesce(p, 0)) / (CASE WHEN p IS NULL THEN 2 ELSE 3 END), 4) AS _row_mean,
       CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
       CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek
FROM (SELECT *, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS p FROM orders)""",
    "transform_metrics": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(CAST(sum(v) AS DOUBLE), 2) AS total, round(avg(v), 4) AS mean, "
        f"round(CAST(median(v) AS DOUBLE), 4) AS median, round(stddev_samp(v), 4) AS std, round(CAST(min(v) AS DOUBLE), 2) AS minimum, "
        f"round(CAST(max(v) AS DOUBLE), 2) AS maximum FROM (SELECT {e} AS v FROM orders)"
        for c, e in (
            ("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey"), ("o_totalprice", "o_totalprice"),
            ("_row_total", "o_orderkey + o_custkey + o_totalprice"), ("_row_mean", "(o_orderkey + o_custkey + o_totalprice) / 3"),
            ("o_orderdate_year", "year(o_orderdate)"), ("o_orderdate_month", "month(o_orderdate)"),
            ("o_orderdate_dayofweek", "isodow(o_orderdate) - 1"),
        )
    ),
    "dim_filter": "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '5-LOW')",
    "row_at_max": "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1",
    "row_at_min": "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1",
    "nlargest": "SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10",
    "nsmallest": "SELECT * FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10",
    "first_rows": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
    "last_rows": "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 5",
}
