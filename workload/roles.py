"""Column roles and types."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.names import ID_NAME
from tablewright.operators import profile as P
from tablewright.operators import roles as R
from tablewright.plans.stats import whole_numbers as whole
from workload.common import TEXT_ORDERS, rounded, table, view

# What each table's columns are, for the SQL side.
_SHAPES = {
    "lineitem": {
        "l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int",
        "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
        "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "time",
    },
    "orders": {
        "o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "float",
        "o_orderdate": "time", "o_orderpriority": "text",
    },
    "customer": {
        "c_custkey": "int", "c_name": "text", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "text",
    },
    "part": {
        "p_partkey": "int", "p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "int",
        "p_retailprice": "float",
    },
    "events": {
        "event_id": "int", "ts": "time", "user_id": "int", "event_type": "text", "value": "float", "props": "text",
    },
}


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def column_roles(spark, d):
    return _union([
        R.column_roles(table(spark, d, t)).select(
            F.lit(t).alias("table_name"), "column_name", "role", "is_dimension", "n_rows"
        )
        for t in _SHAPES
    ])


def _role_sql(t: str, c: str, shape: str) -> str:
    head = f"'{t}' AS table_name, '{c}' AS column_name"
    by_name = f"regexp_matches('{c}', '{ID_NAME.pattern}')"
    if shape == "time":
        return f"SELECT {head}, 'datetime' AS role, false AS is_dimension, count(*) AS n_rows FROM {t}"
    if shape == "float":
        return (f"SELECT {head}, CASE WHEN {by_name} THEN 'id' ELSE 'measure' END AS role, "
                f"false AS is_dimension, count(*) AS n_rows FROM {t}")
    if shape == "text":
        return (f"SELECT {head}, CASE WHEN count(DISTINCT {c}) * 1.0 / count(*) > 0.5 AND count(DISTINCT {c}) > 50 "
                f"THEN 'high_cardinality' ELSE 'dimension' END AS role, "
                f"count(DISTINCT {c}) BETWEEN 2 AND 50 AS is_dimension, count(*) AS n_rows FROM {t}")
    return f"""
SELECT {head}, CASE
  WHEN {by_name} THEN 'id'
  WHEN n > 20 AND d * 1.0 / n > 0.95 AND (unit * 1.0 / (n - 1) > 0.9 OR (low >= 0 AND d * 1.0 / n > 0.99)) THEN 'id'
  WHEN n > 50 AND low >= 0 AND d * 1.0 / n > 0.8 AND spread < 2 THEN 'id'
  ELSE 'measure' END AS role, false AS is_dimension, n AS n_rows
FROM (SELECT count(*) AS n, count(DISTINCT v) AS d, min(v) AS low, count(*) FILTER (WHERE gap = 1) AS unit,
             stddev_pop(gap) AS spread
      FROM (SELECT {c} AS v, {c} - lag({c}) OVER (ORDER BY {c}) AS gap FROM {t}))"""


def id_stats(spark, d):
    out = R.id_statistics(table(spark, d, "orders"), ["o_orderkey", "o_custkey"]).unionByName(
        R.id_statistics(table(spark, d, "lineitem"), ["l_orderkey"])
    )
    return rounded(out, 6, "gap_mean", "gap_std")


def _id_sql(t: str, c: str) -> str:
    return f"""
SELECT '{c}' AS column_name, count(*) AS n_values, count(DISTINCT v) AS n_distinct,
       count(*) FILTER (WHERE gap = 1) AS n_unit, round(avg(gap), 6) AS gap_mean,
       round(stddev_pop(gap), 6) AS gap_std, CAST(min(v) AS DOUBLE) AS minimum, CAST(max(v) AS DOUBLE) AS maximum
FROM (SELECT {c} AS v, {c} - lag({c}) OVER (ORDER BY {c}) AS gap FROM {t})"""


def adjacent_diff(spark, d):
    from tablewright.plans.gaps import adjacent_gaps

    events, part = table(spark, d, "events"), table(spark, d, "lineitem")
    out = adjacent_gaps(events, "user_id").select(F.lit("user_id").alias("column_name"), "*").unionByName(
        adjacent_gaps(part, "l_partkey").select(F.lit("l_partkey").alias("column_name"), "*")
    )
    return rounded(out, 6, "gap_mean", "gap_std")


def dimension_cardinality(spark, d):
    return R.dimension_cardinality(table(spark, d, "part")).unionByName(
        R.dimension_cardinality(table(spark, d, "orders"))
    )


def string_types(spark, d):
    out = R.text_profile_types(table(spark, d, "documents")).unionByName(
        R.text_profile_types(table(spark, d, "customer"))
    ).unionByName(R.text_profile_types(table(spark, d, "part")))
    return rounded(out, 4, "mean_length")


def _string_sql(t: str, c: str) -> str:
    return f"""
SELECT '{c}' AS column_name, n AS n_valid, d AS n_distinct, round(len, 4) AS mean_length, CASE
  WHEN len > 50 THEN 'text' WHEN d <= 30 OR d * 1.0 / n < 0.05 THEN 'categorical'
  WHEN d * 1.0 / n > 0.5 THEN 'identifier' WHEN d * 1.0 / n < 0.3 THEN 'categorical'
  ELSE 'identifier' END AS profile_type
FROM (SELECT count({c}) AS n, count(DISTINCT {c}) AS d, avg(length({c})) AS len FROM {t})"""


def date_like_text(spark, d):
    orders = table(spark, d, "orders").selectExpr("o_orderkey", *TEXT_ORDERS)
    return R.date_like_text(orders)


_DATE_LIKE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS n_checked, bool_and(try_strptime(v, '%Y-%m-%d') IS NOT NULL) AS is_datetime
FROM (SELECT {c} AS v FROM (SELECT o_orderkey, {', '.join(TEXT_ORDERS)} FROM orders)
      WHERE {c} IS NOT NULL)"""
    for c in ("order_text", "date_text", "some_dates", "priority_text")
)


def structure(spark, d):
    return R.structure(table(spark, d, "customer"))


def _structure_sql(c: str, kind: str) -> str:
    d = f"count(DISTINCT {c})"
    by_size = f"CASE WHEN {d} > 50 THEN 'high' WHEN {d} <= 10 THEN 'low' END" if kind == "text" else "CAST(NULL AS STRING)"
    return (f"SELECT '{c}' AS column_name, '{kind}' AS kind, count(*) AS n_rows, {d} AS n_distinct, "
            f"({d} = count(*) OR contains('{c}', 'id')) AS id_candidate, {by_size} AS cardinality FROM customer")


def profile_types(spark, d):
    return P.profile_types(table(spark, d, "customer"))


_WIDE = ["o_orderkey + 9007199254740993 AS beyond_doubles", "CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS o_custkey", "o_totalprice"]


def whole_numbers(spark, d):
    """Totals and extremes that doubles cannot hold."""
    return whole(view(spark, d, "orders", _WIDE))


QUERIES = {
    "whole_numbers": whole_numbers,
    "column_roles": column_roles,
    "id_stats": id_stats,
    "adjacent_diff": adjacent_diff,
    "dimension_cardinality": dimension_cardinality,
    "string_types": string_types,
    "date_like_text": date_like_text,
    "structure": structure,
    "profile_types": profile_types,
}

SQL = {
    "whole_numbers": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n_valid, sum({c})::DECIMAL(38,0) AS total, min({c}) AS minimum, max({c}) AS maximum FROM (SELECT {', '.join(_WIDE)} FROM orders)"
        for c in ("beyond_doubles", "o_custkey")),
    "column_roles": " UNION ALL ".join(_role_sql(t, c, s) for t, cols in _SHAPES.items() for c, s in cols.items()),
    "id_stats": " UNION ALL ".join(
        _id_sql(t, c) for t, c in (("orders", "o_orderkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"))
    ),
    "adjacent_diff": " UNION ALL ".join(
        f"SELECT * EXCLUDE (minimum, maximum) FROM ({_id_sql(t, c)})" for t, c in (("events", "user_id"), ("lineitem", "l_partkey"))
    ),
    "dimension_cardinality": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, "
        f"count(DISTINCT {c}) BETWEEN 2 AND 50 AS is_dimension FROM {t}"
        for t in ("part", "orders") for c, s in _SHAPES[t].items() if s == "text"
    ),
    "string_types": " UNION ALL ".join(
        _string_sql(t, c)
        for t, c in (
            ("documents", "text"), ("documents", "lang"), ("documents", "source"), ("customer", "c_name"),
            ("customer", "c_mktsegment"), ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"),
        )
    ),
    "date_like_text": _DATE_LIKE_SQL,
    "structure": " UNION ALL ".join(
        _structure_sql(c, {"int": "numeric", "float": "numeric", "text": "text"}[s])
        for c, s in _SHAPES["customer"].items()
    ),
    "profile_types": " UNION ALL ".join([
        "SELECT 'c_custkey' AS column_name, CASE WHEN count(DISTINCT c_custkey) * 1.0 / count(*) > 0.99 AND "
        "min(c_custkey) >= 0 AND count(*) > 20 THEN 'identifier' ELSE 'numeric' END AS profile_type FROM customer",
        "SELECT 'c_nationkey', CASE WHEN count(DISTINCT c_nationkey) * 1.0 / count(*) > 0.8 THEN 'identifier' "
        "ELSE 'numeric' END FROM customer",
        "SELECT 'c_acctbal', 'numeric'",
        f"SELECT column_name, profile_type FROM ({_string_sql('customer', 'c_name')})",
        f"SELECT column_name, profile_type FROM ({_string_sql('customer', 'c_mktsegment')})",
    ]),
}
