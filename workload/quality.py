"""Quality checks, scores and diagnoses, on views with gaps, repeats and loose text."""

from __future__ import annotations


from tablewright.operators import quality as Q
from tablewright.plans.outliers import iqr_outliers
from tablewright.plans.stats import column_stats, duplicate_counts, pin
from workload.common import GAPPY_LINEITEM, LOOSE_LINEITEM, REPEATED_LINEITEM, sql_view, table, view

_GAPPY = f"({sql_view('lineitem', GAPPY_LINEITEM)})"
_LOOSE = f"({sql_view('lineitem', LOOSE_LINEITEM)})"
_GAPPY_COLUMNS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"]
_LOOSE_COLUMNS = ["net_quantity", "discount_code", "flag", "status", "tax", "one", "nothing"]


def check_nulls(spark, d):
    return Q.null_alerts(column_stats(view(spark, d, "lineitem", GAPPY_LINEITEM))).drop("message")


def check_duplicates(spark, d):
    return Q.duplicate_alerts(duplicate_counts(view(spark, d, "lineitem", REPEATED_LINEITEM))).drop("message")


def check_negative(spark, d):
    return Q.negative_alerts(column_stats(view(spark, d, "lineitem", LOOSE_LINEITEM))).unionByName(
        Q.negative_alerts(column_stats(table(spark, d, "customer")))
    ).drop("message")


def check_outliers(spark, d):
    return Q.outlier_alerts(iqr_outliers(table(spark, d, "events"), ["value", "user_id", "event_id"])).drop("message")


def check_mixed_types(spark, d):
    return Q.mixed_type_alerts(column_stats(view(spark, d, "lineitem", LOOSE_LINEITEM), text=True)).drop("message")


def quality_alerts(spark, d):
    facts = Q.table_facts(view(spark, d, "lineitem", LOOSE_LINEITEM))
    return Q.quality_alerts(facts).drop("message")


def quality_score(spark, d):
    return Q.quality_score(Q.table_facts(view(spark, d, "lineitem", LOOSE_LINEITEM)))


def quality_by_column(spark, d):
    return Q.quality_by_column(Q.table_facts(view(spark, d, "lineitem", LOOSE_LINEITEM)))


def quality_report(spark, d):
    return Q.quality_report(Q.table_facts(view(spark, d, "lineitem", LOOSE_LINEITEM)))


def scorecard(spark, d):
    return Q.scorecard(Q.table_facts(view(spark, d, "lineitem", LOOSE_LINEITEM), variants=True))


def _rules(spark, d):
    return Q.quality_rules(Q.table_facts(view(spark, d, "lineitem", LOOSE_LINEITEM), variants=True))


def quality_rules(spark, d):
    return _rules(spark, d).drop("detail")


def rule_status_counts(spark, d):
    return Q.rule_status_counts(_rules(spark, d))


def open_rules(spark, d):
    return Q.rules_with_status(_rules(spark, d), "WARN", "FAIL").select("rule", "column_name", "status")


def _issues(spark, d):
    loose = view(spark, d, "lineitem", LOOSE_LINEITEM)
    return Q.diagnose_issues(pin(column_stats(loose, text=True)), pin(duplicate_counts(loose)))


def diagnose_issues(spark, d):
    return _issues(spark, d).select("issue", "column_name", "severity", "fix")


def health_score(spark, d):
    return Q.health_score(_issues(spark, d))


def column_health(spark, d):
    return Q.column_health(view(spark, d, "lineitem", GAPPY_LINEITEM)).drop("data_type")


def readiness(spark, d):
    gappy = view(spark, d, "lineitem", GAPPY_LINEITEM)
    return Q.readiness(column_stats(gappy), duplicate_counts(gappy))


def suggest_transforms(spark, d):
    squared = table(spark, d, "events").selectExpr(
        "event_type", "ts", "user_id", "value * value * value AS cubed", "CASE WHEN event_type <> 'error' THEN value END AS value"
    )
    return Q.suggest_transformations(squared, column_stats(squared), duplicate_counts(squared))


QUERIES = {
    "check_nulls": check_nulls,
    "check_duplicates": check_duplicates,
    "check_negative": check_negative,
    "check_outliers": check_outliers,
    "check_mixed_types": check_mixed_types,
    "quality_alerts": quality_alerts,
    "quality_score": quality_score,
    "quality_by_column": quality_by_column,
    "quality_report": quality_report,
    "scorecard": scorecard,
    "quality_rules": quality_rules,
    "rule_status_counts": rule_status_counts,
    "open_rules": open_rules,
    "diagnose_issues": diagnose_issues,
    "health_score": health_score,
    "column_health": column_health,
    "readiness": readiness,
    "suggest_transforms": suggest_transforms,
}


def _null_sql(source: str, c: str) -> str:
    return (f"SELECT CASE WHEN p > 50 THEN 'critical' WHEN p > 20 THEN 'warning' ELSE 'info' END AS severity, '{c}' AS column_name, "
            f"'null_check' AS rule, round(p, 2) AS value FROM (SELECT (count(*) - count({c})) * 100.0 / count(*) AS p FROM {source}) WHERE p > 0")


def _dup_sql(source: str) -> str:
    return (f"SELECT CASE WHEN n * 100.0 / t > 10 THEN 'critical' ELSE 'warning' END AS severity, '__dataset__' AS column_name, "
            f"'duplicate_check' AS rule, CAST(n AS DOUBLE) AS value FROM (SELECT (SELECT count(*) FROM {source}) AS t, "
            f"(SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS n) WHERE n > 0")


def _negative_sql(source: str, c: str) -> str:
    return (f"SELECT 'warning' AS severity, '{c}' AS column_name, 'negative_check' AS rule, CAST(n AS DOUBLE) AS value "
            f"FROM (SELECT count(*) FILTER (WHERE {c} < 0) AS n FROM {source}) WHERE n > 0")


def _fences(source: str, c: str) -> str:
    """One row: n, outliers, fences of a column; none when it is short or flat."""
    return (f"(SELECT count({c}) AS n, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS o, any_value(lo) AS lo, any_value(hi) AS hi, "
            f"min({c}) AS low, max({c}) AS high FROM {source}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, q1, q3, k FROM "
            f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, count({c}) AS k FROM {source})) WHERE k >= 10 AND q1 <> q3)")


def _outlier_sql(source: str, c: str) -> str:
    return (f"SELECT CASE WHEN o * 100.0 / n > 5 THEN 'warning' ELSE 'info' END AS severity, '{c}' AS column_name, 'outlier_check' AS rule, "
            f"CAST(o AS DOUBLE) AS value FROM {_fences(source, c)} WHERE o > 0")


def _mixed_sql(source: str, c: str) -> str:
    return (f"SELECT 'warning' AS severity, '{c}' AS column_name, 'dtype_mismatch' AS rule, round(p, 1) AS value FROM "
            f"(SELECT count(try_cast({c} AS DOUBLE)) * 100.0 / count({c}) AS p FROM {source}) WHERE p > 30 AND p < 100")


_NUMBERS = ["net_quantity", "tax", "one"]
_TEXTS = ["discount_code", "flag", "status"]
_ALERTS = " UNION ALL ".join(
    [_null_sql(_LOOSE, c) for c in _LOOSE_COLUMNS] + [_dup_sql(_LOOSE)] + [_negative_sql(_LOOSE, c) for c in _NUMBERS]
    + [_outlier_sql(_LOOSE, c) for c in _NUMBERS] + [_mixed_sql(_LOOSE, c) for c in _TEXTS]
)
_POINTS = "15 * count(*) FILTER (WHERE severity = 'critical') + 5 * count(*) FILTER (WHERE severity = 'warning') + count(*) FILTER (WHERE severity = 'info')"
_MISSING = " + ".join(f"(count(*) - count({c}))" for c in _LOOSE_COLUMNS)
_DUP_COUNT = f"((SELECT count(*) FROM {_LOOSE}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_LOOSE})))"
_VARIANTS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS a, count(DISTINCT lower(trim({c}))) AS b FROM {_LOOSE}" for c in _TEXTS
)
_RULES = " UNION ALL ".join(
    [f"SELECT 'null' AS rule, '{c}' AS column_name, CASE WHEN p > 20 THEN 'FAIL' WHEN p > 5 THEN 'WARN' ELSE 'PASS' END AS status, "
     f"CASE WHEN p > 20 THEN 'High' WHEN p > 0 THEN 'Medium' ELSE 'Low' END AS severity "
     f"FROM (SELECT (count(*) - count({c})) * 100.0 / count(*) AS p FROM {_LOOSE})" for c in _LOOSE_COLUMNS]
    + [f"SELECT 'duplicates', '__dataset__', CASE WHEN p > 5 THEN 'FAIL' WHEN p > 0 THEN 'WARN' ELSE 'PASS' END, "
       f"CASE WHEN p > 5 THEN 'High' ELSE 'Low' END FROM (SELECT {_DUP_COUNT} * 100.0 / (SELECT count(*) FROM {_LOOSE}) AS p)"]
    + [f"SELECT 'outliers', '{c}', CASE WHEN o > t * 0.02 THEN 'WARN' ELSE 'PASS' END, CASE WHEN o > t * 0.02 THEN 'Medium' ELSE 'Low' END "
       f"FROM {_fences(_LOOSE, c)}, (SELECT count(*) AS t FROM {_LOOSE}) WHERE o > 0" for c in _NUMBERS]
    + [f"SELECT 'consistency', column_name, 'WARN', 'Medium' FROM ({_VARIANTS}) WHERE b < a"]
)
_ISSUES = " UNION ALL ".join(
    [f"SELECT 'missing_values' AS issue, column_name, severity, 'fill:{'mode' if c in _TEXTS else 'median'}' AS fix FROM ({_null_sql(_LOOSE, c)})"
     for c in _LOOSE_COLUMNS]
    + [f"SELECT 'duplicate_rows', '__dataset__', 'warning', 'keep:distinct_rows' FROM (SELECT {_DUP_COUNT} AS n) WHERE n > 0"]
    + [f"SELECT 'mixed_types', column_name, severity, 'cast:number' FROM ({_mixed_sql(_LOOSE, c)})" for c in _TEXTS]
    + [f"SELECT 'zero_variance', '{c}', 'info', 'review:constant' FROM (SELECT stddev_samp({c}) AS s FROM {_LOOSE}) WHERE s = 0" for c in _NUMBERS]
    + [f"SELECT 'empty_column', '{c}', 'critical', 'drop:column' FROM (SELECT count({c}) AS n FROM {_LOOSE}) WHERE n = 0" for c in _LOOSE_COLUMNS]
)

SQL = {
    "check_nulls": " UNION ALL ".join(_null_sql(_GAPPY, c) for c in _GAPPY_COLUMNS),
    "check_duplicates": _dup_sql(f"({sql_view('lineitem', REPEATED_LINEITEM)})"),
    "check_negative": " UNION ALL ".join(
        [_negative_sql(_LOOSE, c) for c in _NUMBERS] + [_negative_sql("customer", c) for c in ("c_custkey", "c_nationkey", "c_acctbal")]
    ),
    "check_outliers": " UNION ALL ".join(_outlier_sql("events", c) for c in ("value", "user_id", "event_id")),
    "check_mixed_types": " UNION ALL ".join(_mixed_sql(_LOOSE, c) for c in _TEXTS),
    "quality_alerts": _ALERTS,
    "quality_score": f"""
WITH a AS ({_ALERTS})
SELECT round(greatest(0.0, least(100.0, CAST(100 - ({_POINTS}) AS DOUBLE))), 1) AS overall_score, CAST(35 AS BIGINT) AS total_checks,
       count(*) FILTER (WHERE severity IN ('critical', 'warning')) AS failed_checks, count(*) AS total_alerts,
       count(*) FILTER (WHERE severity = 'critical') AS critical_alerts, count(*) FILTER (WHERE severity = 'warning') AS warning_alerts,
       count(*) FILTER (WHERE severity = 'info') AS info_alerts,
       35 - count(*) FILTER (WHERE severity IN ('critical', 'warning')) AS passed_checks,
       (SELECT round(100 - ({_MISSING}) * 100.0 / (7 * count(*)), 2) FROM {_LOOSE}) AS completeness,
       (SELECT round(100 - {_DUP_COUNT} * 100.0 / count(*), 2) FROM {_LOOSE}) AS uniqueness
FROM a""",
    "quality_by_column": f"""
WITH a AS ({_ALERTS}), c AS (SELECT unnest({_LOOSE_COLUMNS}) AS column_name)
SELECT c.column_name, greatest(0.0, least(100.0, CAST(100 - ({_POINTS}) AS DOUBLE))) AS score
FROM c LEFT JOIN a ON a.column_name = c.column_name GROUP BY 1""",
    "scorecard": f"""
WITH f AS (SELECT count(*) AS n, {_MISSING} AS missing FROM {_LOOSE}), u AS (SELECT {_DUP_COUNT} AS dup),
 k AS (SELECT count(*) FILTER (WHERE b < a) AS odd FROM ({_VARIANTS})),
 o AS (SELECT count(*) FILTER (WHERE o > (SELECT n FROM f) * 0.05) AS wild FROM ({' UNION ALL '.join(f"SELECT o FROM {_fences(_LOOSE, c)}" for c in _NUMBERS)})),
 p AS (SELECT 100 - missing * 100.0 / (7 * n) AS completeness, 100 - dup * 100.0 / n AS uniqueness,
       greatest(0, 100 - odd * 10) AS consistency, greatest(0, 100 - wild * 5) AS validity, missing, dup, n, odd FROM f, u, k, o)
SELECT round(least(100, completeness * 0.35 + uniqueness * 0.25 + consistency * 0.2 + validity * 0.2), 1) AS overall,
       round(completeness, 1) AS completeness, round(uniqueness, 1) AS uniqueness, CAST(consistency AS DOUBLE) AS consistency,
       CAST(validity AS DOUBLE) AS validity, CAST(missing AS BIGINT) AS missing_cells, dup AS duplicate_rows,
       7 * n AS total_cells, odd AS consistency_issues FROM p""",
    "quality_rules": _RULES,
    "rule_status_counts": f"SELECT status, count(*) AS n FROM ({_RULES}) GROUP BY 1",
    "open_rules": f"SELECT rule, column_name, status FROM ({_RULES}) WHERE status IN ('WARN', 'FAIL')",
    "diagnose_issues": _ISSUES,
    "health_score": f"""
SELECT greatest(0.0, least(100.0, CAST(100 - (20 * c + 5 * w + i) AS DOUBLE))) AS health_score, c + w + i AS total_issues,
       c AS critical_issues, w AS warning_issues, i AS info_issues
FROM (SELECT count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'warning') AS w,
             count(*) FILTER (WHERE severity = 'info') AS i FROM ({_ISSUES}))""",
    "column_health": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(p, 1) AS missing_pct, round(u, 1) AS distinct_pct, "
        f"CASE WHEN p < 5 THEN 'Healthy' WHEN p < 20 THEN 'Warning' ELSE 'Critical' END AS health FROM "
        f"(SELECT (count(*) - count({c})) * 100.0 / count(*) AS p, count(DISTINCT {c}) * 100.0 / count(*) AS u FROM {_GAPPY})"
        for c in _GAPPY_COLUMNS
    ),
    "readiness": f"""
SELECT count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns,
       round(({' + '.join(f'(count(*) - count({c}))' for c in _GAPPY_COLUMNS)}) * 100.0 / (7 * count(*)), 2) AS missing_pct,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_GAPPY})) AS n_duplicates,
       CAST(5 AS BIGINT) AS n_numeric, CAST(1 AS BIGINT) AS n_text,
       concat_ws(',', {', '.join(f"CASE WHEN count({c}) < count(*) * 0.5 THEN '{c}' END" for c in _GAPPY_COLUMNS)}) AS mostly_missing,
       count(*) > 100000 AS is_large FROM {_GAPPY}""",
    "suggest_transforms": """
WITH t AS (SELECT event_type, ts, user_id, value * value * value AS cubed, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)
SELECT 'Handle missing values' AS transformation, 'value' AS column_name, 'high' AS priority FROM (SELECT count(*) - count(value) AS n FROM t) WHERE n > 0
UNION ALL SELECT 'Remove duplicates', '__dataset__', 'high' FROM (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS n FROM t) WHERE n > 0
UNION ALL SELECT 'Extract date parts', 'ts', 'medium'
UNION ALL SELECT 'Log-transform', 'user_id', 'medium' FROM (SELECT skewness(user_id) AS s FROM t) WHERE abs(s) > 2
UNION ALL SELECT 'Log-transform', 'cubed', 'medium' FROM (SELECT skewness(cubed) AS s FROM t) WHERE abs(s) > 2
UNION ALL SELECT 'Log-transform', 'value', 'medium' FROM (SELECT skewness(value) AS s FROM t) WHERE abs(s) > 2""",
}
