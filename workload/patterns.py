"""Anomalies, patterns, drift and the facts of narratives."""

from __future__ import annotations

from tablewright.operators import anomaly as N
from tablewright.operators import insight as I
from workload.common import GAPPY_LINEITEM, rounded, sql_view, table, view
from workload.quality import _fences

_GAPPY = f"({sql_view('lineitem', GAPPY_LINEITEM)})"
_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def iqr_anomalies(spark, d):
    return N.iqr_anomalies(table(spark, d, "events"), ["event_id", "user_id", "value"])


def anomaly_alerts(spark, d):
    return N.anomaly_alerts(table(spark, d, "events"), ["value", "user_id"])


def zscore_outliers(spark, d):
    return rounded(N.zscore_outliers(table(spark, d, "events"), ["value", "user_id"], ["event_id"]), 4, "z")


def zscore_counts(spark, d):
    return I.zscore_counts(table(spark, d, "events"), ["value", "user_id"])


_LINKED = ["p_partkey", "p_size", "p_retailprice", "p_retailprice - 10 * p_size AS net", "0 - p_partkey AS back"]
_LINKED_COLUMNS = ["p_partkey", "p_size", "p_retailprice", "net", "back"]


def strong_correlations(spark, d):
    return rounded(N.strong_correlations(view(spark, d, "part", _LINKED), _LINKED_COLUMNS, 0.5), 4, "r")


_MOSTLY = [
    "CASE WHEN l_quantity > 20 THEN 'big' ELSE l_returnflag END AS size_flag", "l_linestatus", "l_returnflag",
]


def dominant_category(spark, d):
    return rounded(N.dominant_categories(view(spark, d, "lineitem", _MOSTLY), ["size_flag", "l_linestatus", "l_returnflag"]), 4, "share_pct")


def dominance_in_top(spark, d):
    return rounded(I.dominance_in_top(view(spark, d, "lineitem", _MOSTLY), ["size_flag", "l_linestatus", "l_returnflag"]), 4, "share_pct")


def skewness(spark, d):
    odd = table(spark, d, "events").selectExpr("value", "user_id", "event_id", "value * value AS squared")
    return rounded(N.distribution_skew(odd, ["value", "user_id", "event_id", "squared"]), 4, "skewness")


def cv_stability(spark, d):
    odd = table(spark, d, "events").selectExpr("value", "user_id", "value * value AS squared", "0 - value AS negated")
    return rounded(N.variation(odd, ["value", "user_id", "squared", "negated"]), 4, "cv_pct", "std")


_GAP = [
    "CASE WHEN l_quantity > 40 THEN 'large' WHEN l_quantity > 10 THEN 'middle' ELSE 'small' END AS bucket", "l_returnflag",
    "l_quantity", "l_tax + 0.01 AS l_tax", "l_quantity * l_extendedprice AS volume",
]


def performance_gap(spark, d):
    out = N.performance_gaps(view(spark, d, "lineitem", _GAP), ["bucket", "l_returnflag"], ["l_quantity", "l_tax", "volume"])
    return rounded(out, 4, "top_mean", "bottom_mean", "gap")


_EVENTS = ["event_id", "ts", "value", "user_id + 20 * (event_id / 4000) AS load",
           "CASE WHEN value > 20 AND event_id > 7000 THEN 'late' ELSE event_type END AS kind", "event_type"]
_EVENTS_SQL = [e.replace("event_id / 4000", "CAST(event_id AS DOUBLE) / 4000") for e in _EVENTS]


def half_split(spark, d):
    return N.half_split(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"])


def numeric_drift(spark, d):
    out = N.numeric_drift(view(spark, d, "events", _EVENTS), ["value", "load"], ["ts", "event_id"])
    return rounded(out, 4, "mean_first", "mean_second", "change_pct")


def categorical_drift(spark, d):
    out = N.categorical_drift(view(spark, d, "events", _EVENTS), ["event_type", "kind"], ["ts", "event_id"])
    return rounded(out, 4, "max_shift")


def quarter_growth(spark, d):
    gappy = view(spark, d, "lineitem", [*GAPPY_LINEITEM, "l_linenumber", "l_partkey", "l_suppkey"])
    out = N.quarter_growth(gappy, ["l_extendedprice", "l_tax"],
                           ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return rounded(out, 4, "first_mean", "last_mean", "growth_pct")


def key_facts(spark, d):
    out = I.key_facts(view(spark, d, "lineitem", GAPPY_LINEITEM), _MEASURES)
    return rounded(out, 4, "total", "mean", "minimum", "maximum", "spread_pct")


def top_drivers(spark, d):
    return rounded(I.top_drivers(table(spark, d, "part"), "p_brand", "p_retailprice"), 4, "total", "share_pct")


def weak_segments(spark, d):
    return rounded(I.weak_segments(table(spark, d, "part"), "p_brand", "p_retailprice"), 4, "total", "share_pct")


def sparse_measures(spark, d):
    return rounded(I.sparse_measures(view(spark, d, "lineitem", GAPPY_LINEITEM), _MEASURES), 4, "missing_pct")


def worst_missing(spark, d):
    return rounded(I.worst_missing(view(spark, d, "lineitem", GAPPY_LINEITEM)), 4, "missing_pct")


def explain_report(spark, d):
    return I.explain_report(table(spark, d, "orders"), tie_break=["o_orderkey"])


def rule_insights(spark, d):
    return I.rule_insights(table(spark, d, "events"))


def fallback_insights(spark, d):
    return I.fallback_insights(view(spark, d, "lineitem", GAPPY_LINEITEM))


QUERIES = {
    "iqr_anomalies": iqr_anomalies,
    "anomaly_alerts": anomaly_alerts,
    "zscore_outliers": zscore_outliers,
    "zscore_counts": zscore_counts,
    "strong_correlations": strong_correlations,
    "dominant_category": dominant_category,
    "dominance_in_top": dominance_in_top,
    "skewness": skewness,
    "cv_stability": cv_stability,
    "performance_gap": performance_gap,
    "half_split": half_split,
    "numeric_drift": numeric_drift,
    "categorical_drift": categorical_drift,
    "quarter_growth": quarter_growth,
    "key_facts": key_facts,
    "top_drivers": top_drivers,
    "weak_segments": weak_segments,
    "sparse_measures": sparse_measures,
    "worst_missing": worst_missing,
    "explain_report": explain_report,
    "rule_insights": rule_insights,
    "fallback_insights": fallback_insights,
}

_HALVED = ("(SELECT *, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= (SELECT count(*) // 2 FROM events) THEN 1 ELSE 2 END AS half "
           f"FROM ({sql_view('events', _EVENTS_SQL)}))")
_LINKED_T = f"({sql_view('part', _LINKED)})"
_MOSTLY_T = f"({sql_view('lineitem', _MOSTLY)})"
_GAP_T = f"({sql_view('lineitem', _GAP)})"
_ODD_T = "(SELECT value, user_id, event_id, value * value AS squared, 0 - value AS negated FROM events)"


def _quarter_sql(m: str) -> str:
    keys = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"
    return f"""
SELECT '{m}' AS column_name, round(a, 4) AS first_mean, round(b, 4) AS last_mean, f AS first_at, l AS last_at,
       round((b - a) / abs(a) * 100, 4) AS growth_pct
FROM (SELECT avg(v) FILTER (WHERE rn <= k) AS a, avg(v) FILTER (WHERE rn > n - k) AS b, min(l_shipdate) AS f, max(l_shipdate) AS l
      FROM (SELECT {m} AS v, l_shipdate, row_number() OVER (ORDER BY {keys}) AS rn, count(*) OVER () AS n,
                   greatest(1, count(*) OVER () // 4) AS k
            FROM ({sql_view('lineitem', [*GAPPY_LINEITEM, 'l_linenumber', 'l_partkey', 'l_suppkey'])})
            WHERE {m} IS NOT NULL AND l_shipdate IS NOT NULL))"""


SQL = {
    "iqr_anomalies": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, o AS outlier_count, round(o * 100.0 / n, 2) AS outlier_pct, round(lo, 2) AS lower_bound, "
        f"round(hi, 2) AS upper_bound FROM {_fences('events', c)} WHERE o > 0" for c in ("event_id", "user_id", "value")
    ),
    "anomaly_alerts": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, o AS anomalies, round(o * 100.0 / n, 1) AS percentage, "
        f"CASE WHEN o * 100.0 / n > 5 THEN 'Critical' WHEN o * 100.0 / n > 1 THEN 'Warning' ELSE 'Info' END AS severity, "
        f"round(lo, 2) AS lower_bound, round(hi, 2) AS upper_bound, CAST(low AS DOUBLE) AS minimum, CAST(high AS DOUBLE) AS maximum "
        f"FROM {_fences('events', c)} WHERE o > 0" for c in ("value", "user_id")
    ),
    "zscore_outliers": " UNION ALL ".join(
        f"SELECT event_id, '{c}' AS column_name, CAST({c} AS DOUBLE) AS value, round(z, 4) AS z FROM (SELECT event_id, {c}, "
        f"({c} - (SELECT avg({c}) FROM events)) / (SELECT stddev_samp({c}) FROM events) AS z FROM events) WHERE abs(z) > 3"
        for c in ("value", "user_id")
    ),
    "zscore_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE abs({c} - (SELECT avg({c}) FROM events)) / "
        f"(SELECT stddev_samp({c}) FROM events) > 3) AS n_outliers FROM events" for c in ("value", "user_id")
    ),
    "strong_correlations": "SELECT column_a, column_b, round(r, 4) AS r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, "
                           "CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM {_LINKED_T}"
        for i, a in enumerate(_LINKED_COLUMNS) for b in _LINKED_COLUMNS[i + 1:]
    ) + ") WHERE abs(r) > 0.5",
    "dominant_category": "SELECT column_name, value, round(p, 4) AS share_pct FROM (" + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, count(*) * 100.0 / (SELECT count(*) FROM lineitem) AS p FROM {_MOSTLY_T} "
        f"GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)" for c in ("size_flag", "l_linestatus", "l_returnflag")
    ) + ") WHERE p > 50",
    "dominance_in_top": "SELECT column_name, value, round(p, 4) AS share_pct FROM (" + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS column_name, value, n * 100.0 / sum(n) OVER () AS p FROM (SELECT {c} AS value, count(*) AS n "
        f"FROM {_MOSTLY_T} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) ORDER BY p DESC, value LIMIT 1)"
        for c in ("size_flag", "l_linestatus", "l_returnflag")
    ) + ") WHERE p > 40",
    "skewness": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(s, 4) AS skewness, CASE WHEN abs(s) < 1 THEN 'Normal' WHEN abs(s) < 2 THEN 'Skewed' "
        f"ELSE 'Highly Skewed' END AS status, abs(s) > 2 AS is_pattern FROM (SELECT skewness({c}) AS s FROM {_ODD_T})"
        for c in ("value", "user_id", "event_id", "squared")
    ),
    "cv_stability": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(s / m * 100, 4) AS cv_pct, round(s, 4) AS std, CASE WHEN s / m * 100 < 50 THEN 'Stable' "
        f"WHEN s / m * 100 < 100 THEN 'Variable' ELSE 'Volatile' END AS stability, s / abs(m) > 1 AS high "
        f"FROM (SELECT stddev_samp({c}) AS s, avg({c}) AS m FROM {_ODD_T})" for c in ("value", "user_id", "squared", "negated")
    ),
    "performance_gap": "SELECT category, number, top_key, round(a, 4) AS top_mean, bottom_key, round(b, 4) AS bottom_mean, round(a / b, 4) AS gap FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS category, '{m}' AS number, count(*) AS n, first(k ORDER BY v DESC, k) AS top_key, max(v) AS a, "
            f"first(k ORDER BY v, k) AS bottom_key, min(v) AS b FROM (SELECT {c} AS k, avg({m}) AS v FROM {_GAP_T} GROUP BY 1)"
            for c in ("bucket", "l_returnflag") for m in ("l_quantity", "l_tax", "volume")
        ) + ") WHERE n >= 2 AND b > 0 AND a / b > 3",
    "half_split": f"SELECT event_id, ts, half FROM {_HALVED}",
    "numeric_drift": " UNION ALL ".join(
        f"SELECT '{m}' AS column_name, round(a, 4) AS mean_first, round(b, 4) AS mean_second, round((b - a) / abs(a) * 100, 4) AS change_pct, "
        f"CASE WHEN abs((b - a) / a * 100) > 20 THEN 'Significant' WHEN abs((b - a) / a * 100) > 10 THEN 'Moderate' ELSE 'Stable' END AS drift "
        f"FROM (SELECT avg({m}) FILTER (WHERE half = 1) AS a, avg({m}) FILTER (WHERE half = 2) AS b FROM {_HALVED})"
        for m in ("value", "load")
    ),
    "categorical_drift": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS categories, round(max(abs(q - p)), 4) AS max_shift, "
        f"CASE WHEN max(abs(q - p)) > 10 THEN 'Drifted' ELSE 'Stable' END AS status FROM (SELECT {c}, "
        f"count(*) FILTER (WHERE half = 1) * 100.0 / sum(count(*) FILTER (WHERE half = 1)) OVER () AS p, "
        f"count(*) FILTER (WHERE half = 2) * 100.0 / sum(count(*) FILTER (WHERE half = 2)) OVER () AS q FROM {_HALVED} GROUP BY 1)"
        for c in ("event_type", "kind")
    ),
    "quarter_growth": " UNION ALL ".join(_quarter_sql(m) for m in ("l_extendedprice", "l_tax")),
    "key_facts": " UNION ALL ".join(
        f"SELECT '{m}' AS column_name, round(sum({m}), 4) AS total, round(avg({m}), 4) AS mean, count({m}) AS count, round(min({m}), 4) AS minimum, "
        f"round(max({m}), 4) AS maximum, round((max({m}) - min({m})) / abs(avg({m})) * 100, 4) AS spread_pct FROM {_GAPPY}" for m in _MEASURES
    ),
    "top_drivers": "SELECT p_brand, round(sum(p_retailprice), 4) AS total, round(sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part) * 100, 4) "
                   "AS share_pct FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "weak_segments": "SELECT * FROM (SELECT p_brand, round(sum(p_retailprice), 4) AS total, round(sum(p_retailprice) / "
                     "(SELECT sum(p_retailprice) FROM part) * 100, 4) AS share_pct FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 3) WHERE share_pct < 10",
    "sparse_measures": "SELECT column_name, round(p, 4) AS missing_pct FROM (" + " UNION ALL ".join(
        f"SELECT '{m}' AS column_name, (count(*) - count({m})) * 100.0 / count(*) AS p FROM {_GAPPY}" for m in _MEASURES
    ) + ") WHERE p > 5",
    "worst_missing": "SELECT column_name, n_missing, round(p, 4) AS missing_pct FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, (count(*) - count({c})) * 100.0 / count(*) AS p, {i} AS i FROM {_GAPPY}"
        for i, c in enumerate(["l_discount", "l_tax", "l_returnflag", "l_shipdate"])
    ) + ") WHERE n_missing > 0 ORDER BY n_missing DESC, i LIMIT 1",
}
