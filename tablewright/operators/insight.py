"""Key facts, drivers, weak segments and the reports written from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.names import money_prefix
from tablewright.functions.semantics import percent, quoted, ratio, short_number
from tablewright.operators.aggregate import share_of_total
from tablewright.operators.anomaly import quarter_growth, strong_correlations, variation
from tablewright.operators.roles import Roles, classify
from tablewright.plans.outliers import iqr_outliers
from tablewright.plans.stats import (
    column_stats,
    duplicate_counts,
    numeric_columns,
    pin,
    text_columns,
    top_values,
)


def key_facts(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """total, mean, count, min, max and spread (percent of the absolute mean) per measure with values."""
    return _key_facts(column_stats(df, list(measures)))


def _key_facts(stats: DataFrame) -> DataFrame:
    spread = ratio((F.col("maximum") - F.col("minimum")) * 100.0, F.abs("mean"))
    return stats.filter(F.col("n_valid") > 0).select(
        "column_name", "total", "mean", F.col("n_valid").alias("count"), "minimum", "maximum",
        spread.alias("spread_pct"),
    )


def _shares(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    """Shares of a total that is not 0; none of one that is."""
    shares = share_of_total(df, dimension, measure)
    return shares if df.agg(F.sum(quoted(measure).cast("double"))).first()[0] else shares.limit(0)


def top_drivers(df: DataFrame, dimension: str, measure: str, n: int = 3) -> DataFrame:
    """The n groups with the largest sums and their share of the total; empty if the total is 0."""
    shares = _shares(df, dimension, measure)
    return shares.orderBy(F.desc("total"), quoted(dimension)).limit(n)


def weak_segments(df: DataFrame, dimension: str, measure: str, n: int = 3, below_pct: float = 10.0) -> DataFrame:
    """Among the n groups with the smallest sums, those with a share under `below_pct`; empty if the total is 0."""
    bottom = _shares(df, dimension, measure).orderBy("total", quoted(dimension)).limit(n)
    return bottom.filter(F.col("share_pct") < below_pct)


def sparse_measures(df: DataFrame, measures: Sequence[str], above_pct: float = 5.0) -> DataFrame:
    """column_name, missing_pct of measures with more missing values than `above_pct`."""
    return _sparse(column_stats(df, list(measures), moments=False), above_pct)


def _sparse(stats: DataFrame, above_pct: float) -> DataFrame:
    pct = percent(F.col("n_missing"), F.col("n_rows"))
    return stats.select("column_name", pct.alias("missing_pct")).filter(F.col("missing_pct") > above_pct)


def worst_missing(df: DataFrame) -> DataFrame:
    """The column with most missing values (first in table order on ties), if any value is missing."""
    return _worst_missing(column_stats(df, moments=False))


def _worst_missing(stats: DataFrame) -> DataFrame:
    return stats.filter(F.col("n_missing") > 0).orderBy(F.desc("n_missing"), "position").limit(1).select(
        "column_name", "n_missing", percent(F.col("n_missing"), F.col("n_rows")).alias("missing_pct")
    )


# ---- reports ---------------------------------------------------------------------------------

class _Facts:
    """Facts in order: section, position in it, subject, name of the fact, value, and all of it as a line of text."""

    def __init__(self, df: DataFrame):
        self.spark, self.rows = df.sparkSession, []

    def add(self, section: str, subject: str, fact: str, value: float) -> None:
        position = sum(r[0] == section for r in self.rows)
        shown = f"{value:,.2f}".rstrip("0").rstrip(".")
        self.rows.append((section, position, subject, fact, float(value), f"{fact} of {subject}: {shown}"))

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(
            self.rows, "section string, position int, subject string, fact string, value double, text string")


def explain_report(df: DataFrame, roles: Roles | None = None, tie_break: Sequence[str] = ()) -> DataFrame:
    """Facts on shape, measures, drivers, weak segments, correlations and remedies; the wording is the caller's.

    Built from frames with a row per column, or with the few rows of a top-k; `tie_break` completes
    the order of rows that share a time.
    """
    roles = roles or classify(df)
    m, d, t, out = roles.measures, roles.dimensions, roles.datetimes, _Facts(df)
    stats = pin(column_stats(df))  # one scan for all facts about single columns
    of_measures = stats.filter(F.col("column_name").isin(m)).orderBy("position")

    out.add("overview", "table", "rows", roles.n_rows)
    for kind, names in (("date", t), ("measure", m), ("dimension", d), ("identifier", roles.identifiers)):
        for c in names:
            out.add("overview", c, f"{kind} column", df.columns.index(c))
    for r in _key_facts(of_measures).collect():
        for fact in ("total", "mean", "count", "minimum", "maximum", "spread_pct"):
            if r[fact] is not None:
                out.add("key_insights", r["column_name"], fact, r[fact])
    if t and m:
        for r in quarter_growth(df, m, [t[0], *tie_break]).collect():
            out.add("key_insights", r["column_name"], "growth_pct", r["growth_pct"])
    for r in iqr_outliers(df, m).collect() if m else []:
        if r["n_outliers"]:
            out.add("key_insights", r["column_name"], "outliers", r["n_outliers"])
    if m and d:
        for r in top_drivers(df, d[0], m[0]).collect():
            out.add("performance_drivers", f"{d[0]}={r[d[0]]}", f"{m[0]} share_pct", r["share_pct"])
        for dimension, measure in zip(d[1:], m[1:]):
            for r in top_drivers(df, dimension, measure, 1).collect():
                out.add("performance_drivers", f"{dimension}={r[dimension]}", f"{measure} share_pct", r["share_pct"])
        for r in weak_segments(df, d[0], m[0]).collect():
            out.add("weak_segments", f"{d[0]}={r[d[0]]}", f"{m[0]} share_pct", r["share_pct"])
    for r in _sparse(of_measures, 5.0).collect():
        out.add("weak_segments", r["column_name"], "missing_pct", r["missing_pct"])
    for r in strong_correlations(df, m, 0.5).collect() if len(m) >= 2 else []:
        out.add("correlations", f"{r['column_a']}, {r['column_b']}", "r", r["r"])
    _remedies(df, stats, out, "recommendations")
    return out.frame()


def _remedies(df: DataFrame, stats: DataFrame, out: _Facts, section: str) -> None:
    for r in _worst_missing(stats).collect():
        out.add(section, r["column_name"], "missing_pct to fill", r["missing_pct"])
    dup = duplicate_counts(df).first()
    if dup["n_duplicates"]:
        out.add(section, "table", "repeated rows to remove", dup["n_duplicates"])


def rule_insights(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """Facts that pass fixed rules: missing cells, variation, dominance, correlation, outliers; and the shape."""
    roles = roles or classify(df)
    m, out = roles.measures, _Facts(df)
    out.add("shape", "table", "rows", roles.n_rows)
    out.add("shape", "table", "columns", len(df.columns))
    stats = column_stats(df, moments=False).agg(F.sum("n_missing").alias("n"), F.sum("n_rows").alias("cells")).first()
    if stats["n"]:
        out.add("missing", "table", "missing_pct", stats["n"] / stats["cells"] * 100)
    for r in variation(df, m, absolute_mean=True).filter("high").collect() if m else []:
        out.add("variation", r["column_name"], "cv_pct", r["cv_pct"])
    for r in dominance_in_top(df, roles.dimensions).collect() if roles.dimensions else []:
        out.add("dominance", f"{r['column_name']}={r['value']}", "share_pct", r["share_pct"])
    for r in strong_correlations(df, m).collect() if len(m) >= 2 else []:
        out.add("correlation", f"{r['column_a']}, {r['column_b']}", "r", r["r"])
    for r in zscore_counts(df, m).filter(F.col("n_outliers") > 0).collect() if m else []:
        out.add("outliers", r["column_name"], "values beyond 3 deviations", r["n_outliers"])
    return out.frame()


def dominance_in_top(df: DataFrame, columns: Sequence[str], k: int = 10, above_pct: float = 40.0) -> DataFrame:
    """column_name, value, share_pct where one value holds over `above_pct` of the k most frequent."""
    top = top_values(df, columns, k)
    by = top.groupBy("column_name").agg(
        F.sum("n").alias("in_top"), F.max_by("value", -F.col("place")).alias("value"), F.max("n").alias("n")
    )
    share = percent(F.col("n"), F.col("in_top"))
    return by.filter(share > above_pct).select("column_name", "value", share.alias("share_pct"))


def zscore_counts(df: DataFrame, measures: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """column_name, n_outliers: how many values lie beyond `threshold` deviations."""
    stats = [r for r in column_stats(df, list(measures)).collect() if r["std"]]
    if not stats:
        return df.sparkSession.createDataFrame([], "column_name string, n_outliers bigint")
    rows = [
        F.struct(
            F.lit(r["column_name"]).alias("column_name"),
            F.count_if(F.abs(quoted(r["column_name"]) - F.lit(r["mean"])) / F.lit(r["std"]) > threshold).alias("n_outliers"),
        )
        for r in stats
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def fallback_insights(df: DataFrame) -> DataFrame:
    """Facts on completeness, repeated rows, outliers, most frequent values and the strongest pair."""
    numbers, texts, out = numeric_columns(df), text_columns(df), _Facts(df)
    dup = duplicate_counts(df).first()
    n = dup["n_rows"]
    for fact, value in (("rows", n), ("number columns", len(numbers)), ("text columns", len(texts))):
        out.add("shape", "table", fact, value)
    for r in worst_missing(df).collect():
        out.add("missing", r["column_name"], "missing_pct", r["missing_pct"])
    if dup["n_duplicates"]:
        out.add("duplicates", "table", "repeated rows", dup["n_duplicates"])
    for r in iqr_outliers(df, numbers).collect() if numbers else []:
        if r["n_outliers"]:
            out.add("outliers", r["column_name"], "outliers", r["n_outliers"])
    for r in top_values(df, texts, 3).orderBy("column_name", "place").collect() if texts else []:
        out.add("top_values", f"{r['column_name']}={r['value']}", "share_pct", r["n"] / n * 100)
    strongest = strong_correlations(df, numbers).orderBy(F.desc(F.abs("r")), "column_a", "column_b") if len(numbers) >= 2 else None
    for r in strongest.limit(1).collect() if strongest is not None else []:
        out.add("correlation", f"{r['column_a']}, {r['column_b']}", "r", r["r"])
    return out.frame()


def formatted_totals(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """column_name, total as short text with a currency sign where the name speaks of money."""
    signs = F.create_map(*[x for m in measures for x in (F.lit(m), F.lit(money_prefix(m)))])
    return column_stats(df, list(measures)).select(
        "column_name", short_number(F.col("total"), signs[F.col("column_name")]).alias("total")
    )
