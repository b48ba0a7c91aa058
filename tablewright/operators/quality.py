"""Quality checks, scores, rules and diagnoses.

The checks read small frames of facts (one row per column); `table_facts` computes those frames once
so that every check of a report shares the same scans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.semantics import band, band_below, kind_of, percent
from tablewright.plans.outliers import iqr_outliers
from tablewright.plans.stats import (
    column_stats,
    distinct_counts,
    duplicate_counts,
    numeric_columns,
    pin,
    skewness,
    text_columns,
    text_variants,
)

DATASET = "__dataset__"  # Fixed value: stands for the whole table in a column field.

# Points taken off per finding.
QUALITY_PENALTY = {"critical": 15.0, "warning": 5.0, "info": 1.0}
HEALTH_PENALTY = {"critical": 20.0, "warning": 5.0, "info": 1.0}


@dataclass
class Facts:
    """Per-column facts of a table, each a frame of one row per column (duplicates: one row)."""

    columns: list[str]
    stats: DataFrame
    duplicates: DataFrame
    outliers: DataFrame
    variants: DataFrame | None


def table_facts(df: DataFrame, *, outliers: bool = True, variants: bool = False) -> Facts:
    numbers, texts = numeric_columns(df), text_columns(df)
    return Facts(
        columns=df.columns,
        stats=pin(column_stats(df, text=True)),
        duplicates=pin(duplicate_counts(df)),
        outliers=pin(iqr_outliers(df, numbers if outliers else [])),
        variants=pin(text_variants(df, texts)) if variants and texts else None,
    )


# ---- alerts ----------------------------------------------------------------------------------

def _alert(severity: Column, column: Column, rule: str, message: Column, value: Column) -> list[Column]:
    return [
        severity.alias("severity"), column.alias("column_name"), F.lit(rule).alias("rule"),
        message.alias("message"), value.cast("double").alias("value"),
    ]


def null_alerts(stats: DataFrame) -> DataFrame:
    """A finding per column with missing values: above 50 % critical, above 20 % warning."""
    pct = percent(F.col("n_missing"), F.col("n_rows"))
    return stats.filter(F.col("n_missing") > 0).select(*_alert(
        band(pct, (50, "critical"), (20, "warning"), otherwise="info"), F.col("column_name"), "null_check",
        F.format_string("%s: missing in %.1f of 100 rows", "column_name", pct), F.round(pct, 2),
    ))


def duplicate_alerts(duplicates: DataFrame) -> DataFrame:
    """A finding if rows repeat: above 10 % critical."""
    n, pct = F.col("n_duplicates"), percent(F.col("n_duplicates"), F.col("n_rows"))
    return duplicates.filter(n > 0).select(*_alert(
        band(pct, (10, "critical"), otherwise="warning"), F.lit(DATASET), "duplicate_check",
        F.format_string("table: %d rows repeat others, %.1f of 100", n, pct), n,
    ))


def negative_alerts(stats: DataFrame) -> DataFrame:
    """A warning per numeric column with values below zero."""
    n, pct = F.col("n_negative"), percent(F.col("n_negative"), F.col("n_rows"))
    return stats.filter(n > 0).select(*_alert(
        F.lit("warning"), F.col("column_name"), "negative_check",
        F.format_string("%s: %d values under zero, %.1f of 100 rows", "column_name", n, pct), n,
    ))


def outlier_alerts(outliers: DataFrame) -> DataFrame:
    """A finding per column with values outside the fences: above 5 % warning."""
    n, pct = F.col("n_outliers"), percent(F.col("n_outliers"), F.col("n_valid"))
    return outliers.filter(n > 0).select(*_alert(
        band(pct, (5, "warning"), otherwise="info"), F.col("column_name"), "outlier_check",
        F.format_string("%s: %d values outside the fences, %.1f of 100", "column_name", n, pct), n,
    ))


def mixed_type_alerts(stats: DataFrame) -> DataFrame:
    """A warning per text column where between 30 % and 100 % of the values are numbers."""
    pct = percent(F.col("n_numeric_text"), F.col("n_valid"))
    return stats.filter((pct > 30) & (pct < 100)).select(*_alert(
        F.lit("warning"), F.col("column_name"), "dtype_mismatch",
        F.format_string("%s: text of which %.0f of 100 values read as numbers", "column_name", pct),
        F.round(pct, 1),
    ))


def quality_alerts(facts: Facts) -> DataFrame:
    """All findings of the five checks."""
    return (
        null_alerts(facts.stats)
        .unionByName(duplicate_alerts(facts.duplicates))
        .unionByName(negative_alerts(facts.stats))
        .unionByName(outlier_alerts(facts.outliers))
        .unionByName(mixed_type_alerts(facts.stats))
    )


def _score(penalty: dict[str, float]) -> Column:
    lost = F.lit(0.0)
    for severity, points in penalty.items():
        lost = lost + F.count_if(F.col("severity") == severity) * points
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - lost))


def quality_score(facts: Facts) -> DataFrame:
    """One row: score, checks passed and failed, findings by severity, completeness, uniqueness."""
    alerts = quality_alerts(facts).agg(
        F.round(_score(QUALITY_PENALTY), 1).alias("overall_score"),
        F.lit(len(facts.columns) * 5).cast("bigint").alias("total_checks"),
        F.count_if(F.col("severity").isin("critical", "warning")).alias("failed_checks"),
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("severity") == "critical").alias("critical_alerts"),
        F.count_if(F.col("severity") == "warning").alias("warning_alerts"),
        F.count_if(F.col("severity") == "info").alias("info_alerts"),
        F.lit(1).alias("one"),
    ).withColumn("passed_checks", F.col("total_checks") - F.col("failed_checks"))
    missing = facts.stats.agg(
        F.round((1 - F.avg(F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows")))) * 100, 2).alias("completeness"),
        F.lit(1).alias("one"),
    )
    unique = facts.duplicates.select(
        F.round(100 - percent(F.col("n_duplicates"), F.col("n_rows")), 2).alias("uniqueness"), F.lit(1).alias("one")
    )
    return alerts.join(missing, "one").join(unique, "one").drop("one")


def quality_by_column(facts: Facts) -> DataFrame:
    """column_name, score with the same penalties, for every column."""
    scores = quality_alerts(facts).groupBy("column_name").agg(_score(QUALITY_PENALTY).alias("score"))
    return facts.stats.select("column_name").join(scores, "column_name", "left").select(
        "column_name", F.coalesce("score", F.lit(100.0)).alias("score")
    )


def quality_report(facts: Facts) -> DataFrame:
    """The score row with all findings and column scores as arrays."""
    alerts = quality_alerts(facts).agg(
        F.collect_list(F.struct("severity", "column_name", "rule", "message", "value")).alias("alerts"),
        F.lit(1).alias("one"),
    )
    columns = quality_by_column(facts).agg(
        F.map_from_entries(F.collect_list(F.struct("column_name", "score"))).alias("column_scores"),
        F.lit(1).alias("one"),
    )
    score = quality_score(facts).withColumn("one", F.lit(1))
    return score.join(columns, "one").join(alerts, "one").drop("one")


# ---- scorecard and rules ---------------------------------------------------------------------

def _inconsistent(facts: Facts) -> DataFrame | None:
    if facts.variants is None:
        return None
    return facts.variants.filter(F.col("n_normalised") < F.col("n_distinct")).withColumn(
        "n_variants", F.col("n_distinct") - F.col("n_normalised")
    )


def scorecard(facts: Facts) -> DataFrame:
    """One row: completeness 35 %, uniqueness 25 %, consistency 20 %, validity 20 %, and the whole."""
    one = F.lit(1).alias("one")
    cells = facts.stats.agg(
        F.sum("n_missing").alias("missing_cells"), F.sum("n_rows").alias("total_cells"), one
    )
    rows = facts.duplicates.select("n_rows", F.col("n_duplicates").alias("duplicate_rows"), one)
    bad = facts.outliers.agg(F.collect_list("n_outliers").alias("outliers"), one)
    odd = _inconsistent(facts)
    texts = (
        odd.agg(F.count(F.lit(1)).alias("consistency_issues"), one)
        if odd is not None
        else facts.duplicates.select(F.lit(0).cast("bigint").alias("consistency_issues"), one)
    )
    facts_row = cells.join(rows, "one").join(bad, "one").join(texts, "one")
    completeness = 100 - percent(F.col("missing_cells"), F.col("total_cells"))
    uniqueness = 100 - percent(F.col("duplicate_rows"), F.col("n_rows"))
    consistency = F.greatest(F.lit(0.0), 100.0 - F.col("consistency_issues") * 10)
    wild = F.size(F.filter("outliers", lambda n: n > F.col("n_rows") * 0.05))
    validity = F.greatest(F.lit(0.0), 100.0 - wild * 5)
    overall = completeness * 0.35 + uniqueness * 0.25 + consistency * 0.2 + validity * 0.2
    return facts_row.select(
        F.round(F.least(overall, F.lit(100.0)), 1).alias("overall"),
        F.round(completeness, 1).alias("completeness"),
        F.round(uniqueness, 1).alias("uniqueness"),
        F.round(consistency, 1).alias("consistency"),
        F.round(validity, 1).alias("validity"),
        "missing_cells", "duplicate_rows", "total_cells", "consistency_issues",
    )


def quality_rules(facts: Facts) -> DataFrame:
    """rule, column_name, status, detail, severity of every rule that applies.

    Missing values (above 20 % FAIL, above 5 % WARN), repeated rows (above 5 % FAIL), outliers (above
    2 % of rows WARN) and text that differs only in case or outer space (WARN).
    """
    pct = percent(F.col("n_missing"), F.col("n_rows"))
    nulls = facts.stats.select(
        F.lit("null").alias("rule"), "column_name",
        band(pct, (20, "FAIL"), (5, "WARN"), otherwise="PASS").alias("status"),
        F.when(pct > 0, F.format_string("missing=%d share=%.1f", "n_missing", pct))
        .otherwise("missing=0").alias("detail"),
        F.when(pct > 20, "High").when(pct > 0, "Medium").otherwise("Low").alias("severity"),
    )
    n, dup_pct = F.col("n_duplicates"), percent(F.col("n_duplicates"), F.col("n_rows"))
    dups = facts.duplicates.select(
        F.lit("duplicates").alias("rule"), F.lit(DATASET).alias("column_name"),
        band(dup_pct, (5, "FAIL"), (0, "WARN"), otherwise="PASS").alias("status"),
        F.when(n > 0, F.format_string("repeated=%d share=%.1f", n, dup_pct))
        .otherwise("repeated=0").alias("detail"),
        F.when(dup_pct > 5, "High").otherwise("Low").alias("severity"),
    )
    rows = facts.stats.select("column_name", "n_rows")
    found = facts.outliers.filter(F.col("n_outliers") > 0).join(rows, "column_name")
    many = F.col("n_outliers") > F.col("n_rows") * 0.02
    outliers = found.select(
        F.lit("outliers").alias("rule"), "column_name",
        F.when(many, "WARN").otherwise("PASS").alias("status"),
        F.format_string("outside_fences=%d", "n_outliers").alias("detail"),
        F.when(many, "Medium").otherwise("Low").alias("severity"),
    )
    out = nulls.unionByName(dups).unionByName(outliers)
    odd = _inconsistent(facts)
    if odd is not None:
        out = out.unionByName(odd.select(
            F.lit("consistency").alias("rule"), "column_name", F.lit("WARN").alias("status"),
            F.format_string("variants_in_case_or_space=%d", "n_variants").alias("detail"),
            F.lit("Medium").alias("severity"),
        ))
    return out


def rule_status_counts(rules: DataFrame) -> DataFrame:
    """status, n over PASS, WARN and FAIL."""
    return rules.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def rules_with_status(rules: DataFrame, *statuses: str) -> DataFrame:
    """Rules in one of the given states."""
    return rules.filter(F.col("status").isin(*statuses)) if statuses else rules


# ---- diagnosis and health --------------------------------------------------------------------

def diagnose_issues(stats: DataFrame, duplicates: DataFrame) -> DataFrame:
    """issue, column_name, severity, detail, fix for missing, repeated, mixed, constant, empty data."""
    pct = percent(F.col("n_missing"), F.col("n_rows"))
    is_number = F.col("kind") == "numeric"
    missing = stats.filter(F.col("n_missing") > 0).select(
        F.lit("missing_values").alias("issue"), "column_name",
        band(pct, (50, "critical"), (20, "warning"), otherwise="info").alias("severity"),
        F.format_string("missing_share=%.1f", pct).alias("detail"),
        F.when(is_number, "fill:median").otherwise("fill:mode").alias("fix"),
    )
    n = F.col("n_duplicates")
    repeated = duplicates.filter(n > 0).select(
        F.lit("duplicate_rows").alias("issue"), F.lit(DATASET).alias("column_name"),
        F.lit("warning").alias("severity"),
        F.format_string("repeated=%d share=%.1f", n, percent(n, F.col("n_rows"))).alias("detail"),
        F.lit("keep:distinct_rows").alias("fix"),
    )
    numeric_pct = percent(F.col("n_numeric_text"), F.col("n_valid"))
    mixed = stats.filter((numeric_pct > 30) & (numeric_pct < 100)).select(
        F.lit("mixed_types").alias("issue"), "column_name", F.lit("warning").alias("severity"),
        F.format_string("number_share=%.0f", numeric_pct).alias("detail"),
        F.lit("cast:number").alias("fix"),
    )
    constant = stats.filter(is_number & (F.col("std") == 0)).select(
        F.lit("zero_variance").alias("issue"), "column_name", F.lit("info").alias("severity"),
        F.concat(F.lit("only_value="), F.col("minimum").cast("string")).alias("detail"),
        F.lit("review:constant").alias("fix"),
    )
    empty = stats.filter((F.col("n_valid") == 0) & (F.col("n_rows") > 0)).select(
        F.lit("empty_column").alias("issue"), "column_name", F.lit("critical").alias("severity"),
        F.lit("values=0").alias("detail"), F.lit("drop:column").alias("fix"),
    )
    out = missing
    for part in (repeated, mixed, constant, empty):
        out = out.unionByName(part)
    return out


def health_score(issues: DataFrame) -> DataFrame:
    """One row: score from the issues and their counts by severity."""
    return issues.agg(
        _score(HEALTH_PENALTY).alias("health_score"),
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(F.col("severity") == "critical").alias("critical_issues"),
        F.count_if(F.col("severity") == "warning").alias("warning_issues"),
        F.count_if(F.col("severity") == "info").alias("info_issues"),
    )


def column_health(df: DataFrame) -> DataFrame:
    """column_name, data_type, missing_pct, distinct_pct, health (below 5 % missing Healthy, 20 % Warning)."""
    plain = [f.name for f in df.schema.fields if kind_of(f.dataType) != "nested"]
    stats = column_stats(df, moments=False)
    both = stats.join(F.broadcast(distinct_counts(df, plain)), "column_name", "left")
    missing = percent(F.col("n_missing"), F.col("n_rows"))
    return both.select(
        "column_name", "data_type",
        F.round(missing, 1).alias("missing_pct"),
        F.round(percent(F.coalesce("n_distinct", F.lit(0)), F.col("n_rows")), 1).alias("distinct_pct"),
        band_below(missing, (5, "Healthy"), (20, "Warning"), otherwise="Critical").alias("health"),
    )


def readiness(stats: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: missing share, repeated rows, column kinds, mostly-missing columns, large-table flag."""
    share = F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows"))
    per_table = stats.agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.round(F.avg(share) * 100, 2).alias("missing_pct"),
        F.count_if(F.col("kind") == "numeric").alias("n_numeric"),
        F.count_if(F.col("kind") == "text").alias("n_text"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(share > 0.5, F.struct("position", "column_name")))),
                lambda s: s["column_name"],
            ), ",",
        ).alias("mostly_missing"),
        F.lit(1).alias("one"),
    )
    return per_table.join(duplicates.withColumn("one", F.lit(1)), "one").select(
        "n_rows", "n_columns", "missing_pct", "n_duplicates", "n_numeric", "n_text", "mostly_missing",
        (F.col("n_rows") > 100_000).alias("is_large"),
    )


def suggest_transformations(df: DataFrame, stats: DataFrame, duplicates: DataFrame) -> DataFrame:
    """transformation, column_name, priority: fill, deduplicate, split dates, log-transform."""
    def row(name: str, column, priority: str) -> list[Column]:
        return [F.lit(name).alias("transformation"), column.alias("column_name"), F.lit(priority).alias("priority")]

    fill = stats.filter(F.col("n_missing") > 0).select(*row("Handle missing values", F.col("column_name"), "high"))
    dedup = duplicates.filter(F.col("n_duplicates") > 0).select(*row("Remove duplicates", F.lit(DATASET), "high"))
    parts = stats.filter(F.col("kind") == "datetime").select(*row("Extract date parts", F.col("column_name"), "medium"))
    out = fill.unionByName(dedup).unionByName(parts)
    numbers = numeric_columns(df)
    if numbers:
        skewed = skewness(df, numbers).filter((F.abs("skewness") > 2) & (F.col("std") > 0))
        out = out.unionByName(skewed.select(*row("Log-transform", F.col("column_name"), "medium")))
    return out
