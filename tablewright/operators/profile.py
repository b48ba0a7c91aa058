"""Column and dataset profiles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.semantics import kind_of, percent, quoted
from tablewright.operators.roles import classify, profile_types
from tablewright.plans.selection import column_quantiles
from tablewright.plans.stats import (
    column_stats,
    distinct_counts,
    duplicate_counts,
    numeric_columns,
    top_values,
)


def _countable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) != "nested"]


def column_profile(df: DataFrame) -> DataFrame:
    """Missing and distinct counts and percentages of every column."""
    stats = column_stats(df, moments=False)
    both = stats.join(F.broadcast(distinct_counts(df, _countable(df))), "column_name", "left")
    d = F.coalesce(F.col("n_distinct"), F.lit(0))
    return both.select(
        "column_name",
        "data_type",
        "n_valid",
        "n_missing",
        F.round(percent(F.col("n_missing"), F.col("n_rows")), 2).alias("missing_pct"),
        d.alias("n_distinct"),
        F.round(percent(d, F.col("n_rows")), 2).alias("distinct_pct"),
    )


def numeric_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Mean, median, std, min, max and quartiles of numeric columns, rounded to 4 places."""
    names = list(numeric_columns(df) if columns is None else columns)
    stats = column_stats(df, names)
    quartiles = column_quantiles(df, names, [0.25, 0.5, 0.75]).select("column_name", "q")
    both = stats.join(F.broadcast(quartiles), "column_name", "left")
    return both.select(
        "column_name",
        "n_valid",
        F.round("mean", 4).alias("mean"),
        F.round(F.col("q")[1], 4).alias("median"),
        F.round("std", 4).alias("std"),
        F.round("minimum", 4).alias("minimum"),
        F.round("maximum", 4).alias("maximum"),
        F.round(F.col("q")[0], 4).alias("q25"),
        F.round(F.col("q")[2], 4).alias("q75"),
    )


def describe(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max of numeric columns."""
    p = numeric_profile(df, columns)
    return p.select(
        "column_name", F.col("n_valid").alias("count"), "mean", "std", F.col("minimum").alias("min"),
        "q25", F.col("median").alias("q50"), "q75", F.col("maximum").alias("max"),
    )


def frequent_values(df: DataFrame, columns: Iterable[str], k: int = 10) -> DataFrame:
    """The k most frequent values of each column with their counts."""
    return top_values(df, columns, k)


def categorical_profile(df: DataFrame, columns: Iterable[str], k: int = 10) -> DataFrame:
    """column_name, n_distinct, mode, top: the k most frequent values as an array of (value, n)."""
    names = list(columns)
    top = top_values(df, names, k).groupBy("column_name").agg(
        F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("ranked")
    )
    counts = distinct_counts(df, names)
    return counts.join(F.broadcast(top), "column_name").select(
        "column_name",
        "n_distinct",
        F.col("ranked")[0]["value"].alias("mode"),
        F.transform("ranked", lambda r: F.struct(r["value"].alias("value"), r["n"].alias("n"))).alias("top"),
    )


def sample_values(df: DataFrame, column: str, order_by: list[str], k: int = 5) -> DataFrame:
    """The first k present values of a column in row order."""
    return df.filter(quoted(column).isNotNull()).orderBy(*order_by).select(quoted(column)).limit(k)


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: shape, duplicate rows, columns per kind, columns with missing values."""
    stats = column_stats(df, moments=False).agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.count_if(F.col("kind") == "numeric").alias("n_numeric"),
        F.count_if(F.col("kind") == "text").alias("n_text"),
        F.count_if(F.col("kind") == "datetime").alias("n_datetime"),
        F.count_if(F.col("n_missing") > 0).alias("n_incomplete"),
        F.sum("n_missing").alias("n_missing"),
        F.lit(1).alias("one"),
    )
    dups = duplicate_counts(df).withColumn("one", F.lit(1))
    return dups.join(F.broadcast(stats), "one").select(
        "n_rows", "n_columns", "n_duplicates",
        F.round(percent(F.col("n_duplicates"), F.col("n_rows")), 2).alias("duplicate_pct"),
        "n_numeric", "n_text", "n_datetime", "n_incomplete", "n_missing",
    )


def profile_report(df: DataFrame, top_k: int = 5) -> DataFrame:
    """The whole profile, one row per column: type, missing, distinct, top values and numbers."""
    roles = classify(df)
    base = column_profile(df).join(F.broadcast(profile_types(df, roles)), "column_name")
    countable = _countable(df)
    top = top_values(df, countable, top_k).groupBy("column_name").agg(
        F.array_sort(F.collect_list(F.struct("place", "value", "n"))).alias("top_values")
    )
    out = base.join(F.broadcast(top), "column_name", "left")
    if roles.measures:
        numbers = numeric_profile(df, roles.measures).drop("n_valid")
        out = out.join(F.broadcast(numbers), "column_name", "left")
    return out


def ingest_metadata(df: DataFrame, name: str, size_bytes: int | None = None) -> DataFrame:
    """One row: name, rows, columns, column names and types."""
    types = [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields]
    row = df.agg(F.count(F.lit(1)).alias("row_count"))
    mb = None if size_bytes is None else round(size_bytes / (1024 * 1024), 3)
    return row.select(
        F.lit(name).alias("dataset_name"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(",".join(df.columns)).alias("columns"),
        F.lit(",".join(types)).alias("data_types"),
        F.lit(mb).cast("double").alias("size_mb"),
    )
