"""The aggregate a chart needs; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.semantics import aggregate_named, kind_of, quoted
from tablewright.operators.aggregate import (
    correlation_matrix,
    monthly_trend,
    sample_rows,
    top_groups,
    value_counts,
)
from tablewright.plans.selection import column_quantiles, group_quantiles
from tablewright.plans.stats import pin

FIVE_NUMBERS = [0.0, 0.25, 0.5, 0.75, 1.0]


def bar(df: DataFrame, x: str, y: str, agg: str = "sum", top_n: int = 10) -> DataFrame:
    """The x with the largest aggregates of y; missing x is left out."""
    return top_groups(df, x, y, agg, top_n, keep_null=False)


def treemap(df: DataFrame, x: str, y: str, agg: str = "sum", top_n: int = 12) -> DataFrame:
    """As a bar chart, but empty where fewer than two groups would show."""
    top = pin(bar(df, x, y, agg, top_n))
    return top if top.count() >= 2 else top.filter(F.lit(False))


def grouped_bar(df: DataFrame, x: str, y: str, color: str, agg: str = "sum", top_n: int = 10) -> DataFrame:
    """Aggregates by x and colour for the top x; at most `top_n` keys are broadcast."""
    top = bar(df, x, y, agg, top_n).select(quoted(x))
    kept = df.filter(quoted(x).isNotNull() & quoted(color).isNotNull()).join(F.broadcast(top), x, "left_semi")
    return kept.groupBy(quoted(x), quoted(color)).agg(aggregate_named(agg)(quoted(y)).alias(f"{y}_{agg}"))


def line(df: DataFrame, x: str, y: str, agg: str = "sum") -> DataFrame:
    """Aggregates by month if x is a date, otherwise by x, in order of x."""
    if kind_of(df.schema[x].dataType) == "datetime":
        return monthly_trend(df, x, y, agg).withColumnRenamed("month", "x")
    return (
        df.filter(quoted(x).isNotNull())
        .groupBy(quoted(x).alias("x"))
        .agg(aggregate_named(agg)(quoted(y)).alias(f"{y}_{agg}"))
        .orderBy("x")
    )


def scatter(df: DataFrame, x: str, y: str, color: str | None = None, n: int = 500, seed: int = 42) -> DataFrame:
    """At most n random points."""
    names = [x, y] + ([color] if color else [])
    return sample_rows(df.select(*[quoted(c) for c in names]), n, seed)


def pie(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """The most frequent values."""
    return value_counts(df, column, top_n)


def box(df: DataFrame, y: str, x: str | None = None) -> DataFrame:
    """minimum, q1, median, q3, maximum of y, per present x if given."""
    q = F.col("q")
    numbers = [q[i].alias(n) for i, n in enumerate(["minimum", "q1", "median", "q3", "maximum"])]
    if x is None:
        return column_quantiles(df, [y], FIVE_NUMBERS).select("column_name", "n", *numbers)
    items = df.filter(quoted(x).isNotNull()).select(quoted(x).alias(x), quoted(y).cast("double").alias("v"))
    return group_quantiles(items, [x], FIVE_NUMBERS).select(quoted(x), "n", *numbers)


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """bin (from 0), lower, upper, n: equal-width bins from the least to the largest finite value, empty ones included.

    Infinite values count in the outer bins, NaN in none.
    """
    v = quoted(column).cast("double")
    v = F.when(~F.isnan(v), v)
    finite = F.when(F.abs(v) < float("inf"), v)
    ends = df.agg(F.min(finite).alias("a"), F.max(finite).alias("b")).first()
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if ends["a"] is None:
        return spine.filter(F.lit(False)).select("bin", F.lit(0.0).alias("lower"), F.lit(0.0).alias("upper"), F.col("bin").cast("bigint").alias("n"))
    a, width = float(ends["a"]), (float(ends["b"]) - float(ends["a"])) / bins
    place = F.floor((F.least(F.greatest(v, F.lit(a)), F.lit(float(ends["b"]))) - a) / width) if width else None
    at = F.least(F.lit(bins - 1), place) if width else F.lit(0)
    counts = df.filter(v.isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.lit(a) + F.col("bin") * width).alias("lower"), (F.lit(a) + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def heatmap(df: DataFrame, measures: Sequence[str], cap: int | None = None) -> DataFrame:
    """The correlation matrix of the measures, or of the first `cap`."""
    return correlation_matrix(df, list(measures)[:cap])


def time_series(df: DataFrame, at: str, value: str) -> DataFrame:
    """Present (time, value) rows in time order, ties by value."""
    return df.select(quoted(at), quoted(value)).dropna().orderBy(quoted(at), quoted(value))
