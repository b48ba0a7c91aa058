"""Outliers, patterns and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.semantics import band, band_below, kind_of, percent, quoted, ratio
from tablewright.operators.aggregate import correlation_pairs, top_category
from tablewright.plans.outliers import iqr_outliers
from tablewright.plans.selection import from_on, grouped_cuts, order_cuts, up_to
from tablewright.plans.stats import column_stats, comparable, skewness


def iqr_anomalies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, outlier_count, outlier_pct and fences of columns with outliers."""
    found = iqr_outliers(df, columns).filter(F.col("n_outliers") > 0)
    return found.select(
        "column_name",
        F.col("n_outliers").alias("outlier_count"),
        F.round(percent(F.col("n_outliers"), F.col("n_valid")), 2).alias("outlier_pct"),
        F.round("lower_bound", 2).alias("lower_bound"),
        F.round("upper_bound", 2).alias("upper_bound"),
    )


def anomaly_alerts(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Outlier counts with severity: above 5 % Critical, above 1 % Warning, else Info."""
    found = iqr_outliers(df, measures).filter(F.col("n_outliers") > 0)
    pct = percent(F.col("n_outliers"), F.col("n_valid"))
    return found.select(
        "column_name",
        F.col("n_outliers").alias("anomalies"),
        F.round(pct, 1).alias("percentage"),
        band(pct, (5, "Critical"), (1, "Warning"), otherwise="Info").alias("severity"),
        F.round("lower_bound", 2).alias("lower_bound"),
        F.round("upper_bound", 2).alias("upper_bound"),
        "minimum", "maximum",
    )


def zscore_outliers(
    df: DataFrame, measures: Sequence[str], keys: Sequence[str], threshold: float = 3.0
) -> DataFrame:
    """keys..., column_name, value, z of values more than `threshold` deviations from the mean."""
    stats = [r for r in column_stats(df, list(measures)).collect() if r["std"]]
    cells = [
        F.struct(
            F.lit(r["column_name"]).alias("column_name"),
            quoted(r["column_name"]).cast("double").alias("value"),
            ((quoted(r["column_name"]) - F.lit(r["mean"])) / F.lit(r["std"])).alias("z"),
        )
        for r in stats
    ]
    key_columns = [quoted(k) for k in keys]
    if not cells:
        empty = df.select(*key_columns, F.lit("").alias("column_name"), F.lit(0.0).alias("value"), F.lit(0.0).alias("z"))
        return empty.filter(F.lit(False))
    wild = F.filter(F.array(*cells), lambda s: F.abs(s["z"]) > threshold)
    return df.select(*key_columns, F.inline(wild))


def strong_correlations(df: DataFrame, columns: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Pairs whose absolute correlation exceeds the threshold, with direction and strength."""
    r = F.col("r")
    return correlation_pairs(df, columns).filter(F.abs(r) > threshold).select(
        "column_a", "column_b", "r",
        F.when(r > 0, "positive").otherwise("negative").alias("direction"),
        F.when(F.abs(r) > 0.7, "strong").otherwise("moderate").alias("strength"),
    )


def dominant_categories(df: DataFrame, columns: Sequence[str], above_pct: float = 50.0) -> DataFrame:
    """column_name, value, share_pct where one value holds more than `above_pct` of all rows."""
    top = top_category(df, columns)
    rows = column_stats(df, columns, moments=False).select("column_name", "n_rows")
    share = percent(F.col("n"), F.col("n_rows"))
    return top.join(F.broadcast(rows), "column_name").filter(share > above_pct).select(
        "column_name", "value", share.alias("share_pct")
    )


def distribution_skew(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """column_name, skewness, status (below 1 Normal, below 2 Skewed), is_pattern (above 2)."""
    sk = F.col("skewness")
    return skewness(df, measures).select(
        "column_name", sk,
        band_below(F.abs(sk), (1, "Normal"), (2, "Skewed"), otherwise="Highly Skewed").alias("status"),
        (F.abs(sk) > 2).alias("is_pattern"),
    )


def variation(df: DataFrame, measures: Sequence[str], *, absolute_mean: bool = False) -> DataFrame:
    """column_name, cv_pct, std, stability (below 50 Stable, below 100 Variable), high (above 1).

    The mean is signed unless `absolute_mean`; a zero mean gives 0.
    """
    mean = F.abs("mean") if absolute_mean else F.col("mean")
    cv = F.coalesce(ratio(F.col("std"), mean), F.lit(0.0))
    return column_stats(df, list(measures)).select(
        "column_name", (cv * 100).alias("cv_pct"), "std",
        band_below(cv * 100, (50, "Stable"), (100, "Variable"), otherwise="Volatile").alias("stability"),
        (F.coalesce(ratio(F.col("std"), F.abs("mean")), F.lit(0.0)) > 1).alias("high"),
    )


def performance_gaps(
    df: DataFrame, categories: Sequence[str], numbers: Sequence[str], above: float = 3.0
) -> DataFrame:
    """category, number, top and bottom group and their means where the means differ more than `above` times.

    All category and number pairs come from one scan; only pairs with positive means are compared.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def key_of(c: str) -> Column:  # texts stay whole, as they are part of the result; rows are combined first
        return quoted(c) if kind_of(types[c]) == "text" else comparable(c, types[c])

    sides = F.inline(F.array(*[
        F.struct(F.lit(c).alias("category"), key_of(c).alias("key")) for c in categories
    ]))
    spread = df.select(*[quoted(n).cast("double").alias(f"__n{i}") for i, n in enumerate(numbers)], sides)
    means = spread.filter(F.col("key").isNotNull()).groupBy("category", "key").agg(
        *[F.avg(f"__n{i}").alias(f"__n{i}") for i in range(len(numbers))]
    )
    pairs = means.select("category", "key", F.inline(F.array(*[
        F.struct(F.lit(n).alias("number"), F.col(f"__n{i}").alias("mean")) for i, n in enumerate(numbers)
    ]))).filter(F.col("mean").isNotNull())
    ends = pairs.groupBy("category", "number").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("key", F.struct((-F.col("mean")).alias("m"), F.col("key"))).alias("top_key"),
        F.max("mean").alias("top_mean"),
        F.min_by("key", F.struct(F.col("mean"), F.col("key"))).alias("bottom_key"),
        F.min("mean").alias("bottom_mean"),
    )
    gap = F.try_divide(F.col("top_mean"), F.col("bottom_mean"))
    return ends.filter((F.col("n") >= 2) & (F.col("bottom_mean") > 0) & (gap > above)).drop("n").withColumn("gap", gap)


# ---- order and drift -------------------------------------------------------------------------

def first_half(df: DataFrame, order_by: Sequence[str]) -> Column:
    """A condition that holds for the first n div 2 rows in row order."""
    _, cuts = order_cuts(df, order_by, lambda n: [n // 2 - 1] if n >= 2 else [])
    return up_to(order_by, cuts[0]) if cuts else F.lit(False)


def half_split(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The rows with `half` 1 or 2 by row order; rows without a leading order value stand in neither, and it is null."""
    half = F.when(first_half(df, order_by), 1).when(quoted(order_by[0]).isNotNull(), 2)
    return df.withColumn("half", half)


def numeric_drift(df: DataFrame, measures: Sequence[str], order_by: Sequence[str], least_rows: int = 20) -> DataFrame:
    """Mean of the first and second half per measure, change in percent and its band.

    Above 20 % Significant, above 10 % Moderate.  A table of fewer than `least_rows` rows has no drift.  Rows
    without a leading order value are in neither half.  The cut is found first; one scan does the rest.
    """
    early = first_half(df, order_by)

    def row(m: str) -> Column:
        v = quoted(m).cast("double")
        return F.struct(
            F.lit(m).alias("column_name"),
            F.avg(F.when(early, v)).alias("mean_first"),
            F.avg(F.when(~early, v)).alias("mean_second"),
        )

    means = df.agg(F.array(*[row(m) for m in measures]).alias("r"), F.count(F.lit(1)).alias("n"))
    change = percent(F.col("mean_second") - F.col("mean_first"), F.abs("mean_first"))
    return means.filter(F.col("n") >= least_rows).select(F.inline("r")).select(
        "column_name", "mean_first", "mean_second", change.alias("change_pct"),
        band(F.abs(change), (20, "Significant"), (10, "Moderate"), otherwise="Stable").alias("drift"),
    )


def categorical_drift(df: DataFrame, dimensions: Sequence[str], order_by: Sequence[str], least_rows: int = 0) -> DataFrame:
    """column_name, categories, max_shift (points of share between halves), status (above 10 Drifted).

    As `numeric_drift`, but by default for tables of any size.
    """
    early = first_half(df, order_by)
    if least_rows > 1 and df.limit(least_rows).count() < least_rows:
        df = df.limit(0)
    types = {f.name: f.dataType for f in df.schema.fields}
    texts = df.select(early.alias("early"), *[comparable(c, types[c]).alias(c) for c in dimensions])
    long = texts.unpivot(["early"], [quoted(c) for c in dimensions], "column_name", "value")
    counts = long.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
        F.count_if("early").alias("a"), F.count_if(~F.col("early")).alias("b")
    )
    totals = counts.groupBy("column_name").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    shift = F.abs(percent(F.col("b"), F.col("tb")) - percent(F.col("a"), F.col("ta")))
    return counts.join(F.broadcast(totals), "column_name").groupBy("column_name").agg(
        F.count(F.lit(1)).alias("categories"), F.max(shift).alias("max_shift")
    ).withColumn("status", band(F.col("max_shift"), (10, "Drifted"), otherwise="Stable"))


def quarter_growth(df: DataFrame, measures: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Mean of the first and the last quarter of a measure's rows in row order, growth in percent.

    Rows without the measure are dropped first; a quarter is max(1, n div 4) rows.
    """
    spark, measures = df.sparkSession, list(dict.fromkeys(measures))
    rows = df.select(*[quoted(c) for c in dict.fromkeys([*order_by, *measures])])
    there = {m: quoted(m).isNotNull() & quoted(order_by[0]).isNotNull() for m in measures}
    found = grouped_cuts(rows, order_by, there, lambda n: [max(1, n // 4) - 1, n - max(1, n // 4)] if n >= 2 else [])
    searched = [m for m in measures if found[m]]
    if not searched:
        return spark.createDataFrame([], "column_name string, first_mean double, last_mean double, growth_pct double")

    def row(m: str) -> Column:
        (first, last), v, lead = found[m], quoted(m).cast("double"), quoted(order_by[0])
        return F.struct(
            F.lit(m).alias("column_name"),
            F.avg(F.when(there[m] & up_to(order_by, first), v)).alias("first_mean"),
            F.avg(F.when(there[m] & from_on(order_by, last), v)).alias("last_mean"),
            F.min(F.when(there[m], lead)).alias("first_at"),
            F.max(F.when(there[m], lead)).alias("last_at"),
        )

    ends = rows.agg(F.array(*[row(m) for m in searched]).alias("r")).select(F.inline("r"))
    change = percent(F.col("last_mean") - F.col("first_mean"), F.abs("first_mean"))
    return ends.filter(F.col("first_mean") != 0).withColumn("growth_pct", change)
