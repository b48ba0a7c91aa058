"""Grouped aggregates, KPIs, rankings, trends, shares and correlations."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.names import (
    KPI_CUSTOMER_WORDS,
    KPI_PRODUCT_WORDS,
    KPI_REGION_WORDS,
    KPI_REVENUE_WORDS,
    pick,
)
from tablewright.functions.semantics import (
    aggregate_named,
    month_of,
    percent,
    quoted,
    ratio,
    total,
)
from tablewright.operators.roles import Roles, classify
from tablewright.plans.gram import co_moments
from tablewright.plans.materialize import materialize
from tablewright.plans.selection import column_quantiles, group_quantiles
from tablewright.plans.stats import column_stats, numeric_columns, text_columns, top_values


# ---- grouped aggregates ----------------------------------------------------------------------

def _grouped(df: DataFrame, group: str, value: str, agg: str) -> DataFrame:
    """group, v: one row per group, null group included."""
    if agg == "median":
        items = df.select(quoted(group).alias(group), quoted(value).cast("double").alias("v"))
        medians = group_quantiles(items, [group], [0.5]).select(quoted(group).alias("__g"), F.col("q")[0].alias("v"))
        groups = df.select(quoted(group).alias(group)).distinct()
        return groups.join(medians, quoted(group).eqNullSafe(F.col("__g")), "left").select(quoted(group), "v")
    return df.groupBy(quoted(group)).agg(aggregate_named(agg)(quoted(value)).alias("v"))


def top_groups(
    df: DataFrame, group: str, value: str, agg: str = "sum", top_n: int = 20, *,
    keep_null: bool = True, ascending: bool = False,
) -> DataFrame:
    """The first `top_n` groups by an aggregate; output columns are the group and `{value}_{agg}`."""
    source = df if keep_null else df.filter(quoted(group).isNotNull())
    out = _grouped(source, group, value, agg).withColumnRenamed("v", f"{value}_{agg}")
    by = quoted(f"{value}_{agg}")
    order = by.asc_nulls_last() if ascending else by.desc_nulls_last()
    return out.orderBy(order, quoted(group).asc_nulls_last()).limit(top_n)


def aggregate_by(df: DataFrame, group: str, value: str, func: str = "sum") -> DataFrame:
    """One row per group (null included) with sum, mean, count, min, max or median of a column."""
    return _grouped(df, group, value, func).withColumnRenamed("v", value)


def top_items(df: DataFrame, group: str, value: str, n: int = 10, ascending: bool = False) -> DataFrame:
    """Groups with the largest (or smallest) sums."""
    return top_groups(df, group, value, "sum", n, ascending=ascending)


def value_counts(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """The most frequent present values of a column."""
    return (
        df.filter(quoted(column).isNotNull())
        .groupBy(quoted(column))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), quoted(column))
        .limit(top_n)
    )


def group_sum_mean_count(df: DataFrame, group: str, value: str) -> DataFrame:
    """Sum, mean and count of present values per present group."""
    v = quoted(value)
    return df.filter(quoted(group).isNotNull()).groupBy(quoted(group)).agg(
        total(v).alias("sum"), F.avg(v).alias("mean"), F.count(v).alias("count")
    )


def ranking(df: DataFrame, group: str, measures: Sequence[str], top_n: int = 10) -> DataFrame:
    """Sum and mean of the measures with group sizes, by the first measure's sum."""
    aggs: list[Column] = []
    for m in measures:
        aggs += [
            F.round(total(quoted(m)), 2).alias(f"sum_{m}"),
            F.round(F.avg(quoted(m)), 2).alias(f"mean_{m}"),
        ]
    return (
        df.filter(quoted(group).isNotNull())
        .groupBy(quoted(group))
        .agg(*aggs, F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc(f"sum_{measures[0]}"), quoted(group))
        .limit(top_n)
    )


def second_ranking(df: DataFrame, group: str, measure: str, top_n: int = 10) -> DataFrame:
    """Sum, mean and count of one measure per group, largest sums first."""
    out = group_sum_mean_count(df, group, measure)
    return out.withColumns({"sum": F.round("sum", 2), "mean": F.round("mean", 2)}).orderBy(
        F.desc("sum"), quoted(group)
    ).limit(top_n)


# ---- whole-table numbers ---------------------------------------------------------------------

def business_metrics(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """total, mean, median, std, min, max per numeric column that has values."""
    names = list(numeric_columns(df) if columns is None else columns)
    medians = column_quantiles(df, names, [0.5])
    stats = column_stats(df, names)
    return stats.join(F.broadcast(medians.select("column_name", "q")), "column_name").select(
        "column_name",
        "total",
        F.round("mean", 4).alias("mean"),
        F.round(F.col("q")[0], 4).alias("median"),
        F.round("std", 4).alias("std"),
        "minimum",
        "maximum",
    )


def numeric_summary(df: DataFrame, measures: Iterable[str]) -> DataFrame:
    """metric, total, mean, median, std per measure, rounded to 2 places but for the total."""
    names = list(measures)
    medians = column_quantiles(df, names, [0.5]).select("column_name", "q")
    return column_stats(df, names).join(F.broadcast(medians), "column_name", "left").select(
        F.col("column_name").alias("metric"),
        F.coalesce("total", F.lit(0.0)).alias("total"),
        F.round("mean", 2).alias("mean"),
        F.round(F.col("q")[0], 2).alias("median"),
        F.round("std", 2).alias("std"),
    )


def kpis(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """kpi, value: record and column counts, then total and average of each measure with values."""
    stats = column_stats(df, list(measures))
    n_columns = F.lit(float(len(df.columns)))
    general = df.agg(F.count(F.lit(1)).cast("double").alias("n")).select(
        F.inline(
            F.array(
                F.struct(F.lit("Total Records").alias("kpi"), F.col("n").alias("value")),
                F.struct(F.lit("Total Columns").alias("kpi"), n_columns.alias("value")),
            )
        )
    )
    per_measure = stats.filter(F.col("n_valid") > 0).select(
        F.inline(
            F.array(
                F.struct(F.concat(F.lit("Total "), "column_name").alias("kpi"), F.col("total").alias("value")),
                F.struct(F.concat(F.lit("Avg "), "column_name").alias("kpi"), F.col("mean").alias("value")),
            )
        )
    )
    return general.unionByName(per_measure)


def top_category(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """column_name, value, n: the most frequent value of each dimension."""
    return top_values(df, dimensions, 1).drop("place")


def growth_rate(df: DataFrame, value: str, order_by: Sequence[str]) -> DataFrame:
    """first_value, last_value and growth_pct between the first and last present value in row order."""
    v, at = quoted(value), F.struct(*[quoted(c) for c in order_by])
    ends = df.filter(v.isNotNull()).agg(
        F.min_by(v, at).alias("first_value"), F.max_by(v, at).alias("last_value"), F.count(v).alias("n")
    )
    change = percent(F.col("last_value") - F.col("first_value"), F.abs("first_value"))
    return ends.filter((F.col("n") > 1) & (F.col("first_value") != 0)).select(
        F.lit(value).alias("column_name"), "first_value", "last_value", change.alias("growth_pct")
    )


def kpi_delta(df: DataFrame, measures: Sequence[str], predicate: Column) -> DataFrame:
    """Per measure: total and mean under a filter, the unfiltered total and the difference in percent.

    Filtered and unfiltered numbers come from the same scan.
    """
    def row(m: str) -> Column:
        v = quoted(m).cast("double")
        kept = F.when(predicate, v)
        return F.struct(
            F.lit(m).alias("column_name"), total(kept).alias("total"), F.avg(kept).alias("mean"),
            total(v).alias("base_total"), F.avg(v).alias("base_mean"),
        )

    out = df.agg(F.array(*[row(m) for m in measures]).alias("r")).select(F.inline("r"))
    delta = percent(F.col("total") - F.col("base_total"), F.abs("base_total"))
    return out.withColumn("delta_pct", delta)


def kpi_cards(df: DataFrame, cards: Sequence[tuple[str, str, str]], predicate: Column) -> DataFrame:
    """label, value, base, delta_pct for cards of (label, column, aggregate), all from one scan."""
    def row(label: str, column: str, agg: str) -> Column:
        v, fn = quoted(column).cast("double"), aggregate_named(agg)
        return F.struct(
            F.lit(label).alias("label"), fn(F.when(predicate, v)).cast("double").alias("value"),
            fn(v).cast("double").alias("base"),
        )

    out = df.agg(F.array(*[row(*c) for c in cards]).alias("r")).select(F.inline("r"))
    return out.withColumn("delta_pct", percent(F.col("value") - F.col("base"), F.abs("base")))


def scalar_aggregates(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, count, mean, sum, min, max, median, std and distinct values of a column."""
    v = quoted(column)
    middle = column_quantiles(df, [column], [0.5])
    wide = df.agg(
        F.lit(column).alias("column_name"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        total(v).alias("sum"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.stddev_samp(v).alias("std"),
        F.count_distinct(v).alias("n_distinct"),
    )
    return wide.join(
        F.broadcast(middle.select("column_name", F.col("q")[0].alias("median"))), "column_name", "left"
    )


def unique_values(df: DataFrame, column: str, show: int | None = None) -> DataFrame:
    """value: the distinct present values in order, or the first `show` of them."""
    values = df.filter(quoted(column).isNotNull()).select(quoted(column)).distinct().orderBy(quoted(column))
    return values if show is None else values.limit(show)


def missing_by_column(df: DataFrame) -> DataFrame:
    """column_name, n_missing for columns with missing values, most first."""
    stats = column_stats(df, moments=False)
    return stats.filter(F.col("n_missing") > 0).select("column_name", "n_missing").orderBy(
        F.desc("n_missing"), "column_name"
    )


# ---- time ------------------------------------------------------------------------------------

def monthly_trend(df: DataFrame, at: str, value: str, agg: str = "sum") -> DataFrame:
    """month, `{value}_{agg}` for months that have rows, in order; rows without a time are left out."""
    return (
        df.filter(quoted(at).isNotNull())
        .groupBy(F.trunc(quoted(at), "month").alias("month"))
        .agg(aggregate_named(agg)(quoted(value)).alias(f"{value}_{agg}"))
        .withColumn("month", month_of(F.col("month")))  # formatted once per month, not per row
        .orderBy("month")
    )


def top_months(df: DataFrame, at: str, value: str, top_n: int = 20) -> DataFrame:
    """The months with the largest sums, largest first."""
    monthly = monthly_trend(df, at, value)
    return monthly.orderBy(F.desc_nulls_last(f"{value}_sum"), "month").limit(top_n)


def monthly_resample(df: DataFrame, at: str, value: str) -> DataFrame:
    """month, total from the first to the last month, with 0 for months without rows.

    Each month that has rows also stands for the empty ones up to the next; the window runs over one
    row per month.
    """
    month = F.trunc(quoted(at), "month")
    monthly = df.filter(quoted(at).isNotNull()).groupBy(month.alias("m")).agg(total(quoted(value)).alias("total"))
    following = F.lead("m").over(Window.partitionBy(F.lit(0)).orderBy("m"))
    monthly = monthly.withColumn("last", F.coalesce(F.add_months(following, -1), F.col("m")))
    spans = monthly.select("m", "total", F.explode(F.sequence("m", "last", F.expr("INTERVAL 1 MONTH"))).alias("at"))
    return spans.select(
        F.date_format("at", "yyyy-MM").alias("month"),
        F.when(F.col("at") == F.col("m"), F.col("total")).otherwise(0.0).alias("total"),
    ).orderBy("month")


def trend_change(resampled: DataFrame) -> DataFrame:
    """first_month, last_month, first_total, last_total, change_pct of a monthly series."""
    ends = resampled.agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        F.min_by("total", "month").alias("first_total"), F.max_by("total", "month").alias("last_total"),
        F.count(F.lit(1)).alias("n"),
    )
    change = percent(F.col("last_total") - F.col("first_total"), F.abs("first_total"))
    return ends.filter(F.col("n") >= 2).drop("n").withColumn("change_pct", change)


# ---- shares and correlations -----------------------------------------------------------------

def share_of_total(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, total, share_pct of the grand total over all rows, present groups only.

    The grand total counts rows without a group; it comes from the same scan.
    """
    sums = materialize(df.groupBy(quoted(group)).agg(total(quoted(value)).alias("total")))
    grand = sums.agg(F.sum("total")).first()[0] or 0.0
    return sums.filter(quoted(group).isNotNull()).select(
        quoted(group), "total", percent(F.col("total"), F.lit(float(grand))).alias("share_pct")
    )


PAIR_SCHEMA = "column_a string, column_b string, r double"
# A deviation below this share of the values' size is rounding, and the column constant.
CONSTANT_BELOW = 1e-14


def _correlations(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """{(column of left, column of right): r}, each over the rows where both are present, from one scan.

    Null where a column is constant over those rows, or there are fewer than two.  The driver reads a row of
    sums for each column.
    """
    left, right = list(dict.fromkeys(left)), list(dict.fromkeys(right))
    names = list(dict.fromkeys([*left, *right]))
    found, sizes = co_moments(df, names, right)
    out: dict[tuple[str, str], float | None] = {}
    for a in left:
        for k, b in enumerate(right):
            i, j, r = names.index(a), names.index(b), None
            if found is not None and found.n[i, k] > 1:
                n, var_a, var_b = found.n[i, k], found.sq_a[i, k], found.sq_b[i, k]
                if var_a > n * (CONSTANT_BELOW * sizes[i]) ** 2 and var_b > n * (CONSTANT_BELOW * sizes[j]) ** 2:
                    r = max(-1.0, min(1.0, float(found.prod[i, k] / (math.sqrt(var_a) * math.sqrt(var_b)))))
            out[a, b] = r
    return out


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_a, column_b, r for every pair of columns, null where either is constant."""
    names = list(columns)
    found = _correlations(df, names, names) if len(names) > 1 else {}
    rows = [(a, b, found[a, b]) for i, a in enumerate(names) for b in names[i + 1:]]
    return df.sparkSession.createDataFrame(rows, PAIR_SCHEMA)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column with its correlation to every column; no rows for fewer than two columns."""
    names = list(columns)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "column_name string")
    found = _correlations(df, names, names)
    r = {(a, b): found[a, b] for i, a in enumerate(names) for b in names[i + 1:]}
    varies = {c: any(v is not None for pair, v in r.items() if c in pair) for c in names}
    rows = [
        (a, *[(1.0 if varies[a] else None) if a == b else r.get((a, b), r.get((b, a))) for b in names]) for a in names
    ]
    schema = T.StructType(
        [T.StructField("column_name", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in names]]
    )
    return df.sparkSession.createDataFrame(rows, schema)


def feature_importance(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """column_name, importance: absolute correlation with the target, largest first."""
    found = _correlations(df, columns, [target]) if target in columns else {}
    rows = [(c, None if r is None else abs(r)) for (c, _), r in found.items() if c != target]
    out = df.sparkSession.createDataFrame(rows, "column_name string, importance double")
    return out.withColumn("importance", F.round("importance", 4)).orderBy(F.desc_nulls_last("importance"), "column_name")


# ---- sets of tables --------------------------------------------------------------------------

def gold_tables(df: DataFrame, roles: Roles | None = None, top_n: int | None = None) -> dict[str, DataFrame]:
    """The named business tables of a dataset.

    Sums and means of every measure by dimension, monthly sums by date column (named with it), and a
    numeric summary; `top_n` rows of each by size, or all.  Tables with a single row are left out.  All
    grouped tables come from one scan: rows are spread over their dimensions, aggregated, and the result
    (at most 51 groups per dimension and one per month) is written once.
    """
    roles = roles or classify(df)
    measures, tables = roles.measures, {}
    no_text, no_date = F.lit(None).cast("string"), F.lit(None).cast("date")
    sides = [(d, quoted(d).cast("string"), no_date) for d in roles.dimensions]
    sides += [(f"month of {t}", no_text, F.trunc(quoted(t), "month")) for t in roles.datetimes]
    if measures and sides:
        spread = F.inline(F.array(*[
            F.struct(F.lit(n).alias("__side"), c.alias("__text"), m.alias("__month")) for n, c, m in sides
        ]))
        aggs: list[Column] = []
        for i, m in enumerate(measures):
            aggs += [total(F.col(f"__m{i}")).alias(f"__sum{i}"), F.avg(f"__m{i}").alias(f"__mean{i}")]
        cube = materialize(
            df.select(*[quoted(m).alias(f"__m{i}") for i, m in enumerate(measures)], spread)
            .groupBy("__side", "__text", "__month")
            .agg(*aggs)
            .withColumn("__key", F.coalesce("__text", month_of(F.col("__month"))))
        )
        sizes = {r["__side"]: r["n"] for r in cube.groupBy("__side").agg(F.count(F.lit(1)).alias("n")).collect()}

        def table(side: str, key: str, i: int, agg: str) -> DataFrame:
            name = f"{measures[i]}_{agg}"
            rows = (
                cube.filter(F.col("__side") == side)
                .select(F.col("__key").alias(key), F.col(f"__{agg}{i}").alias(name))
                .orderBy(quoted(name).desc_nulls_last(), quoted(key).asc_nulls_last())
            )
            return rows if top_n is None else rows.limit(top_n)

        for d in roles.dimensions:
            if sizes.get(d, 0) > 1:
                for i, m in enumerate(measures):
                    tables[f"{m}_by_{d}"] = table(d, d, i, "sum")
                for i, m in enumerate(measures):
                    tables[f"avg_{m}_by_{d}"] = table(d, d, i, "mean")
        for t in roles.datetimes:
            side = f"month of {t}"
            if sizes.get(side, 0) > 1:
                for i, m in enumerate(measures):
                    tables[f"monthly_{m}_by_{t}"] = table(side, "month", i, "sum")
    if roles.measures:
        tables["numeric_summary"] = numeric_summary(df, roles.measures)
    return tables


def suggested_kpis(df: DataFrame) -> DataFrame:
    """kpi, kind, key, value: the KPIs column names suggest, evaluated.

    Totals and averages of revenue-like columns, revenue by customer and by region, the ten most
    frequent products, and totals of the other numeric columns.  No row for a table without such columns.
    """
    numbers, texts = numeric_columns(df), text_columns(df)
    revenue = pick(numbers, KPI_REVENUE_WORDS)
    others = [c for c in numbers if c not in revenue]
    parts: list[DataFrame] = []
    if revenue or others:
        rows = []
        for c in revenue + others:
            v = quoted(c).cast("double")
            rows.append((f"Total {c}", total(v)))
            if c in revenue:
                rows.append((f"Average {c}", F.avg(v)))
        structs = [
            F.struct(
                F.lit(k).alias("kpi"), F.lit("aggregate").alias("kind"),
                F.lit(None).cast("string").alias("key"), v.alias("value"),
            )
            for k, v in rows
        ]
        parts.append(df.agg(F.array(*structs).alias("r")).select(F.inline("r")))
    for words in (KPI_CUSTOMER_WORDS, KPI_REGION_WORDS):
        by = pick(texts, words)
        if revenue and by:
            sums = df.filter(quoted(by[0]).isNotNull()).groupBy(quoted(by[0]).alias("key")).agg(
                total(quoted(revenue[0])).alias("value")
            )
            parts.append(sums.select(
                F.lit(f"{revenue[0]} by {by[0]}").alias("kpi"), F.lit("grouped").alias("kind"), "key", "value"
            ))
    products = pick(texts, KPI_PRODUCT_WORDS)
    if products:
        top = value_counts(df, products[0], 10)
        parts.append(top.select(
            F.lit(f"Top {products[0]}").alias("kpi"), F.lit("ranking").alias("kind"),
            quoted(products[0]).alias("key"), F.col("n").cast("double").alias("value"),
        ))
    if not parts:
        return df.sparkSession.createDataFrame([], "kpi string, kind string, key string, value double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- rows ------------------------------------------------------------------------------------

def top_rows(df: DataFrame, column: str, n: int, tie_break: Sequence[str], largest: bool = True) -> DataFrame:
    """The n rows with the largest (or smallest) values of a column."""
    by = quoted(column).desc_nulls_last() if largest else quoted(column).asc_nulls_last()
    return df.filter(quoted(column).isNotNull()).orderBy(by, *tie_break).limit(n)


def row_at_extreme(df: DataFrame, column: str, tie_break: Sequence[str], largest: bool = True) -> DataFrame:
    """The row holding a column's maximum or minimum."""
    return top_rows(df, column, 1, tie_break, largest)


def first_rows(df: DataFrame, n: int, order_by: Sequence[str], last: bool = False) -> DataFrame:
    """The first or last n rows in row order."""
    return df.orderBy(*[F.desc(c) if last else F.asc(c) for c in order_by]).limit(n)


def filter_in(df: DataFrame, choices: dict[str, Sequence[str]]) -> DataFrame:
    """Rows whose columns, as text, are among the chosen values; all choices must hold."""
    for name, values in choices.items():
        if values:
            df = df.filter(quoted(name).cast("string").isin(*[str(v) for v in values]))
    return df


def sample_rows(df: DataFrame, n: int = 500, seed: int = 42) -> DataFrame:
    """At most n random rows: somewhat more are drawn, and n of those taken at random."""
    rows = df.count()
    if rows <= n:
        return df
    few = df.sample(fraction=min(1.0, 1.5 * n / rows + 10 / rows), seed=seed)
    return few.orderBy(F.rand(seed)).limit(n)
