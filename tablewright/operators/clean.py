"""The cleaning steps of the silver layer, and derived columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.names import standard_name
from tablewright.functions.semantics import (
    INTEGRAL,
    columns_of,
    kind_of,
    parse_number,
    DAY_FIRST_FORMATS,
    TIMESTAMP_FORMATS,
    parse_timestamp,
    quoted,
)
from tablewright.operators.aggregate import business_metrics
from tablewright.plans.materialize import materialize_rows
from tablewright.plans.selection import quantiles_on_driver
from tablewright.plans.stats import (
    column_stats,
    duplicate_counts,
    find_repeats,
    numeric_columns,
    text_columns,
    top_values,
    without_duplicates,
)

LOG_SCHEMA = "step int, operation string, rows_removed bigint, detail map<string,string>"


def name_changes(df: DataFrame) -> dict[str, str]:
    """Old to new name for every column that standard naming would rename."""
    renames = {c: standard_name(c) for c in df.columns if standard_name(c) != c}
    after = [renames.get(c, c) for c in df.columns]
    clashes = {n for n in after if after.count(n) > 1}
    if clashes:
        raise ValueError(f"columns would share a name after standardising: {sorted(clashes)}")
    return renames


def standardize_names(df: DataFrame) -> DataFrame:
    """Lower-case column names of letters, digits and single underscores."""
    return df.withColumnsRenamed(name_changes(df))


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Each distinct row once; only rows that may repeat are shuffled."""
    return without_duplicates(df)


def drop_all_null(df: DataFrame) -> DataFrame:
    """Rows with at least one value."""
    return df.dropna(how="all")


def _fill_batches(columns: Sequence[str]):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        carried: dict[str, pa.Scalar] = {}
        for batch in batches:
            arrays = []
            for name in batch.schema.names:
                array = batch.column(name)
                if name in columns and len(array):
                    array = pc.fill_null_forward(array)
                    if name in carried and array.null_count:
                        array = array.fill_null(carried[name])
                    if array[-1].is_valid:
                        carried[name] = array[-1]
                arrays.append(array)
            arrays.append(pa.array([part] * batch.num_rows, pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "__part"])

    return fill


def forward_fill(df: DataFrame, columns: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Replace missing values by the last present value before them in row order.

    Rows are range-partitioned by the order columns, filled inside each partition as it streams by,
    and written; then the last value of each partition (one row per partition) is carried to the
    partitions after it.  `order_by` must identify rows.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("__part", T.IntegerType())])
    local = materialize_rows(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .mapInArrow(_fill_batches(list(columns)), schema)
    )
    at = F.struct(*[quoted(c) for c in order_by])
    ends = local.groupBy("__part").agg(*[F.max_by(quoted(c), at).alias(f"__last_{c}") for c in columns])
    earlier = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "__part", *[F.last(f"__last_{c}", ignorenulls=True).over(earlier).alias(f"__carry_{c}") for c in columns]
    )
    joined = local.join(F.broadcast(carried), "__part", "left")
    return joined.select(
        *[
            F.coalesce(quoted(c), quoted(f"__carry_{c}")).alias(c) if c in columns else quoted(c)
            for c in df.columns
        ]
    )


def fill_missing(df: DataFrame, order_by: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Fill numbers with the median, text and flags with the most frequent value, dates forward.

    Returns the filled frame and what each column was filled with.  Whole-number columns with gaps
    become doubles, since a median need not be whole.  Dates are filled only when `order_by` says
    what "forward" means.
    """
    missing = {r["column_name"] for r in column_stats(df, moments=False).collect() if r["n_missing"]}
    types = {f.name: f.dataType for f in df.schema.fields}
    log: dict[str, str] = {}
    numbers = [c for c in df.columns if c in missing and kind_of(types[c]) == "numeric"]
    others = [c for c in df.columns if c in missing and kind_of(types[c]) in ("text", "boolean")]
    dates = [c for c in df.columns if c in missing and kind_of(types[c]) == "datetime"]

    medians = quantiles_on_driver(df, numbers, [0.5])
    modes = {r["column_name"]: r["value"] for r in top_values(df, others, 1).collect()} if others else {}
    filled = {}
    for c in numbers:
        if c in medians:
            middle = medians[c][1][0]
            wide = quoted(c).cast("double") if isinstance(types[c], INTEGRAL) else quoted(c)
            filled[c] = F.coalesce(wide, F.lit(middle))
            log[c] = f"median ({middle:.4f})"
    for c in others:
        fallback = "Unknown" if kind_of(types[c]) == "text" else None
        value = modes.get(c, fallback)
        if value is not None:
            filled[c] = F.coalesce(quoted(c), F.lit(value).cast(types[c]))
            log[c] = f"mode ({value})" if c in modes else value
    out = df.withColumns(filled) if filled else df
    if dates and order_by:
        out = forward_fill(out, dates, order_by)
        log.update({c: "forward fill" for c in dates})
    else:
        log.update({c: "left missing, as no order is given" for c in dates})
    return out, log


def normalize_types(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Text columns whose every present value is a number, or a date, take that type."""
    texts = text_columns(df)
    if not texts:
        return df, {}
    log: dict[str, str] = {}
    changed = {}
    for r in column_stats(df, texts, moments=False, text=True, dates=True).collect():
        c, n = r["column_name"], r["n_valid"]
        if n and r["n_numeric_text"] == n:
            changed[c], log[c] = parse_number(quoted(c)), "text to number"
        elif n and r["n_date_text"] == n:
            changed[c], log[c] = parse_timestamp(quoted(c)), "text to timestamp"
        elif n and r["n_day_first"] == n:  # a day above 12 says so, and nothing against it
            changed[c], log[c] = parse_timestamp(quoted(c), DAY_FIRST_FORMATS), "text to timestamp, day first"
    return (df.withColumns(changed) if changed else df), log


def parse_dates(df: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, dict[str, float]]:
    """Text columns where more than `threshold` of all rows are dates become timestamps."""
    texts = text_columns(df)
    if not texts:
        return df, {}
    shares = {r["column_name"]: r for r in _date_shares(df).collect() if r["share"] is not None}
    hits = {c: r["share"] for c, r in shares.items() if r["share"] > threshold}
    formats = {c: DAY_FIRST_FORMATS if shares[c]["day_first"] else TIMESTAMP_FORMATS for c in hits}
    return (df.withColumns({c: parse_timestamp(quoted(c), formats[c]) for c in hits}) if hits else df), hits


def date_shares(df: DataFrame) -> DataFrame:
    """column_name, share of all rows whose text is a date (missing values count against it)."""
    return _date_shares(df).drop("day_first")


def _date_shares(df: DataFrame) -> DataFrame:
    """column_name, share, day_first: whether more texts are dates with the day before the month than after it."""
    stats = column_stats(df, text_columns(df), moments=False, dates=True)
    share = F.try_divide(F.greatest("n_date_text", "n_day_first").cast("double"), F.col("n_rows"))
    return stats.select("column_name", share.alias("share"), (F.col("n_day_first") > F.col("n_date_text")).alias("day_first"))


def clean(
    df: DataFrame, order_by: Sequence[str] | None = None, *, drop_all_null_first: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Names, duplicates, missing values, types, empty rows — and a log with one row per step.

    The deduplicated rows are written once; the passes that follow read that copy.  Removing empty
    rows comes last, after filling, unless `drop_all_null_first` is set.  `order_by` is given in
    standardised names.
    """
    spark = df.sparkSession
    log: list[tuple] = []

    def note(operation: str, removed: int, detail: dict[str, str]) -> None:
        log.append((len(log) + 1, operation, removed, detail))

    renames = name_changes(df)
    df = standardize_names(df)
    note("standardize_column_names", 0, renames)
    if drop_all_null_first:
        df = drop_all_null(df)
    repeats = find_repeats(df)
    counts = duplicate_counts(df, repeats=repeats).first()
    df = materialize_rows(without_duplicates(df, repeats)) if counts["n_duplicates"] else df
    note("remove_duplicates", counts["n_duplicates"], {})
    df, filled = fill_missing(df, order_by)
    note("fill_missing_values", 0, filled)
    df, retyped = normalize_types(df)
    note("normalize_data_types", 0, retyped)
    empty = df.filter(F.forall(F.array(*[quoted(c).isNull() for c in df.columns]), lambda gone: gone)).count()
    note("remove_invalid_rows", empty, {})
    return drop_all_null(df), spark.createDataFrame(log, LOG_SCHEMA)


def add_derived_columns(df: DataFrame) -> DataFrame:
    """`_row_total` and `_row_mean` over the numbers of a row, and year, month, weekday of each date.

    Missing numbers are left out of both; a row without numbers has total 0 and no mean.  Monday is 0.
    """
    numbers, out = numeric_columns(df), {}
    if len(numbers) >= 2:
        row_sum, row_n = F.lit(0.0), F.lit(0)
        for c in numbers:
            row_sum = row_sum + F.coalesce(quoted(c).cast("double"), F.lit(0.0))
            row_n = row_n + quoted(c).isNotNull().cast("int")
        out["_row_total"], out["_row_mean"] = row_sum, F.try_divide(row_sum, row_n)
    for c in columns_of(df, "datetime"):
        out[f"{c}_year"] = F.year(quoted(c))
        out[f"{c}_month"] = F.month(quoted(c))
        out[f"{c}_dayofweek"] = F.weekday(quoted(c))
    return df.withColumns(out) if out else df


def transform(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table with derived columns, business metrics of its numbers, and a log with a row per step.

    Metrics are over the derived table, so they cover the added numeric columns too.
    """
    out = add_derived_columns(df)
    added = [c for c in out.columns if c not in df.columns]
    metrics = business_metrics(out)
    log = df.sparkSession.createDataFrame(
        [
            (1, "add_derived_columns", 0, {"columns_added": ",".join(added)}),
            (2, "compute_business_metrics", 0, {"columns": str(len(numeric_columns(out)))}),
        ],
        LOG_SCHEMA,
    )
    return out, metrics, log
