"""The semantics every operator agrees on: nulls, parsing, safe arithmetic, names of aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)

# Text that counts as a number.  Spark's own cast also accepts suffixes such as '5d'.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Text that counts as a date or timestamp: a shape and the format that reads it.  Anything else stays
# text.  The shape is tested first because a failed parse is far dearer than a failed match.
TIMESTAMP_FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
)

# The same with the day before the month, for columns that say so.
DAY_FIRST_FORMATS = tuple((shape, "d/M/yyyy" if fmt == "M/d/yyyy" else fmt) for shape, fmt in TIMESTAMP_FORMATS)

# A time of day after a date by year: minutes or seconds, perhaps a fraction, perhaps Z or an offset.
TIMED_SHAPE = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)? ?(Z|[+-]\d{2}:?\d{2})?$"
# A time of day after a date with slashes.
SLASHED_SHAPE = r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})?$"

SHORTEST_DATE, LONGEST_DATE = 8, 36


def kind_of(data_type: T.DataType) -> str:
    """numeric, boolean, datetime, text or nested."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.NumericType,)):
        return "numeric"
    if isinstance(data_type, TEMPORAL):
        return "datetime"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "nested"


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    """Column names whose type is of one of `kinds`, in table order."""
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def quoted(name: str) -> Column:
    """The column with exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Treat NaN as missing in every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(quoted(c)), quoted(c)) for c in floats})


def parse_number(c: Column) -> Column:
    """Text as a double, or null if it is not a number."""
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def parse_timestamp(c: Column, formats: tuple[tuple[str, str], ...] = TIMESTAMP_FORMATS) -> Column:
    """Text as a timestamp by the format whose shape it has, or null.

    With DAY_FIRST_FORMATS dates with slashes have the day first.  A time without an offset is the session's.
    """
    text = F.trim(c)
    out = F
    for shape, fmt in formats:
        out = out.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)))
    minutes = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"^(\S{10}[ T]\d{2}:\d{2})(?![\d:])", "$1:00")
    out = out.when(text.rlike(TIMED_SHAPE), F.regexp_replace(minutes, r" (Z|[+-])", "$1").try_cast("timestamp"))
    slashed = "d/M/yyyy" if formats == DAY_FIRST_FORMATS else "M/d/yyyy"
    timed = F.when(F.length(F.regexp_replace(text, "[^:]", "")) == 2, F.try_to_timestamp(text, F.lit(f"{slashed} H:mm:ss")))
    out = out.when(text.rlike(SLASHED_SHAPE), timed.otherwise(F.try_to_timestamp(text, F.lit(f"{slashed} H:mm"))))
    return F.when(F.length(text).between(SHORTEST_DATE, LONGEST_DATE), out)


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double; null where den is 0 or null."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def percent(num: Column, den: Column) -> Column:
    """100 * num / den, and 0 where there is nothing to divide by."""
    return F.coalesce(ratio(num * 100.0, den), F.lit(0.0))


def total(c: Column) -> Column:
    """Sum that is 0 when there is nothing to add."""
    return F.coalesce(F.sum(c), F.lit(0).cast("double"))


def adjusted_skewness(c: Column) -> Column:
    """Bias-adjusted sample skewness: null below 3 values, 0 for a constant column."""
    x = c.cast("double")
    n = F.count(x).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, F.coalesce(F.skewness(x) * factor, F.lit(0.0)))


# Aggregates a caller may name.  The median is not among them: see plans.selection.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": total,
    "mean": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
}


def aggregate_named(name: str) -> Callable[[Column], Column]:
    try:
        return AGGREGATES[name]
    except KeyError:
        raise ValueError(f"unknown aggregate {name!r}; use one of {sorted(AGGREGATES)}") from None


def band(value: Column, *steps: tuple[float, str], otherwise: str, strict: bool = True) -> Column:
    """The label of the first step the value exceeds (or reaches, if not strict)."""
    out = F
    for limit, label in steps:
        out = out.when(value > limit if strict else value >= limit, F.lit(label))
    return out.otherwise(F.lit(otherwise)) if steps else F.lit(otherwise)


def band_below(value: Column, *steps: tuple[float, str], otherwise: str) -> Column:
    """The label of the first step the value stays under."""
    out = F
    for limit, label in steps:
        out = out.when(value < limit, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def month_of(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def short_number(n: Column, prefix: Column | str = "", sign_first: bool = False) -> Column:
    """1234567 -> 1.2M; whole numbers below 1000 without decimals, others with two."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    x = n.cast("double")
    size = F.abs(x)
    body = (
        F.when(size >= 1e9, F.format_string("%.1fB", size / 1e9))
        .when(size >= 1e6, F.format_string("%.1fM", size / 1e6))
        .when(size >= 1e3, F.format_string("%.1fK", size / 1e3))
        .when(size == F.floor(size), F.format_string("%,d", F.floor(size).cast("bigint")))
        .otherwise(F.format_string("%,.2f", size))
    )
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(x.isNotNull(), F.concat(sign, prefix, body))
